"""Statistical tests with their tail probabilities, resampling and the classes that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracekit.functions import tails
from tracekit.functions.scalars import hashed
from tracekit.operators import groups as G
from tracekit.operators import resampling
from tracekit.sources.scratch import written


def t_test(df: DataFrame, k: list[str], group: str, v: str, a: object, b: object) -> DataFrame:
    """(k, t, df, p) of the pooled two-sample test, two-sided."""
    out = G.t_test(df, k, group, v, a, b)
    return out.withColumn("p", tails.t_two_sided("t", F.col("df").cast("double")))


def paired_t(pairs: DataFrame, k: list[str], a: str, b: str) -> DataFrame:
    """(k, t, df, p) of the differences a - b, two-sided."""
    return G.paired_t(pairs, k, a, b).withColumn("p", tails.t_two_sided("t", F.col("df").cast("double")))


def mann_whitney(df: DataFrame, k: list[str], group: str, v: str, a: object, b: object, exact: bool = True) -> DataFrame:
    """(k, u, z, p): two-sided; with ``exact``, from the distribution of U for untied samples of which one has at most eight values, else by the normal deviate."""
    out = G.mann_whitney(df, k, group, v, a, b)
    if not exact:
        return out.withColumn("p", tails.normal_two_sided("z"))
    both = df.where(F.col(group).isin(a, b) & F.col(v).isNotNull())
    size = both.groupBy(*k, v).agg(F.count("*").alias("c"), F.count_if(F.col(group) == a).alias("ca")).groupBy(*k).agg(F.sum("ca").alias("_a"), F.sum(F.col("c") - F.col("ca")).alias("_b"), F.bool_or(F.col("c") > 1).alias("_t"))
    return out.join(size, k).withColumn("p", tails.u_two_sided("u", "_a", "_b", "z", "_t")).drop("_a", "_b", "_t")


def pair_tests(df: DataFrame, k: list[str], group: str, v: str, a: str, b: str, test: str = "t", level: float = 0.05) -> DataFrame:
    """(k, stat, p, significant, mean_a, median_a, sd_a, ..., higher): the test (``t`` or ``u``) beside what describes the two groups."""
    stat = t_test(df, k, group, v, a, b).select(*k, F.col("t").alias("stat"), "p") if test == "t" else mann_whitney(df, k, group, v, a, b).select(*k, F.col("u").alias("stat"), "p")
    return stat.withColumn("significant", F.col("p") < level).join(G.pair_summary(df, k, group, v, a, b), k)


def condition_effect(df: DataFrame, k: list[str], group: str, v: str, o: str, a: object, b: object, n: int = 1000, limit: float = 100.0) -> DataFrame:
    """(k, diff, sd, sign, kept): the difference of the groups' means with its bootstrap deviation, and whether it lies beyond the mean difference of its sign, of those under ``limit``."""
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(v)))
    diff = df.groupBy(*k).agg((mean(a) - mean(b)).alias("diff")).where("diff is not null").withColumn("sign", F.signum("diff").cast("int"))
    usual = diff.where(F.abs("diff") < limit).groupBy("sign").agg(F.avg("diff").alias("_m"))
    out = diff.join(G.bootstrap_sd(df, k, group, v, o, a, b, n), k, "left").join(F.broadcast(usual), "sign", "left")
    return out.select(*k, "diff", "sd", "sign", F.coalesce(F.abs("diff") >= F.abs("_m"), F.lit(False)).alias("kept"))


def permuted_bins(df: DataFrame, k: list[str], o: str, v: str, bins: int = 10, n: int = 1000, seed: int = 13, big: int = resampling.BIG) -> DataFrame:
    """(k, bin, mean, t, df, p): the mean of each of ``bins`` equal stretches, and how far the means of n shuffles of the series lie below it (one-sample t, less).

    A shuffle orders the samples of a series by a hash. Samples at the end that fill no whole stretch belong to the last one. A series is one array, permuted n times in a task; one of
    more than ``big`` samples is shuffled by rows.
    """
    size = df.groupBy(*k).agg(F.count("*").alias("_n"))
    total = size.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count_if(F.col("_n") > big).alias("large")).first()
    some = total.large > 0
    if some:  # at most one row for each ``big`` rows
        large = written(size.where(F.col("_n") > big).select(*k), "large")
    small = df.join(F.broadcast(large), k, "left_anti") if some else df
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in k])
    each = F.sort_array(F.collect_list(F.struct(F.col(o).alias("o"), F.col(v).cast("double").alias("v"))))
    series = small.groupBy(*k).agg(each.alias("_s"))
    series = series.select(*k, F.when(F.length(name) > 0, F.concat(name, F.lit("-"))).otherwise("").alias("_name"), F.transform("_s", lambda x: x["o"].cast("string")).alias("_o"), F.transform("_s", lambda x: x["v"]).alias("_v"))
    both = resampling.permuted_means(series.repartition(resampling.parts_of(df, total.n * n), *k), k, bins, n, seed)
    if some:
        both = both.union(_permuted_by_rows(df.join(F.broadcast(large), k, "left_semi"), k, o, v, bins, n, seed))
    t = F.when(F.col("_null_sd") > 0, (F.col("_null_mean") - F.col("mean")) / (F.col("_null_sd") / F.sqrt("_draws")))
    return both.select(*k, "bin", "mean", t.alias("t"), (F.col("_draws") - 1).alias("df")).withColumn("p", tails.t_less("t", F.col("df").cast("double")))


def _permuted_by_rows(df: DataFrame, k: list[str], o: str, v: str, bins: int, n: int, seed: int) -> DataFrame:
    """(k, bin, mean, _null_mean, _null_sd, _draws) for series of any length: each sample is a row of each shuffle."""
    w = Window.partitionBy(*k)
    size = df.select(*k, o, v, F.count("*").over(w).alias("_n"), (F.row_number().over(w.orderBy(o)) - 1).alias("_i"))
    at = lambda i: F.least(F.floor(i / F.greatest(F.floor(F.col("_n") / bins), F.lit(1))), F.lit(bins - 1)).cast("int")
    real = size.groupBy(*k, at(F.col("_i")).alias("bin")).agg(F.avg(v).alias("mean"))
    many = size.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(n))))
    by = Window.partitionBy(*k, "iter").orderBy(hashed(F.lit(seed), *[F.col(c) for c in k], F.col("iter"), F.col(o)), o)
    null = many.withColumn("_j", F.row_number().over(by) - 1).groupBy(*k, "iter", at(F.col("_j")).alias("bin")).agg(F.avg(v).alias("_m"))
    return null.join(real, [*k, "bin"]).groupBy(*k, "bin").agg(F.max("mean").alias("mean"), F.avg("_m").alias("_null_mean"), F.stddev_samp("_m").alias("_null_sd"), F.count("*").alias("_draws"))


def context_classes(tested: DataFrame, entity: str, context: str, p: str, first: object, second: object, least: int = 5, level: float = 0.05) -> DataFrame:
    """(entity, kind): ``both``, ``first``, ``second`` or ``none``, by the contexts in which at least ``least`` bins are significant."""
    n = lambda c: F.count_if((F.col(context) == c) & (F.col(p) < level)) >= least
    out = tested.groupBy(entity).agg(n(first).alias("a"), n(second).alias("b"))
    return out.select(entity, F.expr("case when a and b then 'both' when a then 'first' when b then 'second' else 'none' end").alias("kind"))


def classified(entities: DataFrame, listed: DataFrame, tested: DataFrame, fields: DataFrame, entity: str, other: str = "omit") -> DataFrame:
    """(entity, kind, cues): ``listed`` ones first, then ``cue`` for those with a significant test (entity, main, comp, significant, higher) of a cue against its omission in which the cue is the higher, then the class of their field (entity, class), else ``non``; cues are all those cues."""
    hit = tested.where((F.col("comp") == other) & F.col("significant") & F.col("higher")).groupBy(entity).agg(F.sort_array(F.collect_set("main")).alias("cues"))
    out = entities.select(entity).distinct().join(listed.select(entity).distinct().withColumn("_l", F.lit(True)), entity, "left").join(hit, entity, "left").join(fields.select(entity, F.col("class").alias("_f")), entity, "left")
    kind = F.when(F.col("_l"), "listed").when(F.col("cues").isNotNull(), "cue").when(F.col("_f").isNotNull(), F.col("_f")).otherwise("non")
    return out.select(entity, kind.alias("kind"), F.coalesce("cues", F.array().cast("array<string>")).alias("cues"))


def session_tests(df: DataFrame, k: list[str], group: str, values: list[str], a: object, b: object) -> DataFrame:
    """(k, variable, t, df, p): the two groups of subjects against each other for each key and value column."""
    return t_test(df.unpivot([*k, group], values, "variable", "value"), [*k, "variable"], group, "value", a, b)


