"""Group statistics, tests, similarity, cohort roll-ups and pixel tables: aggregates with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.functions.scalars import hashed
from tracekit.operators import resampling
from tracekit.sources.scratch import written


def sem(v: str | Column) -> Column:
    return F.stddev_samp(v) / F.sqrt(F.count(v))


def mean_sem(df: DataFrame, k: list[str], cols: list[str]) -> DataFrame:
    """(k, variable, mean, sem): one row for each group and column."""
    long = df.unpivot(k, cols, "variable", "value")
    return long.groupBy(*k, "variable").agg(F.avg("value").alias("mean"), sem("value").alias("sem"))


def mean_of_means(df: DataFrame, k: list[str], entity: str, v: str) -> DataFrame:
    """Mean of the entities' means, its error with the population deviation, and their number."""
    own = df.groupBy(*k, entity).agg(F.avg(v).alias("m"))
    return own.groupBy(*k).agg(F.avg("m").alias("mean"), (F.stddev_pop("m") / F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("n"))


def ratio_of_sums(df: DataFrame, k: list[str], num: str, den: str) -> DataFrame:
    return df.groupBy(*k).agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0))).alias("ratio"))


def class_counts(df: DataFrame, name: str, classes: list[str]) -> DataFrame:
    """(name, n, share) of all of ``classes``, those without rows too."""
    n = [F.sum((F.col(name) == c).cast("long")).alias(f"c{i}") for i, c in enumerate(classes)]
    one = df.agg(F.count("*").alias("total"), *n)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.coalesce(f"c{i}", F.lit(0)).cast("long").alias("n")) for i, c in enumerate(classes)]))
    return one.select("total", rows.alias("r")).select(f"r.{name}", "r.n", (F.col("r.n") / F.nullif("total", F.lit(0))).alias("share"))


def modal(df: DataFrame, k: list[str], v: str) -> DataFrame:
    """(k, v, n): the most frequent value of each group, the smallest on ties."""
    n = df.groupBy(*k, v).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("n"), v))
    return n.withColumn("_r", first).where("_r = 1").drop("_r")


def peak_order(curves: DataFrame, entity: str, o: str, v: str) -> DataFrame:
    """(entity, peak, place): the place of each curve's maximum, the first on ties, and the entities' order by it."""
    top = curves.groupBy(entity).agg(F.max_by(o, F.struct(F.col(v), -F.col(o))).alias("peak"))
    counts = top.groupBy("peak").agg(F.count("*").alias("c"))
    # the ranks before each peak come from counts by place, so no window spans all entities
    before = F.coalesce(F.sum("c").over(Window.orderBy("peak").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("peak", before.alias("b"))
    return top.join(F.broadcast(base), "peak").withColumn("place", F.col("b") + F.row_number().over(Window.partitionBy("peak").orderBy(entity))).select(entity, "peak", "place")


def members(labels: DataFrame, cluster: str, session: str, sessions: list[int], entity: str) -> DataFrame:
    """One row for each cluster but -1, with its entity in each session."""
    return labels.where(F.col(cluster) != -1).groupBy(cluster).pivot(session, sessions).agg(F.max(entity)).toDF(cluster, *[f"s{s}" for s in sessions])


def seen_everywhere(labels: DataFrame, cluster: str, session: str, n: int) -> DataFrame:
    return labels.where(F.col(cluster) != -1).groupBy(cluster).agg(F.countDistinct(session).alias("n")).where(F.col("n") == n).select(cluster)


def consecutive_pairs(df: DataFrame, k: list[str], o: str) -> DataFrame:
    """(k, pair, first, second) of consecutive items; an odd last one is left out."""
    n = df.withColumn("_r", F.row_number().over(Window.partitionBy(*k).orderBy(o)) - 1)
    g = n.groupBy(*k, F.floor(F.col("_r") / 2).alias("pair")).agg(F.min(o).alias("first"), F.max(o).alias("second"), F.count("*").alias("c"))
    return g.where("c = 2").drop("c")


def t_test(df: DataFrame, k: list[str], group: str, v: str, a: object, b: object) -> DataFrame:
    """(k, t, df) of the pooled two-sample test of group a against b."""
    x, y = F.when(F.col(group) == a, F.col(v)), F.when(F.col(group) == b, F.col(v))
    s = df.groupBy(*k).agg(F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"), F.count(x).alias("na"), F.count(y).alias("nb"))
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2)
    return s.where("na > 1 and nb > 1").select(*k, F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))).alias("t"), (F.col("na") + F.col("nb") - 2).alias("df"))


def mann_whitney(df: DataFrame, k: list[str], group: str, v: str, a: object, b: object) -> DataFrame:
    """(k, u, z): U of group a with average ranks, and its normal deviate with ties and continuity corrected."""
    both = df.where(F.col(group).isin(a, b))
    ties = both.groupBy(*k, v).agg(F.count("*").alias("c"), F.sum((F.col(group) == a).cast("long")).alias("ca"))
    low = F.coalesce(F.sum("c").over(Window.partitionBy(*k).orderBy(v).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("rank", low + (F.col("c") + 1) / 2)
    s = ranked.groupBy(*k).agg(F.sum(F.col("ca") * F.col("rank")).alias("ra"), F.sum("ca").alias("na"), F.sum("c").alias("n"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("tie"))
    s = s.withColumn("nb", F.col("n") - F.col("na")).withColumn("u", F.col("ra") - F.col("na") * (F.col("na") + 1) / 2).where("na > 0 and nb > 0")
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * (F.col("n") + 1 - F.col("tie") / (F.col("n") * (F.col("n") - 1))))
    big = F.greatest(F.col("u"), F.col("na") * F.col("nb") - F.col("u"))
    return s.select(*k, "u", F.try_divide(big - F.col("na") * F.col("nb") / 2 - 0.5, sd).alias("z"))


def bootstrap_sd(df: DataFrame, k: list[str], group: str, v: str, o: str, a: object, b: object, n: int, seed: int = 11, big: int = resampling.BIG) -> DataFrame:
    """(k, sd): deviation of the difference of the means of two hashed samples with replacement, each as large as the larger group.

    The values of a key's groups are two arrays, drawn from by index; keys with more than ``big`` rows are drawn by joins over rows.
    """
    own = df.where(F.col(group).isin(a, b))
    size = own.groupBy(*k).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb")).where("na > 0 and nb > 0")
    total = size.agg(F.coalesce(F.sum(F.greatest("na", "nb") * 2), F.lit(0)).alias("n"), F.count_if(F.col("na") + F.col("nb") > big).alias("large")).first()
    some = total.large > 0
    if some:  # at most one row for each ``big`` rows
        large = written(size.where(F.col("na") + F.col("nb") > big).select(*k), "large")
    small = own.join(F.broadcast(large), k, "left_anti") if some else own
    values = lambda g: F.transform(F.sort_array(F.collect_list(F.when(F.col(group) == g, F.struct(F.col(o).alias("o"), F.col(v).cast("double").alias("v"))))), lambda x: x["v"])
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in k])
    arrays = small.groupBy(*k).agg(values(a).alias("_a"), values(b).alias("_b")).where("size(_a) > 0 and size(_b) > 0")
    arrays = arrays.select(*k, F.when(F.length(name) > 0, F.concat(name, F.lit("-"))).otherwise("").alias("_name"), "_a", "_b")
    out = resampling.sampled_deviation(arrays.repartition(resampling.parts_of(df, total.n * n), *k), k, a, b, n, seed)
    return out.union(_bootstrap_by_rows(own.join(F.broadcast(large), k, "left_semi"), k, group, v, o, a, b, n, seed)) if some else out


def _bootstrap_by_rows(own: DataFrame, k: list[str], group: str, v: str, o: str, a: object, b: object, n: int, seed: int) -> DataFrame:
    """The same for keys of any size: each draw is a row that is joined to its value."""
    own = own.withColumn("i", F.row_number().over(Window.partitionBy(*k, group).orderBy(o)) - 1)
    size = own.groupBy(*k).agg(F.sum((F.col(group) == a).cast("long")).alias("na"), F.sum((F.col(group) == b).cast("long")).alias("nb")).where("na > 0 and nb > 0")
    sides = F.explode(F.array(F.struct(F.lit(a).alias(group), F.col("na").alias("m")), F.struct(F.lit(b).alias(group), F.col("nb").alias("m"))))
    draws = size.select(*k, F.greatest("na", "nb").alias("big"), sides.alias("s")).select(*k, "big", f"s.{group}", "s.m")
    draws = draws.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), "big")))
    draws = draws.withColumn("i", F.pmod(hashed(F.lit(seed), *[F.col(c) for c in k], F.col(group), F.col("iter"), F.col("j")), F.col("m")))
    m = draws.join(own.select(*k, group, "i", v), [*k, group, "i"]).groupBy(*k, "iter").agg((F.avg(F.when(F.col(group) == a, F.col(v))) - F.avg(F.when(F.col(group) == b, F.col(v)))).alias("d"))
    return m.groupBy(*k).agg(F.stddev_pop("d").alias("sd"))


def cluster_means(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    return vectors.select(cluster, F.posexplode(vector).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    n = df.groupBy(y).agg(F.count("*").alias("c"))
    total = df.agg(F.count("*").alias("n"), F.countDistinct(y).alias("classes"))
    return n.crossJoin(F.broadcast(total)).select(y, (F.col("n") / (F.col("classes") * F.col("c"))).alias("weight"))


def best_threshold(df: DataFrame, y: str, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, value): the first threshold with the largest sqrt(true positive rate * true negative rate)."""
    both = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit, truth = (F.col(score) >= F.col("threshold")).cast("double"), F.col(y)
    g = both.groupBy("threshold").agg(F.sqrt(F.avg(F.when(truth == 1, hit)) * F.avg(F.when(truth == 0, 1 - hit))).alias("value"))
    return g.orderBy(F.desc(F.round("value", 12)), "threshold").limit(1)


def area_under_curve(df: DataFrame, y: str, score: str, ranges: int = 1024) -> DataFrame:
    """One row (auc): how often a row of label 1 scores higher than one of label 0, ties as a half; null without both.

    Scores are counted by ranges of equal width, so no window spans more than the ranges, or the distinct scores of one.
    """
    n = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count_if(F.col(y) == 1).alias("_a"), F.count_if(F.col(y) == 0).alias("_b"))
    ends = n.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    placed = n.crossJoin(F.broadcast(ends)).withColumn("_r", F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges)).otherwise(0))
    each = placed.groupBy("_r").agg(F.sum("_b").alias("_t"))
    below = each.select("_r", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_u"))
    within = F.coalesce(F.sum("_b").over(Window.partitionBy("_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = placed.join(F.broadcast(below), "_r").withColumn("_w", within)
    wins = F.sum(F.col("_a") * (F.col("_u") + F.col("_w") + F.col("_b") / 2))
    return both.agg((wins / F.nullif(F.sum("_a") * F.sum("_b"), F.lit(0))).alias("auc"))


def binary_metrics(df: DataFrame, y: str, score: str, at: float) -> DataFrame:
    """One row: accuracy, precision, recall, f1 at a threshold, and the area under the curve."""
    p, t = F.col(score) >= at, F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    one = df.agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"), F.count("*").alias("n"))
    prec, rec = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return one.crossJoin(area_under_curve(df, y, score)).select(((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"), (2 * prec * rec / (prec + rec)).alias("f1"), "auc")


def mean_projection(pixels: DataFrame) -> DataFrame:
    """(y, x, v): mean over frames, over its maximum."""
    m = pixels.groupBy("y", "x").agg(F.avg("v").alias("m"))
    return m.crossJoin(F.broadcast(m.agg(F.max("m").alias("top")))).select("y", "x", F.try_divide(F.col("m"), F.col("top")).alias("v"))


def without_minimum(pixels: DataFrame) -> DataFrame:
    low = pixels.groupBy("y", "x").agg(F.min("v").alias("low"))
    return pixels.join(low, ["y", "x"]).select("frame", "y", "x", (F.col("v") - F.col("low")).alias("v"))


def block_means(pixels: DataFrame, factor: int) -> DataFrame:
    return pixels.groupBy("frame", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("v").alias("v"))


def reconstructed(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """(frame, y, x, v): sums of weight times trace over the components (entity)."""
    return footprints.join(traces, "entity").groupBy("frame", "y", "x").agg(F.sum(F.col("w") * F.col("value")).alias("v"))


def paired_t(pairs: DataFrame, k: list[str], a: str, b: str) -> DataFrame:
    """(k, t, df) of the differences a - b; groups with fewer than two pairs, or no spread, are left out."""
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).groupBy(*k).agg(F.avg("_d").alias("m"), F.stddev_samp("_d").alias("s"), F.count("_d").alias("n"))
    return d.where("n > 1 and s > 0").select(*k, (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def pair_summary(df: DataFrame, k: list[str], group: str, v: str, a: str, b: str) -> DataFrame:
    """(k, mean_a, median_a, sd_a, ..., higher): mean, median and population deviation of the two groups, and whether the first mean is the higher."""
    of = lambda g: F.when(F.col(group) == g, F.col(v))
    stats = [f(of(g)).alias(f"{n}_{g}") for g in (a, b) for f, n in ((F.avg, "mean"), (F.median, "median"), (F.stddev_pop, "sd"))]
    return df.groupBy(*k).agg(*stats, (F.avg(of(a)) > F.avg(of(b))).alias("higher"))


def null_z_p(real: DataFrame, null: DataFrame, k: list[str], v: str, null_v: str) -> DataFrame:
    """(k, v, z, p): how far v is from its null values in their deviations, and the share of them that reach it."""
    both = real.join(null, k)
    return both.groupBy(*k).agg(F.first(v).alias(v), ((F.first(v) - F.avg(null_v)) / F.nullif(F.stddev_pop(null_v), F.lit(0.0))).alias("z"), F.avg((F.col(null_v) >= F.col(v)).cast("double")).alias("p"))
