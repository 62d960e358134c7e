"""Roll-ups over subjects, groups and sessions: ratios, flags, codes and names of segments, tuning summaries, outliers, eligibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_rates(events: DataFrame, samples: DataFrame, k: list[str], n: str, among: DataFrame | None = None) -> DataFrame:
    """(k, rate): events of each series over its samples (k, n), 0 for one without events; only of the series in ``among`` if given."""
    count = events.groupBy(*k).agg(F.count("*").alias("_c"))
    wanted = samples if among is None else samples.join(among.select(*k).distinct(), k, "left_semi")
    return wanted.join(count, k, "left").select(*k, (F.coalesce("_c", F.lit(0)) / F.col(n)).alias("rate"))


def ratio_columns(df: DataFrame, columns: list[str], denominators: list[str]) -> DataFrame:
    """df with ``<column>_by_<denominator>`` for each pair, null where the denominator is 0."""
    return df.select("*", *[(F.col(c) / F.nullif(F.col(d), F.lit(0))).alias(f"{c}_by_{d}") for c in columns for d in denominators])


def class_flags(labels: DataFrame, name: str) -> DataFrame:
    """labels (session, entity, cluster, class, good) with whether each entity is of the class and accepted, and whether it is a good one too."""
    of = (F.col("class") == name) & (F.col("cluster") != -1)
    return labels.select("session", "entity", F.coalesce(of, F.lit(False)).alias("of_class"), F.coalesce(of & F.col("good"), F.lit(False)).alias("good_of_class"))


def auto_bins(df: DataFrame, k: list[str], o: str, v: str, laps: str, gap: float = 20.0, share: float = 15.0) -> DataFrame:
    """(k, bin, at): the rounded mean position of each group of positions.

    Where positions jump ahead by more than ``gap``, as many bins as hold over ``laps / share`` positions in a histogram of automatic width (the smaller of
    Freedman-Diaconis's and Sturges's), of equal width again and empty ones left out; else one.
    """
    w = Window.partitionBy(*k).orderBy(o)
    jumps = df.select(*k, F.col(v).alias("_v"), F.col(laps).alias("_laps"), (F.col(v) - F.lag(v).over(w)).alias("_d"))
    n = jumps.groupBy(*k).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_d").alias("_d"), F.max("_laps").alias("_laps"), (F.percentile("_v", F.lit(0.75)) - F.percentile("_v", F.lit(0.25))).alias("_iqr"))
    fd, sturges = 2 * F.col("_iqr") / F.pow("_n", F.lit(1 / 3)), (F.col("_hi") - F.col("_lo")) / (F.log2("_n") + 1)
    n = n.withColumn("_b", F.coalesce(F.ceil(F.try_divide(F.col("_hi") - F.col("_lo"), F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges))), F.lit(1)))
    at = lambda bins: F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), bins - 1)).otherwise(0).cast("long")
    placed = jumps.select(*k, "_v").join(n, k)
    held = placed.groupBy(*k, at(F.col("_b")).alias("_c"), "_laps").agg(F.count("*").alias("_m")).groupBy(*k).agg(F.count_if(F.col("_m") > F.col("_laps") / share).alias("_kinds"))
    both = placed.join(held, k).withColumn("_use", F.when(F.col("_d") > gap, F.greatest("_kinds", F.lit(1))).otherwise(1))
    return both.groupBy(*k, at(F.col("_use")).alias("bin")).agg(F.bround(F.avg("_v")).cast("long").alias("at"))


def segment_codes(bins: DataFrame, session: str, lap: str, cue: str, at: str, order: list[str]) -> DataFrame:
    """(session, lap, code, kind): the location numbers of a lap's cues as digits, the first cue of ``order`` the last digit, and their rank among the session's codes from 1; laps without any cue are of kind 0, or of one kind more if there are over two of them."""
    power = reduce(lambda out, x: F.when(F.col(cue) == x[1], F.lit(10 ** x[0])).otherwise(out), enumerate(order), F.lit(0))
    laps = bins.groupBy(session, lap).agg(F.sum(F.col(at) * power).cast("long").alias("code"))
    codes = laps.where("code <> 0").select(session, "code").distinct()
    ranked = codes.withColumn("kind", F.row_number().over(Window.partitionBy(session).orderBy("code")).cast("long"))
    whole = laps.groupBy(session).agg(F.count_if(F.col("code") == 0).alias("_zeros")).join(ranked.groupBy(session).agg(F.max("kind").alias("_most")), session, "left")
    none = F.when(F.col("_zeros") > 2, F.coalesce("_most", F.lit(0)) + 1).otherwise(0)
    return laps.join(ranked, [session, "code"], "left").join(whole, session).select(session, lap, "code", F.when(F.col("code") != 0, F.col("kind")).otherwise(none).cast("long").alias("kind"))


def segment_names(types: DataFrame, kinds: DataFrame, session: str, lap: str) -> DataFrame:
    """(session, type, name) of the types of laps (session, lap, type): named by what the type's last lap leaves out, kinds (session, lap, kind), or by what the session's whole laps hold.

    A type of a single lap has no name. Where the names are just those of two cues left out and both, they are called by the cue that is there.
    """
    has = lambda *names: F.bool_or(F.col("kind").isin(*names))
    flags = kinds.groupBy(session).agg(has("OMITBOTH", "OMITCUE2").alias("_two"), has("OMITOPTO").alias("_opto"), has("OMITTONE", "OMITLED").alias("_three"), has("OMITCUE1_L1").alias("_shift"))
    last = types.groupBy(session, "type").agg(F.count("*").alias("_n"), F.max(lap).alias(lap)).join(kinds, [session, lap], "left").join(flags, session, "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    whole = F.when(on("_two") & ~on("_opto"), "BOTHCUES").when(on("_three"), "CUE/LED/TONE").when(on("_opto"), "CUEwOPTO").otherwise("CUE1")
    kind = F.col("kind")
    name = (
        F.when(kind.isNull(), whole).when(kind == "SWITCH", F.when(on("_shift"), "SHIFT").otherwise("SWITCH")).when(kind == "OMITCUE1_L1", "CUE1").when(kind == "OMITCUE1_L2", "SHIFT")
        .when(kind == "OMITTONE", "CUE/LED").when(kind == "OMITLED", "CUE/TONE").when((kind == "OMITCUE1") & on("_three"), "LED/TONE").when((kind == "OMITCUE1") & on("_opto"), "OPTO").when(kind == "OMITOPTO", "CUE").otherwise(kind)
    )
    named = last.select(session, "type", F.when(F.col("_n") > 1, name).alias("name"))
    pair = named.groupBy(session).agg((F.sort_array(F.collect_set(F.coalesce("name", F.lit("")))) == F.array(F.lit("OMITBOTH"), F.lit("OMITCUE1"), F.lit("OMITCUE2"))).alias("_pair"))
    told = F.when(F.col("_pair") & (F.col("name") == "OMITCUE2"), "CUE1").when(F.col("_pair") & (F.col("name") == "OMITCUE1"), "CUE2").otherwise(F.col("name"))
    return named.join(pair, session).select(session, "type", told.alias("name"))


def collated(tables: dict[str, DataFrame], session: str, groups: DataFrame, subject: str) -> DataFrame:
    """The rows of all tables, one for each session, with the session's name and their subject's group (subject, group)."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(session, F.lit(name)) for name, df in tables.items()])
    return rows.join(groups, subject, "left")


def known_means(df: DataFrame, k: list[str], v: str) -> DataFrame:
    """(k, mean, n): NaN and null skipped; groups without any value have a null mean."""
    x = F.when(~F.isnan(F.col(v).cast("double")), F.col(v))
    return df.groupBy(*k).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))


def field_rate_ratio(curves: DataFrame, entity: str, kind: str, at: str, v: str, reference: object, other: object, edge: int = 5, least: float = 2.0, most: float = 25.0) -> DataFrame:
    """(entity, peak, reference, other, ratio, selected): mean rates within ``edge`` bins of the reference curve's peak (the first on ties); a ratio over 0 is ``most``, 0 over 0 none; selected if over ``least``."""
    peak = curves.where(F.col(kind) == reference).groupBy(entity).agg(F.max_by(at, F.struct(F.col(v), -F.col(at))).alias("peak"))
    near = curves.join(peak, entity).where(F.abs(F.col(at) - F.col("peak")) <= edge)
    mean = lambda x: F.avg(F.when(F.col(kind) == x, F.col(v)))
    out = near.groupBy(entity, "peak").agg(mean(reference).alias("reference"), mean(other).alias("other"))
    ratio = F.when(F.col("other") == 0, F.when(F.col("reference") > 0, F.lit(most))).otherwise(F.col("reference") / F.col("other"))
    return out.withColumn("ratio", ratio).withColumn("selected", F.coalesce(F.col("ratio") > least, F.lit(False)))


def tuning_curves(curves: DataFrame, k: list[str], at: str, v: str) -> DataFrame:
    """(k, at, mean, sem) over entities."""
    return curves.groupBy(*k, at).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))


def tuning_maxima(curves: DataFrame, k: list[str], entity: str, v: str, q: float = 0.999) -> DataFrame:
    """(k, mean, sem, top): mean and error of the entities' maxima, and the quantile of all values."""
    own = curves.groupBy(*k, entity).agg(F.max(v).alias("_m")).groupBy(*k).agg(F.avg("_m").alias("mean"), (F.stddev_samp("_m") / F.sqrt(F.count("_m"))).alias("sem"))
    return own.join(curves.groupBy(*k).agg(F.percentile(v, F.lit(q)).alias("top")), k)


def session_summary(df: DataFrame, k: list[str], subject: str, values: list[str]) -> DataFrame:
    """(k, variable, mean, sem, total): mean and error of each value, and the mean of the subjects' sums; subjects without rows count for nothing."""
    long = df.unpivot([*k, subject], values, "variable", "value")
    one = long.groupBy(*k, "variable").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"))
    total = long.groupBy(*k, "variable", subject).agg(F.sum("value").alias("_t")).groupBy(*k, "variable").agg(F.avg("_t").alias("total"))
    return one.join(total, [*k, "variable"])


def outlier_pairs(pairs: DataFrame, k: list[str], a: str, b: str, limit: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """The pairs whose sizes both stay within the limit; and (k, dropped, which) of those that don't, ``which`` the sorted list of their ids (column id)."""
    out = (F.abs(a) > limit) | (F.abs(b) > limit)
    return pairs.where(~F.coalesce(out, F.lit(False))), pairs.where(out).groupBy(*k).agg(F.count("*").alias("dropped"), F.sort_array(F.collect_list("id")).alias("which"))


def eligible(sessions: DataFrame, subject: str, every: Sequence[str] = (), some: Sequence[str] = (), among: DataFrame | None = None) -> DataFrame:
    """Subjects all of whose sessions have each flag in ``every`` and one of the flags in ``some``, and that are in ``among`` if it is given."""
    ok = sessions.groupBy(subject).agg(*[F.bool_and(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in {*every, *some}])
    keep = reduce(lambda a, b: a & b, [F.col(c) for c in every], F.lit(True))
    if some:
        keep = keep & reduce(lambda a, b: a | b, [F.col(c) for c in some])
    out = ok.where(keep).select(subject)
    return out if among is None else out.intersect(among.select(subject))


def class_sets(a: DataFrame, b: DataFrame, everyone: DataFrame, entity: str) -> DataFrame:
    """(entity, kind): both, first, second or none, by set operations."""
    one = lambda df, kind: df.withColumn("kind", F.lit(kind))
    x, y, z = (df.select(entity) for df in (a, b, everyone))
    return one(x.intersect(y), "both").union(one(x.subtract(y), "first")).union(one(y.subtract(x), "second")).union(one(z.subtract(x).subtract(y), "none"))


def sorted_by(df: DataFrame, columns: list[str], group: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """df in the order of a list of groups, others last, then of columns; ``rank`` tells the group's place."""
    rank: Column = F.lit(len(order))
    for i, g in enumerate(order):
        rank = F.when(F.col(group or "") == g, i).otherwise(rank)
    return df.withColumn("rank", rank).orderBy("rank", *columns)


def top_rows(df: DataFrame, k: list[str], by: list[Column]) -> DataFrame:
    """The first row of each group in the order ``by``, by an aggregate."""
    rest = F.struct(*[c for c in df.columns if c not in k])
    w = Window.partitionBy(*k).orderBy(*by)
    return df.select(*k, rest.alias("_row"), F.row_number().over(w).alias("_n")).where("_n = 1").select(*k, "_row.*")


def responses(trials: DataFrame, k: list[str], trial: str, rel: str, v: str, onset: int) -> DataFrame:
    """(k, response): the mean, over trials, of each trial's largest value from ``onset`` on."""
    own = trials.where(F.col(rel) >= onset).groupBy(*k, trial).agg(F.max(v).alias("_p"))
    return own.groupBy(*k).agg(F.avg("_p").alias("response"))


def significant_footprints(tested: DataFrame, footprints: DataFrame, k: list[str], flag: str) -> DataFrame:
    """The footprints of entities whose pair test has the flag."""
    return footprints.join(tested.where(F.col(flag)).select(*k).distinct(), k, "left_semi")
