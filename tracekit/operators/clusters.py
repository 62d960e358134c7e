"""Tables of cluster labels: (session, entity, cluster, class, good), cluster -1 for rejected entities."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by_session(labels: DataFrame, sessions: list[int]) -> DataFrame:
    """(cluster, c<s>, g<s>): class (the first in order) and whether all its entities are good, by session; null where a cluster is absent."""
    known = labels.where("cluster <> -1").groupBy("cluster", "session").agg(F.min("class").alias("c"), F.bool_and("good").alias("g"))
    pick = lambda c, s: F.max(F.when(F.col("session") == s, F.col(c)))
    return known.groupBy("cluster").agg(*[pick(c, s).alias(f"{c}{s}") for s in sessions for c in "cg"])


def session_pair_counts(labels: DataFrame, sessions: list[int]) -> DataFrame:
    """(a, b, shared, same, shared_good, same_good) for each pair of sessions: clusters in both, of the same class in both, and those good in both."""
    wide = _by_session(labels, sessions)
    pairs = list(combinations(sessions, 2))

    def counts(a: int, b: int) -> list[Column]:
        shared, same = F.col(f"c{a}").isNotNull() & F.col(f"c{b}").isNotNull(), F.col(f"c{a}") == F.col(f"c{b}")
        good = F.col(f"g{a}") & F.col(f"g{b}")
        return [F.count_if(x).alias(n) for n, x in (("shared", shared), ("same", same), ("shared_good", shared & good), ("same_good", same & good))]

    # one pass over the clusters for all pairs, then a row a pair
    one = wide.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *counts(a, b)).alias(f"p{a}_{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[f"p{a}_{b}" for a, b in pairs])))


def exclusive_classes(labels: DataFrame, first: str, second: str) -> DataFrame:
    """(cluster, only_first, only_second, both) for clusters seen as either class."""
    has = labels.where("cluster <> -1").groupBy("cluster").agg(F.bool_or(F.col("class") == first).alias("x"), F.bool_or(F.col("class") == second).alias("y")).where("x or y")
    return has.select("cluster", F.expr("x and not y").alias("only_first"), F.expr("y and not x").alias("only_second"), F.expr("x and y").alias("both"))


def summary(labels: DataFrame) -> DataFrame:
    """(session, class, accepted, discarded, underlying, good): entities by fate."""
    kept = F.col("cluster") != -1
    return labels.groupBy("session", "class").agg(F.count_if(kept).alias("accepted"), F.count_if(~kept).alias("discarded"), F.count("*").alias("underlying"), F.count_if(kept & F.col("good")).alias("good"))


def members_kept(labels: DataFrame, keep: DataFrame) -> DataFrame:
    """labels with a null cluster where (session, entity) is not in ``keep``."""
    mark = keep.select("session", "entity").distinct().withColumn("_k", F.lit(True))
    return labels.join(mark, ["session", "entity"], "left").withColumn("cluster", F.when(F.col("_k"), F.col("cluster"))).drop("_k")
