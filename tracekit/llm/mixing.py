"""Hierarchical budgeting: a token budget propagated through a tree of groups, and seeded prefixes of leaves.

The levels of the tree are columns, say domain, language, source. At each node the budget is shared among the children in proportion to
their weights; a child that cannot take its share leaves the rest to its siblings, and only what all children
together cannot take goes back to the siblings of the node. That is a water level at each node, found from
cumulative sums over its children. A leaf gives its documents in a seeded order, epoch after epoch, until its budget is met.
All of it is DataFrame aggregation and windows over groups; the order of a leaf is cut into
ranges of the seeded hash, so that no window ever spans a whole leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.llm.shared import stored

#: Documents that one window should span at most, about.
RANGE = 5000


def seeded(seed: int, epoch: Column, key: str) -> Column:
    """The first 32 bits of md5("seed-epoch-key"), as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


def shared_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes`` (parent columns, child, weight, capacity, budget of the parent) with the child's own budget.

    The budget is the weight times the water level, or the capacity if that is less; children are ordered by capacity over weight,
    and all those are full for which the full ones before and the level they would need fit the budget.
    """
    by = Window.partitionBy(*parent).orderBy("ratio", child)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*parent)
    n = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0)))
    n = n.withColumn("cap", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0.0)))
    n = n.withColumn("caps", F.sum("cap").over(upto)).withColumn("weights", F.sum("weight").over(upto)).withColumn("all_weights", F.sum("weight").over(whole))
    n = n.withColumn("full", F.col("caps") + F.col("ratio") * (F.col("all_weights") - F.col("weights")) <= F.col("budget"))
    n = n.withColumn("used", F.coalesce(F.max(F.when(F.col("full"), F.col("caps"))).over(whole), F.lit(0.0)))
    n = n.withColumn("gone", F.coalesce(F.max(F.when(F.col("full"), F.col("weights"))).over(whole), F.lit(0.0)))
    level = (F.col("budget") - F.col("used")) / (F.col("all_weights") - F.col("gone"))
    own = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))
    return n.withColumn("own", own).select(*parent, child, "capacity", F.col("own").alias("budget"))


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: Column, epochs: int, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(levels, tokens, budget) of each leaf of ``leaves`` (levels, tokens): its share of ``budget`` (a column of the grand total ``total``).

    ``weights`` has, by level, weights of values; others weigh 1, and so does every value of a level that is not named.
    A leaf can take its tokens once for each epoch.
    """
    weights = weights or {}

    def weight(level: str) -> Column:
        out = F.lit(1.0)
        for value, w in weights.get(level, {}).items():
            out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
        return out

    tree = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs)
    total = leaves.agg(F.sum("tokens").cast("double").alias("total"))
    above = total.select(F.lit(0).alias("root"), budget.alias("budget"))
    known = ["root"]
    for level in levels:
        nodes = tree.withColumn("root", F.lit(0)).groupBy(*known, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(level))
        shared = shared_out(nodes.join(above, known), known, level)
        known = [*known, level]
        above = shared.select(*known, "budget")
    return leaves.join(above.drop("root"), levels)


def mix(docs: DataFrame, levels: list[str], key: str = "doc_id", text: str = "text", fraction: float = 0.5, epochs: int = 4, seed: int = 42, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(key, levels, n_tokens, copies, n_taken) of each row that is taken at least once.

    Tokens are runs of anything but ASCII white space; rows without any are never taken. The whole budget is ``fraction`` of all tokens.
    A leaf whose budget is k times its tokens and a rest gives every document k times, and once more those that begin within the rest in the seeded order of
    epoch k, of the last one only the tokens up to the rest. copies counts these takings, n_taken their tokens. Values of levels that are null form groups named "null". Rows with one key count each by itself; those that are alike in
    key, levels and size share a fate where the order cuts between them. Other columns are ignored.
    """
    tokens = F.expr(f"regexp_count(coalesce(`{text}`, ''), '[^\\\\x20\\\\x09-\\\\x0D]+')").cast("long")
    rows = docs.select(F.col(key).alias("k"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(f"l{i}") for i, c in enumerate(levels)], tokens.alias("n_tokens")).where("n_tokens > 0")
    rows = stored(rows, "tokens")  # texts are read and counted once
    cols = [f"l{i}" for i in range(len(levels))]
    named = {f"l{i}": w for i, c in enumerate(levels) if (w := (weights or {}).get(c))}
    leaves = rows.groupBy(*cols).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    shares = leaf_budgets(leaves, cols, F.floor(F.col("total") * F.lit(fraction)), epochs, named)
    shares = shares.withColumn("whole", F.least(F.floor(F.round(F.col("budget") / F.col("tokens"), 9)), F.lit(epochs)))
    shares = shares.withColumn("rest", F.round(F.col("budget") - F.col("whole") * F.col("tokens"), 3)).select(*cols, "whole", "rest", F.ceil(F.col("rows") / RANGE).alias("ranges"))
    placed = rows.join(shares, cols).withColumn("h", seeded(seed, F.col("whole"), "k"))
    placed = placed.withColumn("range", F.floor(F.col("h") * F.col("ranges") / F.lit(1 << 32)))
    sums = placed.groupBy(*cols, "range").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy(*cols).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*cols, "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*cols, "range").orderBy("h", "k", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(sums, [*cols, "range"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = out.withColumn("copies", F.col("whole") + (F.col("start") < F.col("rest")).cast("long")).where("copies > 0")
    taken = F.col("whole") * F.col("n_tokens") + F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.ceil(F.col("rest") - F.col("start"))))
    return out.select(F.col("k").alias(key), *[F.col(f"l{i}").alias(c) for i, c in enumerate(levels)], "n_tokens", F.col("copies").cast("long").alias("copies"), taken.cast("long").alias("n_taken"))
