"""Sessions and their files: inventories, newest artefacts, a registry of paths, tables put together and written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wrapped(manifest: DataFrame, k: list[str], mandatory: dict[str, DataFrame], optional: dict[str, DataFrame]) -> DataFrame:
    """Each session of the manifest with a struct for each part (k, ...); a mandatory part that is missing raises an error when rows are read, an optional one is null. Parts have one row a session."""
    out = manifest
    for name, part in (mandatory | optional).items():
        rest = [c for c in part.columns if c not in k]
        out = out.join(part.select(*k, F.struct(*rest).alias(name)), k, "left")
        if name in mandatory:
            fail = F.raise_error(F.concat_ws(" ", F.lit(f"no {name} for"), *[F.col(c).cast("string") for c in k]))
            out = out.withColumn(name, F.when(F.col(name).isNull(), fail.cast(out.schema[name].dataType)).otherwise(F.col(name)))
    return out


def inventory(paths: DataFrame, session: Column, path: str, tags: dict[str, str]) -> DataFrame:
    """(session, <tag>...): whether a path of each session holds the tag's text."""
    return paths.groupBy(session.alias("session")).agg(*[F.bool_or(F.col(path).contains(t)).alias(name) for name, t in tags.items()])


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, length) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("modified"), "length")


def latest(files: DataFrame, k: list[str], path: str, modified: str, tags: list[str], exclude: list[str] | None = None) -> DataFrame:
    """(k, path): the newest of the paths that hold all tags and nothing excluded, the last by name on ties; null if there is none."""
    good = F.lit(True)
    for t in tags:
        good = good & F.col(path).contains(t)
    for t in exclude or []:
        good = good & ~F.col(path).contains(t)
    return files.groupBy(*k).agg(F.max_by(path, F.when(good, F.struct(modified, path))).alias(path))


def upserted(registry: DataFrame, found: DataFrame, avoid: list[str] | None = None) -> DataFrame:
    """(path, session) of the registry and of what was found, once each; paths with a hidden folder or one to avoid are left out."""
    both = registry.select("path", "session").unionByName(found.select("path", "session"))
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & (F.length(p) > 1))
    bad = F.exists(parts, lambda p: p.isin(*(avoid or [""])) & (F.length(p) > 0))
    return both.where(~hidden & ~bad).dropDuplicates(["path", "session"])


def searched(registry: DataFrame, term: str, most: int = 100) -> DataFrame:
    """The first ``most`` sessions whose names hold the term, by name."""
    return registry.where(F.col("session").contains(term)).select("session").distinct().orderBy("session").limit(most)


def write_table(df: DataFrame, folder: str, name: str, formats: list[str], dated: bool = False, suffix: str = "") -> list[str]:
    """Writes ``df`` below the folder in each format (parquet, json, csv with a header) and gives the paths: name, suffix, and the day if ``dated``."""
    day = df.sparkSession.sql("select date_format(current_date(), 'yyMMdd')").first()[0] if dated else None
    stem = "_".join(x for x in (name, suffix, day) if x)
    out = []
    for f in formats:
        path = f"{folder.rstrip('/')}/{stem}.{f}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if f == "csv" else writer).format(f).save(path)
        out.append(path)
    return out
