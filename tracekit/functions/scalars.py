"""Expressions over columns: scaling, binning, angles, names. Each returns a Column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pins of the cue valves and what they stand for.
PINS = {3: "CUE1", 4: "CUE2", 10: "CUE3", 7: "REWARD", 52: "LED"}


def finite(v: Column, fill: float = 0.0) -> Column:
    """``v`` with NaN and infinities as ``fill``."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(fill)).otherwise(v)


def wrapped_angle(a: Column, center: float = 0.0) -> Column:
    """``a`` in [center - pi, center + pi)."""
    low = center - math.pi
    return F.pmod(a - F.lit(low), F.lit(2 * math.pi)) + F.lit(low)


def angle_difference(a: Column, b: Column) -> Column:
    return wrapped_angle(a - b)


def bin_index(v: Column, start: float, stop: float, bins: int) -> Column:
    """The right-open bin of v among ``bins`` equal ones; the last includes ``stop``; null outside."""
    raw = F.floor((v - F.lit(start)) * F.lit(bins / (stop - start)))
    return F.when((v >= start) & (v <= stop), F.least(raw, F.lit(bins - 1)).cast("int"))


def gaussian_kernel(window: int) -> list[float]:
    """Weights that sum to 1, with a full width at half maximum of ``window``."""
    sigma, half = window / 2.355, window // 2
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [r / sum(raw) for r in raw]


def decay_kernel(tau: float, start: int = 0, tail: int = 6) -> list[float]:
    """exp(-x / tau) for whole x from ``start`` to ``tail * tau + start``, that one left out, summing to 1."""
    raw = [math.exp(-x / tau) for x in range(start, int(tail * tau) + start)]
    return [r / sum(raw) for r in raw]


def pin_name(pin: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in PINS.items():
        out = F.when(pin == k, name).otherwise(out)
    return out


def downsample_factor(height: Column, width: Column) -> Column:
    """The factor of the first size band that either dimension is in, else 1."""
    out = F.lit(1)
    for low, high, factor in reversed([(400, 650, 2), (651, 900, 3), (901, 1200, 4), (1201, 1500, 5)]):
        out = F.when(height.between(low, high) | width.between(low, high), factor).otherwise(out)
    return out


def first_number(s: Column) -> Column:
    """The first whole number in a string, 0 if none."""
    return F.coalesce(F.regexp_extract(s, r"(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def hashed(*parts: Column) -> Column:
    """A reproducible draw of 32 bits from md5 over parts joined by '-'."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def scaled(df: DataFrame, v: str, keys: list[str], out: str = "scaled", constant: float = 0.0, adjust: float = 0.0) -> DataFrame:
    """(v - min) / (max - min) + adjust within each group of ``keys``, ``constant`` where all are equal.

    Without keys the two bounds come from one aggregate, joined as a single row.
    """
    bounds = df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    both = df.join(bounds, keys) if keys else df.crossJoin(F.broadcast(bounds))
    value = F.when(F.col("_hi") > F.col("_lo"), (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) + F.lit(adjust)).otherwise(F.lit(constant))
    return both.withColumn(out, value).drop("_lo", "_hi")


def rescaled_bits(df: DataFrame, v: str, bits: int, out: str = "level") -> DataFrame:
    """Min-max to 0 .. 2**bits - 1, rounded half to even; a constant gives 0."""
    return scaled(df, v, [], "_s").withColumn(out, F.bround(F.col("_s") * (2**bits - 1)).cast("long")).drop("_s")


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns as columns of their own at all depths, names joined by ``sep``."""
    from pyspark.sql.types import StructType

    def leaves(schema: StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        return [p for f in schema.fields for p in (leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, StructType) else [(*path, f.name)])]

    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)) for p in leaves(df.schema, ())])


def cohort(name: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """The group of the first rule (prefix, group) that ``name`` starts with."""
    out = F.lit(other)
    for prefix, group in reversed(rules):
        out = F.when(name.startswith(prefix), group).otherwise(out)
    return out


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """(left, top, right, bottom) of two corners."""
    return F.struct(F.least(x1, x2).alias("left"), F.least(y1, y2).alias("top"), F.greatest(x1, x2).alias("right"), F.greatest(y1, y2).alias("bottom"))


def scaled_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column between 0 and 1 by its own least and largest value; constant columns, NaN and null give 0. One aggregate row is joined."""
    num = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    bounds = df.agg(*[f(num(c)).alias(f"_{n}{i}") for i, c in enumerate(columns) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    both = df.crossJoin(F.broadcast(bounds))
    one = lambda i, c: F.coalesce(F.when(F.col(f"_hi{i}") > F.col(f"_lo{i}"), (num(c) - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}"))), F.lit(0.0))
    return both.withColumns({c: one(i, c) for i, c in enumerate(columns)}).select(*df.columns)


def integer_scale(v: Column, top: Column, bits: int) -> Column:
    """v over its largest value on the scale of unsigned whole numbers of so many bits, cut off; 0 stays 0."""
    return F.floor(F.when(top != 0, v / top).otherwise(v) * (2**bits - 1)).cast("long")


def between_bits(v: Column, source: int, target: int) -> Column:
    """A level of ``source`` bits as one of ``target`` bits, rounded half to even."""
    return F.bround(v * ((2**target - 1) / (2**source - 1))).cast("long")


def cohort_within(name: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The group of the first rule (part, group) whose part is in ``name``, whatever the case of letters."""
    out = F.lit(other)
    for part, group in reversed(rules):
        out = F.when(F.upper(name).contains(part.upper()), group).otherwise(out)
    return out


def session_parts(name: Column) -> Column:
    """(date, id, channel, kind, number) of a session's name, parts joined by ``_``: date, id, channel if there are four parts, kind; or id and number; null for others."""
    p = F.split(name, "_")
    n = F.size(p)
    at = lambda i: F.try_element_at(p, F.lit(i))
    long = n.isin(3, 4)
    return F.when(
        long | (n == 2),
        F.struct(F.when(long, at(1)).alias("date"), F.when(long, at(2)).otherwise(at(1)).alias("id"), F.when(n == 4, at(3)).alias("channel"), F.when(long, at(-1)).alias("kind"), F.when(n == 2, at(2)).alias("number")),
    )


def normal_session(name: Column) -> Column:
    """``YYMMDD_cohort-subject_rest-of-it`` of a name cohort_..._subject[_Ctx...]_yyyyMMdd-HHmmss; one of three parts is taken to be normal already, one of fewer, or without a date, is null."""
    p = F.split(name, "_")
    n = F.size(p)
    day = F.date_format(F.try_to_timestamp(F.element_at(p, -1), F.lit("yyyyMMdd-HHmmss")), "yyMMdd")
    context = F.element_at(p, -2).contains("Ctx")
    subject = F.when(context, F.try_element_at(p, F.lit(-3))).otherwise(F.element_at(p, -2))
    rest = F.filter(p, lambda x: (x != F.element_at(p, -1)) & (x != F.element_at(p, 1)) & (x != subject))
    return F.when(n == 3, name).when(n > 3, F.concat(day, F.lit("_"), F.element_at(p, 1), F.lit("-"), subject, F.lit("_"), F.array_join(rest, "-")))


def needs_downsample(peaks: DataFrame, clock: DataFrame, k: list[str], o: str, times: float = 1.8) -> DataFrame:
    """(k, needed): whether the clock has over ``times`` as many samples as the place of the last peak (0 without one)."""
    last = peaks.groupBy(*k).agg(F.max(o).alias("_last"))
    return clock.groupBy(*k).agg(F.count("*").alias("_n")).join(last, k, "left").select(*k, (F.col("_n") > F.coalesce("_last", F.lit(0)) * times).alias("needed"))


def within_limit(df: DataFrame, v: str, limit: float) -> DataFrame:
    """Rows whose value stays under the limit in size."""
    return df.where(F.abs(v) < limit)


def without_large_columns(df: DataFrame, k: list[str], v: str, limit: float, out: str = "kept") -> DataFrame:
    """df with ``out``: v, or null in groups whose mean passes the limit."""
    mean = df.groupBy(*k).agg(F.avg(v).alias("_m"))
    return df.join(mean, k).withColumn(out, F.when(F.col("_m") <= limit, F.col(v))).drop("_m")


def _of_one(raw: Column) -> Column:
    """An array over its sum. Arrays of one element bind ``raw`` and the sum, so each is worked out once a row and not once an element."""
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, y: a + y)
    over = lambda r: F.transform(F.array(total(r)), lambda t: F.transform(r, lambda x: x / t))[0]
    return F.transform(F.array(raw), over)[0]


def gaussian_weights(window: Column) -> Column:
    """The weights of ``gaussian_kernel`` for a window that differs by row."""
    half, sigma = F.floor(window / 2), window / 2.355
    raw = F.transform(F.sequence(-half, half), lambda k: F.exp(-0.5 * F.pow(k / sigma, F.lit(2))))
    return _of_one(raw)


def decay_weights(tau: Column, tail: int = 6) -> Column:
    """The weights of ``decay_kernel`` for a time constant, a whole number, that differs by row."""
    raw = F.transform(F.sequence(F.lit(0), (tau * tail).cast("int") - 1), lambda x: F.exp(-x / tau))
    return _of_one(raw)
