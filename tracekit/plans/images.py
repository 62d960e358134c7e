"""Queries over pixel frames and footprints. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.operators import frames as P
from tracekit.operators import groups as G
from tracekit.plans import fixtures as V
from tracekit.plans.queries import query, rounded


def _reflect(i: str, n: int = 8) -> str:
    m = f"((({i}) % {2 * n - 2}) + {2 * n - 2}) % {2 * n - 2}"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 2} - {m} END"


def _square(square: list[list[float]], source: str = "pixels", value: str = "v") -> str:
    half = len(square) // 2
    rows = ", ".join(f"({a - half}, {b - half}, {float(x)!r}::DOUBLE)" for a, row in enumerate(square) for b, x in enumerate(row))
    return f"SELECT p.frame, p.y, p.x, sum(q.{value} * k.w) AS v FROM {source} p, (VALUES {rows}) AS k(dy, dx, w) JOIN {source} q ON q.frame = p.frame AND q.y = {_reflect('p.y + k.dy')} AND q.x = {_reflect('p.x + k.dx')} GROUP BY ALL"


def _medians(half: int) -> str:
    return f"SELECT p.frame, p.y, p.x, median(q.v) AS v FROM pixels p, unnest(range({-half}, {half + 1})) AS a(dy), unnest(range({-half}, {half + 1})) AS b(dx) JOIN pixels q ON q.frame = p.frame AND q.y = greatest(0, least(p.y + dy, 7)) AND q.x = greatest(0, least(p.x + dx, 7)) GROUP BY ALL"


_STILL = "#s AS (SELECT frame, y, x, CASE WHEN y < 1 OR y > 6 OR x < 2 THEN 0.5 ELSE v END AS v FROM pixels)"


@query("i6_static_border", V.over("pixels", body=_STILL + """, d AS (SELECT a.frame, a.y, a.x, abs(a.v - b.v) AS d FROM s a JOIN s b ON b.frame = a.frame + 1 AND b.y = a.y AND b.x = a.x), r AS (SELECT DISTINCT y FROM d GROUP BY
frame, y HAVING avg(d) = 0), c AS (SELECT DISTINCT x FROM d GROUP BY frame, x HAVING avg(d) = 0)
SELECT CAST(coalesce((SELECT max(y) FROM r WHERE y < 4) + 1, 0) AS BIGINT) AS top, CAST(coalesce((SELECT min(y) FROM r WHERE y >= 4), 8) - 1 AS BIGINT) AS bottom,
CAST(coalesce((SELECT max(x) FROM c WHERE x < 4) + 1, 0) AS BIGINT) AS "left", CAST(coalesce((SELECT min(x) FROM c WHERE x >= 4), 8) - 1 AS BIGINT) AS "right" """))
def i6(spark: SparkSession, sf: str) -> DataFrame:
    p = V.pixels(spark, sf).withColumn("v", F.when(F.expr("y < 1 or y > 6 or x < 2"), F.lit(0.5)).otherwise(F.col("v")))
    return P.static_border(p)


@query("i8_concat_stacks", V.over("pixels", body="SELECT frame AS frame, y, x, round(v, 6) AS v FROM pixels UNION ALL SELECT frame + (SELECT max(frame) + 1 FROM pixels), y, x, round(v, 6) FROM pixels"))
def i8(spark: SparkSession, sf: str) -> DataFrame:
    p = V.pixels(spark, sf)
    return rounded(P.concatenated([p, p]))


@query("i9_select_channel", V.over("matrix", body="SELECT entity AS frame, CAST(bin // 8 % 4 AS INT) AS y, CAST(bin % 8 AS INT) AS x, round(value, 6) AS v FROM matrix WHERE bin // 32 = 1 AND entity < 300"))
def i9(spark: SparkSession, sf: str) -> DataFrame:
    s = V.matrix(spark, sf).select(F.col("entity").alias("frame"), F.expr("cast(bin div 32 as int)").alias("channel"), F.expr("cast(bin div 8 % 4 as int)").alias("y"), (F.col("bin") % 8).cast("int").alias("x"), F.col("value").alias("v"))
    return rounded(P.channel(s, 1, 300))


@query("i10_high_pass", V.over("pixels", body="#f AS (" + _square(P.high_pass_square(2, 1.0)) + ") SELECT frame, y, x, round(v, 5) AS v FROM f"))
def i10(spark: SparkSession, sf: str) -> DataFrame:
    return P.filtered(V.pixels(spark, sf), P.high_pass_square(2, 1.0)).withColumn("v", F.round("v", 5))


@query("i10_difference_of_gaussians", V.over("pixels", body="#a AS (" + _square(P.gaussian_square(2, 0.8)) + "), b AS (" + _square(P.gaussian_square(2, 2.0)) + ") SELECT frame, y, x, round(a.v - b.v, 5) AS v FROM a JOIN b USING (frame, y, x)"))
def i10b(spark: SparkSession, sf: str) -> DataFrame:
    return P.difference_of_gaussians(V.pixels(spark, sf), 2, 0.8, 2.0).withColumn("v", F.round("v", 5))


@query("i11_median_blur", V.over("pixels", body="#m AS (" + _medians(1) + ") SELECT frame, y, x, round(v, 6) AS v FROM m"))
def i11(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.median_blurred(V.pixels(spark, sf)))


_G = P.gaussian_square(2, 1.0)


@query("i12_fix_outlier_pixels", V.over("pixels", body="#a AS (" + _square(_G) + "), q AS (SELECT frame, y, x, v * v AS v FROM pixels), b AS (" + _square(_G, "q") + "), m AS (" + _medians(2) + ") SELECT frame, y, x, round(CASE WHEN abs(p.v - a.v) > 1.5 * sqrt(greatest(b.v - a.v * a.v, 0)) THEN m.v ELSE p.v END, 5) AS v FROM pixels p JOIN a USING (frame, y, x) JOIN b USING (frame, y, x) JOIN m USING (frame, y, x)"))
def i12(spark: SparkSession, sf: str) -> DataFrame:
    return P.without_outliers(V.pixels(spark, sf), times=1.5).withColumn("v", F.round("v", 5))


@query("i14_residual", V.over("pixels", "traces", body="""#m AS (SELECT t.frame, y, x, sum(v * value) / 1000 AS v FROM pixels p JOIN traces t ON p.frame = t.entity WHERE v > 0.1 GROUP BY 1, 2, 3), r AS (SELECT p.frame, p.y, p.x,
p.v - coalesce(m.v, 0) AS v FROM pixels p LEFT JOIN m ON m.frame = p.frame AND m.y = p.y AND m.x = p.x) SELECT frame, y, x, round(v / (SELECT max(v) FROM r), 5) AS v FROM
r"""))
def i14(spark: SparkSession, sf: str) -> DataFrame:
    f = V.pixels(spark, sf).where("v > 0.1").select(F.col("frame").alias("entity"), "y", "x", F.col("v").alias("w"))
    model = G.reconstructed(f, V.traces(spark, sf)).withColumn("v", F.col("v") / 1000)
    return P.residual(V.pixels(spark, sf), model).withColumn("v", F.round("v", 5))


_BOX = """#p AS (SELECT frame AS entity, y, x FROM pixels WHERE v > 0.02), n AS (SELECT a.entity, a.y, a.x FROM p a JOIN p b ON a.entity = b.entity AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 4 GROUP BY ALL HAVING count(*) >= 6),
m AS (SELECT entity, median(y) AS cy, median(x) AS cx, min(y) AS a, max(y) AS b, min(x) AS c, max(x) AS d FROM n GROUP BY 1), s AS (SELECT *, 0.7 * least(cy - a, b - cy, cx - c, d - cx) AS size FROM m),
boxes AS (SELECT entity, round(cy, 5) AS cy, round(cx, 5) AS cx, round(size, 5) AS size, round(greatest(0, least(cy - size, 7)), 5) AS top, round(greatest(0, least(cy +
size, 7)), 5) AS bottom, round(greatest(0, least(cx - size, 7)), 5) AS "left", round(greatest(0, least(cx + size, 7)), 5) AS "right" FROM s)"""


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return V.pixels(spark, sf).select(F.col("frame").alias("entity"), "y", "x", F.when(F.col("v") > 0.02, F.col("v")).otherwise(0.0).alias("w"))


def _five(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 5).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


@query("i16_footprint_geometry", V.over("pixels", body=_BOX + " SELECT * FROM boxes"))
def i16(spark: SparkSession, sf: str) -> DataFrame:
    return _five(P.footprint_boxes(_prints(spark, sf), ["entity"], 8, 8, reach=2.0, least=6))


@query("i17_label_centroid", V.over("pixels", body=_BOX + " SELECT boxes.*, label AS class FROM boxes JOIN embeddings ON vec_id = entity WHERE label < 3"))
def i17(spark: SparkSession, sf: str) -> DataFrame:
    flags = V.table(spark, sf, "embeddings").where("label < 3").select(F.col("vec_id").alias("entity"), F.col("label").alias("class"))
    return _five(P.labelled_boxes(_prints(spark, sf), flags, ["entity"], 8, 8, reach=2.0, least=6))


@query("m17_footprint_features", V.over("pixels", body="""#w AS (SELECT frame AS entity, y, x, CASE WHEN v > 0.02 THEN v ELSE 0 END AS w FROM pixels), s AS (SELECT entity, sum(w) / 64 AS m, sqrt(greatest(sum(w * w) / 64 - pow(sum(w) / 64, 2), 0)) AS s, count(*) FILTER (w > 0) AS c FROM w GROUP BY 1),
k AS (SELECT w.*, c FROM w JOIN s USING (entity) WHERE w > m + 2 * s), g AS (SELECT entity, count(*) AS area, count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1))
AS extent, avg(w) AS mean, stddev_pop(w) AS sd, max(w) AS high, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(y, x) AS xy, any_value(c) AS c
FROM k GROUP BY 1),
e AS (SELECT k.entity, count(*) FILTER (n.entity IS NULL) AS perimeter FROM k, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS d(a, b) LEFT JOIN k n ON n.entity = k.entity AND n.y = k.y + a AND n.x = k.x + b GROUP BY 1),
q AS (SELECT *, (yy + xx) / 2 AS mid, sqrt(pow((yy - xx) / 2, 2) + pow(xy, 2)) AS half FROM g)
SELECT entity, area, round(extent, 5) AS extent, round(mean, 5) AS mean, round(sd, 5) AS sd, round(high, 5) AS high, round(cy, 5) AS cy, round(cx, 5) AS cx, round(1 - c /
64, 5) AS sparsity, round(c / 64, 5) AS filled, perimeter, round(CASE WHEN mid + half > 0 THEN sqrt(greatest(1 - (mid - half) / (mid + half), 0)) ELSE 0 END, 5) AS
eccentricity FROM q JOIN e USING (entity)"""))
def m17(spark: SparkSession, sf: str) -> DataFrame:
    return _five(P.footprint_features(_prints(spark, sf), ["entity"], 64))


@query("m17_first_region")
def m17b(spark: SparkSession, sf: str) -> DataFrame:
    """The first region and its solidity; hulls have no SQL, and are tested on drawn shapes."""
    return _five(P.region_features(_prints(spark, sf), ["entity"], 64))
