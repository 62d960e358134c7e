"""Queries over similarity, clusters, features and decoders. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.operators import curves as C
from tracekit.operators import models as M
from tracekit.operators import peaks as P
from tracekit.operators import spectral as E
from tracekit.plans import fixtures as V
from tracekit.plans.queries import query, rounded


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "embeddings")


_COSINE = """WITH m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS cosine FROM m
a JOIN m b ON a.vec_id < b.vec_id), l AS (SELECT min(cosine) AS lo, max(cosine) AS hi FROM c), s AS (SELECT a, b, CASE WHEN lo < 0 THEN (cosine + 1) / 2 ELSE cosine END /
greatest(CASE WHEN lo < 0 THEN (hi + 1) / 2 ELSE hi END, 1) AS s FROM c, l)"""


def _scaled(v: DataFrame, both: bool = False) -> DataFrame:
    return M.scaled_similarity(M.cosine_pairs(v, "vec_id", "embedding", both=both), M.cosine_bounds(v, "vec_id", "embedding", beside=True))


@query("m1_scaled_similarity", _COSINE + " SELECT a, b, round(s, 5) AS similarity FROM s")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(_vectors(spark, sf)).select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("m1_similar_pairs", _COSINE + " SELECT a, b, round(cosine, 5) AS cosine FROM c WHERE cosine >= 0.35")
def m1b(spark: SparkSession, sf: str) -> DataFrame:
    return M.cosine_pairs(_vectors(spark, sf), "vec_id", "embedding", least=0.35).withColumn("cosine", F.round("cosine", 5))


@query("m2_distances", _COSINE + " SELECT a, b, round(1 - s, 5) AS distance FROM s UNION ALL SELECT b, a, round(1 - s, 5) FROM s UNION ALL SELECT vec_id, vec_id, 0.0::DOUBLE FROM m")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    s = _scaled(_vectors(spark, sf), both=True)
    return M.distances(s, _vectors(spark, sf), "vec_id", both=True).withColumn("distance", F.round("distance", 5))


@query("m3_spectral_clusters")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    """Eigenvectors have no SQL; tested against numpy's. The similarity of all pairs, of which none is made, and how well the clusters match the labels."""
    v = _vectors(spark, sf)
    ends = M.cosine_bounds(v, "vec_id", "embedding").first()
    told = E.cosine_clusters(v, "vec_id", "embedding", 0.0 if ends[0] is None else ends[0], 0.0 if ends[1] is None else ends[1], 10, rounds=25)
    out, accuracy = M.match_labels(told.join(v.select(F.col("vec_id").alias("id"), "label"), "id"), "label", "cluster")
    return out.select("id", "cluster", "label", "matched", F.lit(round(accuracy, 6)).alias("accuracy"))


@query("m4_kmeans")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    """Starts are drawn, so no SQL; tested on points apart."""
    return M.kmeans(_vectors(spark, sf), "vec_id", "embedding", 10)


_PERMS = "(VALUES ('A', 'N', 'R'), ('A', 'R', 'N'), ('N', 'A', 'R'), ('N', 'R', 'A'), ('R', 'A', 'N'), ('R', 'N', 'A'))"


@query("m5_match_labels", f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag AS y, CASE WHEN l_linestatus = 'O' THEN 0 WHEN l_quantity > 25 THEN 1 ELSE 2 END AS c FROM lineitem), n AS
(SELECT y, c, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT *, row_number() OVER () AS k FROM {_PERMS} AS v(c0, c1, c2)), s AS (SELECT k, sum(n) AS t FROM p JOIN n ON
y = CASE c WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END GROUP BY k), w AS (SELECT * FROM p JOIN s USING (k) ORDER BY t DESC, k LIMIT 1) SELECT l_orderkey, l_linenumber, CASE
c WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS matched, round(t / (SELECT count(*) FROM b), 6) AS accuracy FROM b, w""")
def m5(spark: SparkSession, sf: str) -> DataFrame:
    c = F.expr("case when l_linestatus = 'O' then 0 when l_quantity > 25 then 1 else 2 end")
    out, accuracy = M.match_labels(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("y"), c.alias("c")), "y", "c")
    return out.select("l_orderkey", "l_linenumber", "matched", F.lit(round(accuracy, 6)).alias("accuracy"))


@query("m7_projection_weights")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares has no SQL; tested against numpy."""
    v = _vectors(spark, sf)
    w = M.projection_weights(v, "vec_id", "embedding", _means(v), "label")
    return w.select("vec_id", F.posexplode(F.transform("weights", lambda x: F.round(x, 5))).alias("pos", "weight"))


def _means(v: DataFrame) -> DataFrame:
    each = v.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding"))


@query("m8_curve_products", V.over("matrix", body="#c AS (SELECT class, bin, avg(value) FILTER (entity % 2 = 0) AS p, avg(value) FILTER (entity % 2 = 1) AS q FROM matrix GROUP BY ALL) SELECT class, bin, round(p - q, 6) AS diff, round(p * q, 6) AS product FROM c WHERE p IS NOT NULL AND q IS NOT NULL"))
def m8(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda k: V.matrix(spark, sf).where(F.col("entity") % 2 == k).groupBy("class", "bin").agg(F.avg("value").alias("v"))
    return rounded(C.curve_products(part(0), part(1), "class", "bin", "v"))


@query("m9_location_features", V.over("matrix", body="#w AS (SELECT *, CASE WHEN bin BETWEEN 10 AND 30 THEN 'early' WHEN bin BETWEEN 40 AND 60 THEN 'late' END AS \"window\" FROM matrix) SELECT entity, \"window\", round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, round(max(value), 6) AS high, round(min(value), 6) AS low, CAST(arg_min(bin, struct_pack(a := -value, b := bin)) AS INT) AS high_at, CAST(arg_min(bin, struct_pack(a := value, b := bin)) AS INT) AS low_at, round((max(value) - abs(min(value))) / nullif(max(value) + abs(min(value)), 0), 6) AS balance FROM w WHERE \"window\" IS NOT NULL GROUP BY 1, 2"))
def m9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.location_features(V.matrix(spark, sf).withColumn("bin", F.col("bin").cast("int")), ["entity"], "bin", "value", {"early": (10, 30), "late": (40, 60)}))


@query("m10_trial_features", V.over("traces", body="""#e AS (SELECT entity, frame AS f0, frame // 20 * 20 AS start, row_number() OVER (PARTITION BY entity ORDER BY frame) AS trial FROM traces WHERE value > 120),
w AS (SELECT e.*, t.frame, value FROM e JOIN traces t ON t.entity = e.entity AND t.frame >= f0 - 5 AND t.frame < f0 + 10) SELECT entity, trial, round(max(value) FILTER
(frame >= f0) - avg(value) FILTER (frame < f0), 6) AS rise, arg_min(frame, struct_pack(a := -value, b := frame)) FILTER (frame >= f0) - start AS top_at FROM w GROUP BY
entity, trial, start HAVING count(*) = 15"""))
def m10(spark: SparkSession, sf: str) -> DataFrame:
    from tracekit.operators import windows as W

    t = V.traces(spark, sf).withColumn("frame", F.col("frame").cast("long"))
    e = W.numbered(t.where("value > 120"), ["entity"], ["frame"], "n").select("entity", (F.col("n") + 1).alias("trial"), F.col("frame").alias("at"), (F.expr("frame div 20") * 20).alias("start"))
    return rounded(M.trial_features(t, e, ["entity"], "trial", "frame", "value", "at", "start", 5, 10))


_FOLDS = "h AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, CAST('0x' || substr(md5('5-' || vec_id), 1, 8) AS BIGINT) AS h FROM embeddings), f AS (SELECT vec_id, label, e, CAST((row_number() OVER (PARTITION BY label ORDER BY h, vec_id) - 1) % 5 AS INT) AS fold FROM h)"


@query("m11_decode_nearest", f"""WITH {_FOLDS}, s AS (SELECT a.vec_id, a.label, a.fold, b.label AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC,
b.vec_id) AS k FROM f a JOIN f b ON a.fold <> b.fold), v AS (SELECT vec_id, label, fold, y, count(*) AS c FROM s WHERE k <= 5 GROUP BY ALL), p AS (SELECT *, row_number()
OVER (PARTITION BY vec_id ORDER BY c DESC, y) AS k FROM v) SELECT fold, count(*) AS n, round(avg(CASE WHEN y = label THEN 1.0 ELSE 0 END), 6) AS accuracy,
round(median(abs(y - label)), 6) AS error FROM p WHERE k = 1 GROUP BY fold""")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.cross_validated(_vectors(spark, sf), "vec_id", "label", "embedding", 5, "nearest")).withColumn("error", F.col("error").cast("double"))


_BAYES = f"""WITH {_FOLDS}, x AS (SELECT vec_id, label, fold, u.i AS i, e[u.i + 1] AS v FROM f, unnest(range(64)) AS u(i)), t AS (SELECT g.fold, x.label, i, avg(v) AS m, var_pop(v) AS
s FROM x JOIN (SELECT DISTINCT fold FROM f) g ON x.fold <> g.fold GROUP BY ALL),
n AS (SELECT g.fold, label, count(*) AS c FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY ALL), l AS (SELECT x.vec_id, x.label AS y, x.fold,
t.label, sum(-0.5 * ln(2 * pi() * s) - pow(v - m, 2) / (2 * s)) + ln(any_value(c)) AS ll FROM x JOIN t ON t.fold = x.fold AND t.i = x.i JOIN n ON n.fold = x.fold AND
n.label = t.label GROUP BY 1, 2, 3, 4),
p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC) AS k FROM l) SELECT fold, count(*) AS n, round(avg(CASE WHEN label = y THEN 1.0 ELSE 0 END), 6)
AS accuracy, round(median(abs(label - y)), 6) AS error FROM p WHERE k = 1 GROUP BY fold"""


@query("m11_decode_bayes", _BAYES)
def m11b(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.cross_validated(_vectors(spark, sf), "vec_id", "label", "embedding", 5, "bayes")).withColumn("error", F.col("error").cast("double"))


@query("m12_grid_search")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty values of C of the kernel decoder by their best fold; the machine has no SQL, and is tested against numpy."""
    return rounded(M.grid_search(_vectors(spark, sf), "vec_id", "label", "embedding", [10 ** (-3 + 6 * i / 29) for i in range(30)], 10))


@query("m12_grid_search_nearest")
def m12b(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of neighbours by their best fold; the folds and the decoder have SQL of their own."""
    return rounded(M.grid_search(_vectors(spark, sf), "vec_id", "label", "embedding", [1, 3, 9], 3, "nearest", "neighbours"))


@query("m11_decode_kernel")
def m11c(spark: SparkSession, sf: str) -> DataFrame:
    """Ten folds of the radial machine; tested against numpy and on two rings."""
    return rounded(M.cross_validated(_vectors(spark, sf), "vec_id", "label", "embedding", 10, "kernel"))


@query("m11_decode_linear")
def m11d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.cross_validated(_vectors(spark, sf), "vec_id", "label", "embedding", 10, "linear"))


@query("h9_permuted_accuracy")
def h9(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy by chance; tested to lie about that of guessing."""
    return rounded(M.permuted_accuracy(_vectors(spark, sf), "vec_id", "label", "embedding", 10, 10, "kernel"))


@query("m13_accuracy", "WITH b AS (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS p FROM lineitem) SELECT count(*) AS n, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0 END), 6) AS accuracy FROM b")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    told = F.expr("case when l_linestatus = 'O' then 'N' when l_quantity > 25 then 'A' else 'R' end")
    return rounded(C.accuracy(V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("t"), told.alias("p")), "t", "p"))


@query("m14_project_pca")
def m14(spark: SparkSession, sf: str) -> DataFrame:
    """Components have no sign, so no SQL; tested against numpy."""
    v = _vectors(spark, sf).select("vec_id", "label", "embedding")
    a, b = M.project_pca(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "embedding")
    return a.union(b).select("vec_id", F.round(F.abs(F.element_at("projected", 1)), 4).alias("x"), F.round(F.abs(F.element_at("projected", 2)), 4).alias("y"))


@query("m14_cross_cosine", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.label, count(DISTINCT a.vec_id) AS a_rows, count(DISTINCT b.vec_id) AS b_rows,
round(avg(list_cosine_similarity(a.e, b.e)), 6) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE a.label < 4 GROUP BY
a.label""")
def m14b(spark: SparkSession, sf: str) -> DataFrame:
    """Four labels, each half of its vectors against the other."""
    v = _vectors(spark, sf)
    of = lambda y, half: v.where((F.col("label") == y) & (F.col("vec_id") % 2 == half))
    told = [M.cross_cosine(of(y, 0), of(y, 1), "embedding").select(F.lit(y).alias("label"), "*") for y in range(4)]
    return rounded(told[0].union(told[1]).union(told[2]).union(told[3])).withColumn("label", F.col("label").cast(v.schema["label"].dataType))


@query("m15_temporal_features", V.over("traces", body="""#b AS (SELECT entity, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1,
quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.1) AS baseline, kurtosis_pop(value) AS kurtosis, max(value) AS hi, min(value) AS lo FROM traces GROUP BY 1),
m AS (SELECT entity, avg(pow(value - mean, 3)) / pow(any_value(sd), 3) AS skewness, avg(CASE WHEN value > mean + sd THEN 1.0 ELSE 0 END) AS active FROM traces JOIN b
USING (entity) GROUP BY 1), g AS (SELECT entity, coalesce(corr(value, n), 0) AS lag1 FROM (SELECT *, lead(value) OVER (PARTITION BY entity ORDER BY frame) AS n FROM
traces) GROUP BY 1),
p AS (SELECT entity, count(*) AS peaks, avg(value) AS height, avg(gap) AS gap, stddev_pop(gap) AS gap_sd FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY entity
ORDER BY frame) AS gap FROM (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM traces WINDOW w AS (PARTITION BY entity ORDER BY frame)) WHERE value >= 100
AND value > l AND value > r) GROUP BY 1)
SELECT entity, b.n AS n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(median, 5) AS median, round(q3 - q1, 5) AS iqr, round(baseline, 5) AS baseline, round(skewness,
5) AS skewness, round(kurtosis, 5) AS kurtosis, round(active, 5) AS active, round(lag1, 5) AS lag1, coalesce(peaks, 0) AS peaks, round(height, 5) AS height, round(gap, 5)
AS gap, round(gap_sd, 5) AS gap_sd, round(hi - lo, 5) AS range, round(CASE WHEN sd > 0 THEN (hi - median) / sd END, 5) AS over_noise, round(coalesce(peaks, 0) / (b.n /
10.0), 5) AS frequency
FROM b JOIN m USING (entity) JOIN g USING (entity) LEFT JOIN p USING (entity)"""))
def m15(spark: SparkSession, sf: str) -> DataFrame:
    t = V.traces(spark, sf).withColumn("frame", F.col("frame").cast("int"))
    peaks = P.find_peaks(t, ["entity"], "frame", "value", 100, 1, None)
    out = M.temporal_features(t, peaks, ["entity"], "frame", "value", 10.0).drop("q1", "q3")
    return out.select(*[F.round(c, 5).alias(c) if d == "double" else F.col(c) for c, d in out.dtypes])


@query("m16_spectral_features", V.over("traces", body="""#n AS (SELECT entity, frame AS i, value AS v, count(*) OVER (PARTITION BY entity) AS n, avg(value) OVER (PARTITION BY entity) AS m FROM traces),
a AS (SELECT entity, n, f, pow(sum((v - m) * cos(2 * pi() * ((f * i) % n) / n)), 2) + pow(sum((v - m) * sin(2 * pi() * ((f * i) % n) / n)), 2) AS p FROM n, LATERAL
(SELECT unnest(range(1, greatest(n // 2, 1) + 1)) AS f) GROUP BY 1, 2, 3), d AS (SELECT entity, f * 10.0 / n AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY
entity ORDER BY round(p, 6) DESC, f) AS k FROM a) WHERE k = 1),
l AS (SELECT *, least(n, 16) AS l, greatest(least(n, 16) // 2, 1) AS h FROM n), s AS (SELECT entity, l, s, i - s * h AS j, v FROM l, LATERAL (SELECT unnest(range(0, (n -
l) // h + 1)) AS s) WHERE i >= s * h AND i < s * h + l), x AS (SELECT *, (v - avg(v) OVER (PARTITION BY entity, s)) * (0.5 - 0.5 * cos(2 * pi() * j / l)) AS x FROM s),
p AS (SELECT entity, s, l, f, pow(sum(x * cos(2 * pi() * ((f * j) % l) / l)), 2) + pow(sum(x * sin(2 * pi() * ((f * j) % l) / l)), 2) AS p FROM x, LATERAL (SELECT
unnest(range(0, l // 2 + 1)) AS f) GROUP BY 1, 2, 3, 4), w AS (SELECT entity, l, f, avg(p) * CASE WHEN f = 0 OR f * 2 = l THEN 1 ELSE 2 END AS p FROM p GROUP BY 1, 2, 3),
r AS (SELECT entity, sum(p) FILTER (f * 10.0 / l <= 2) AS lo, sum(p) FILTER (f * 10.0 / l > 2) AS hi FROM w GROUP BY 1) SELECT entity, round(dominant, 5) AS dominant,
round(CASE WHEN lo > 0 AND hi > 0 THEN 10 * log10(lo / hi) END, 4) AS snr FROM d JOIN r USING (entity)"""))
def m16(spark: SparkSession, sf: str) -> DataFrame:
    out = E.spectral_features(V.traces(spark, sf), ["entity"], "frame", "value", 10.0, 2.0, 16)
    return out.select("entity", F.round("dominant", 5).alias("dominant"), F.round("snr", 4).alias("snr"))


@query("m25_feature_vectors", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, round(l_quantity, 6) AS f0, round(l_discount, 6) AS f1, 0.0::DOUBLE AS f2 FROM lineitem")
def m25(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.lit(float("nan")).alias("gap"), (F.col("l_returnflag") == "R").alias("y"))
    out = M.feature_vectors([li.where("l_linenumber % 2 = 0"), li.where("l_linenumber % 2 = 1").drop("gap").withColumn("gap", F.lit(None).cast("double"))], ["l_quantity", "l_discount", "gap"], "y")
    return rounded(out.select("l_orderkey", "l_linenumber", "label", *[F.element_at("features", k + 1).alias(f"f{k}") for k in range(3)]))


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "documents").select("doc_id", F.array(F.log1p("n_chars"), F.log1p(F.length("text")), F.regexp_count("text", F.lit("[.]")) / (F.length("text") + 1.0)).alias("x"))
    return d.join(V.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").where("x[1] is not null")


@query("m21_train_scorer")
def m21(spark: SparkSession, sf: str) -> DataFrame:
    """Folds of a weighted regression; the fit has no SQL, the metrics have their own."""
    return rounded(M.best_fold_scorer(_quality(spark, sf), "doc_id", "x", "quality", 2, [0.3, 0.5, 0.65])[1])


@query("m21_train_network")
def m21b(spark: SparkSession, sf: str) -> DataFrame:
    """Folds of the network, each with its own threshold; the fit has no SQL, its slopes and its early stop are tested."""
    return rounded(M.best_fold_scorer(_quality(spark, sf), "doc_id", "x", "quality", 2, [0.3, 0.5, 0.65], "network")[1])


@query("m22_score_new")
def m22(spark: SparkSession, sf: str) -> DataFrame:
    q = _quality(spark, sf)
    model = M.train_scorer(q.where("doc_id % 2 = 0"), "x", "quality")
    return rounded(M.score_new(model, q.where("doc_id % 2 = 1"), "x").select("doc_id", "score", "accepted"))


@query("m23_model_registry", f"WITH k AS ({_BAYES}) SELECT 'bayes' AS model, 64 AS size, round(avg(accuracy), 5) AS accuracy_mean, round(stddev_pop(accuracy), 5) AS accuracy_sd, round(avg(error), 5) AS error_mean, round(stddev_pop(error), 5) AS error_sd FROM k")
def m23(spark: SparkSession, sf: str) -> DataFrame:
    out = M.registered(m11b(spark, sf), {"model": "bayes", "size": 64}, ["accuracy", "error"])
    return out.select(*[F.round(c, 5).alias(c) if d == "double" else F.col(c) for c, d in out.dtypes])


