"""Queries of clustering, its validity, classification and its metrics, over embeddings, labels and the analysis view."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.columns import local_hour, portable_hash, portable_hash_sql
from sensorloom.operators import classify, cluster, cohort, features
from sensorloom.plans.registering import register
from sensorloom.plans.views import ANALYSIS, LABEL3, analysis, label3, offset, readings
from sensorloom.session import table, written

QUERIES, SQL = {}, {}
query = register(QUERIES, SQL)

#: Fixed value: components of a vector of the given table, for SQL that names each of them.
WIDTH = 64
DIMS = [f"x{k}" for k in range(WIDTH)]
V = "WITH v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS x{k}" for k in range(WIDTH)) + " FROM embeddings)"


def _each(pattern: str, joint: str = ", ") -> str:
    """The pattern for every component, ``#`` standing for its number."""
    return joint.join(pattern.replace("#", str(k)) for k in range(WIDTH))


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The vectors with all components of their arrays, and the columns of these."""
    d = table(spark, sf_dir, "embeddings")
    dims = [f"x{k}" for k in range(d.agg(F.max(F.size("embedding"))).head()[0] or 0)]
    return d.select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(dims))), dims


def _centre(c: int, k: int) -> float:
    """Component k of a fixed centre c."""
    return 0.1 * c * ((k % (c + 1)) - c / 2) if c else 0.0


_DIST = [" + ".join(f"(x{k} - ({_centre(c, k)})) * (x{k} - ({_centre(c, k)}))" for k in range(WIDTH)) for c in range(3)]


@query(f"{V}, d AS (SELECT vec_id, {', '.join(f'{x} AS d{k}' for k, x in enumerate(_DIST))} FROM v) SELECT vec_id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM d")
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, dims = _whole(spark, sf_dir)
    return cluster.assign(d, dims, [[_centre(c, k) for k in range(len(dims))] for c in range(3)]).select("vec_id", "cluster")


_FEATURES = f"WITH r AS (SELECT user_id AS pid, 45 + value AS g FROM events), f AS (SELECT pid, count(*) FILTER (g < 70) AS lows, count(*) FILTER (g > 140) AS spikes, {LABEL3} AS c FROM r GROUP BY pid)"


@query(f"""{_FEATURES}, m AS (SELECT c, median(lows) AS l, median(spikes) AS h FROM f GROUP BY 1), a AS (SELECT *, row_number() OVER (ORDER BY l DESC, c) AS ra FROM m), b AS (SELECT *, row_number() OVER (ORDER BY h DESC, c) AS rb FROM a WHERE ra > 1)
SELECT c, 'Hypo-Prone' AS name FROM a WHERE ra = 1 UNION ALL SELECT c, CASE WHEN rb = 1 THEN 'Spiker' ELSE 'Stable' END FROM b""")
def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readings(spark, sf_dir).groupBy("pid").agg(F.count_if(F.col("g") < 70).alias("lows"), F.count_if(F.col("g") > 140).alias("spikes")).withColumn("c", label3())
    return cluster.name_clusters(d, "c", "lows", "spikes")


@query(f"""{V}, c AS (SELECT label, count(*) AS n, {_each('avg(x#) AS m#')} FROM v GROUP BY 1), g AS (SELECT {_each('avg(x#) AS g#')}, count(*) AS nn FROM v),
w AS (SELECT v.label, {_each('(x# - m#) ** 2', ' + ')} AS d2 FROM v JOIN c USING (label)), s AS (SELECT label, sum(d2) AS w, avg(sqrt(d2)) AS s FROM w GROUP BY 1),
b AS (SELECT sum(n * ({_each('(m# - g#) ** 2', ' + ')})) AS between_ss, count(*) AS k FROM c, g),
p AS (SELECT a.label, max((sa.s + sb.s) / sqrt({_each('(a.m# - b.m#) ** 2', ' + ')})) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1)
SELECT nn AS n, round(between_ss / (k - 1) / ((SELECT sum(w) FROM s) / (nn - k)), 6) AS calinski_harabasz, round((SELECT avg(r) FROM p), 6) AS davies_bouldin FROM b, g""")
def dispersion_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dispersion_indices(*_whole(spark, sf_dir), "label")


_GAP = _each("(a.x# - b.x#) ** 2", " + ")


@query(f"""{V}, d AS (SELECT a.vec_id, a.label, b.label AS other, sum(sqrt({_GAP})) AS t, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(t / nullif(n - 1, 0)) FILTER (label = other) AS a, min(t / n) FILTER (label <> other) AS b FROM d GROUP BY 1, 2)
SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s""")
def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, dims = _whole(spark, sf_dir)
    return cluster.silhouettes(d, "vec_id", dims, "label")


@query(f"""{V}, d AS (SELECT a.vec_id, a.label, b.label AS other, sum({_GAP}) AS t, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(t / nullif(n - 1, 0)) FILTER (label = other) AS a, min(t / n) FILTER (label <> other) AS b FROM d GROUP BY 1, 2)
SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def squared_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.squared_silhouette(*_whole(spark, sf_dir), "label")


_ARI = """c AS (SELECT a, b, count(*) AS c FROM l GROUP BY 1, 2), ij AS (SELECT sum(c * (c - 1) / 2) AS v, sum(c) AS n FROM c), i AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(c) AS m FROM c GROUP BY a)), j AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(c) AS m FROM c GROUP BY b))
SELECT ij.n::BIGINT AS n, round((ij.v - i.v * j.v / (ij.n * (ij.n - 1) / 2)) / ((i.v + j.v) / 2 - i.v * j.v / (ij.n * (ij.n - 1) / 2)), 6) AS ari FROM ij, i, j"""
#: A second labeling: whether most components are positive.
_MOST = "CASE WHEN len(list_filter(embedding, lambda x: x > 0)) * 2 > len(embedding) THEN 1 ELSE 0 END"


def _signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings")
    return d.select("label", (F.size(F.filter("embedding", lambda x: x > 0)) * 2 > F.size("embedding")).cast("int").alias("most"))


@query(f"WITH l AS (SELECT label AS a, {_MOST} AS b FROM embeddings), {_ARI}")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.adjusted_rand(_signs(spark, sf_dir), "label", "most")


@query(f"WITH l AS (SELECT label % 3 AS a, CASE WHEN {_MOST} = 1 THEN label % 3 ELSE label % 2 END AS b FROM embeddings) SELECT a, b, count(*) AS n, count(*) FILTER (a <> b) AS n_changed FROM l GROUP BY 1, 2")
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _signs(spark, sf_dir).select((F.col("label") % 3).alias("a"), F.when(F.col("most") == 1, F.col("label") % 3).otherwise(F.col("label") % 2).alias("b"))
    return d.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"))


#: What cohorts are clustered on; all but the number of readings.
FEATURES = [
    "mean_glucose", "glucose_sd", "glucose_cv", "pct_above_140", "pct_above_180", "pct_below_70", "pct_below_54", "n_lows_70", "n_lows_54",
    "avg_rise_rate", "avg_fall_rate", "n_spikes_140", "n_reactive_events", "noct_nadir", "noct_tbr70",
]


def cohort_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written row for each participant with enough readings: the features as doubles; nights may be missing."""
    r = readings(spark, sf_dir)
    night = features.nocturnal_features(r, local_hour(F.col("ts"), offset())).select("pid", "noct_nadir", "noct_tbr70")
    d = features.core_features(r).join(night, "pid", "left")
    return written(d.select("pid", *(F.col(c).cast("double").alias(c) for c in FEATURES)), "cohort")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The features with medians for what is missing, and their standard scores."""
    raw = cohort.fill_medians(cohort_features(spark, sf_dir), FEATURES)
    return raw, cohort.standard_scores(raw, FEATURES)


@query()
def kmeans_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, z = _scored(spark, sf_dir)
    labels = cluster.assign(z, FEATURES, cluster.fit_centres(z, "pid", FEATURES, 3)[0]).select("pid", "cluster")
    named = labels.join(raw.select("pid", "n_lows_70", "n_spikes_140"), "pid")
    return labels.join(F.broadcast(cluster.name_clusters(named, "cluster", "n_lows_70", "n_spikes_140")), "cluster").select("pid", "name")


@query()
def selection_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, z = _scored(spark, sf_dir)
    both = z.join(raw.select("pid", F.col("n_lows_70").alias("lows"), F.col("n_spikes_140").alias("spikes"), F.col("mean_glucose").alias("level")), "pid")
    return cluster.selection_sweep(both, "pid", FEATURES, range(2, 9), medians=("lows", "spikes", "level"))


@query()
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.interval(cluster.stability(_scored(spark, sf_dir)[1], "pid", FEATURES, 3), "kind", "ari")


REPS = 999


@query(f"""{V}, o AS (SELECT vec_id, label, run, row_number() OVER (PARTITION BY run ORDER BY h // 10000, h, vec_id) AS place FROM (SELECT vec_id, label, run, {portable_hash_sql('vec_id', 'run')} AS h FROM v, (SELECT unnest(range({REPS})) AS run))),
e AS (SELECT label, sum(count(*)) OVER (ORDER BY label) AS last, sum(count(*)) OVER (ORDER BY label) - count(*) AS before FROM v GROUP BY label),
l AS (SELECT run, vec_id, e.label AS label FROM o JOIN e ON place > before AND place <= last UNION ALL SELECT -1, vec_id, label FROM v),
d AS (SELECT l.run, l.label, v.vec_id, {_each('x#')}, {_each('x# * x#', ' + ')} AS q FROM l JOIN v USING (vec_id)),
s AS (SELECT run, label, count(*) AS n, sum(q) AS q, {_each('sum(x#) AS s#')} FROM d GROUP BY 1, 2),
t AS (SELECT d.run, d.vec_id, d.label, s.label AS other, s.n, s.n * d.q + s.q - 2 * ({_each('x# * s#', ' + ')}) AS t FROM d JOIN s ON d.run = s.run),
m AS (SELECT run, vec_id, max(t / greatest(n - 1, 1)) FILTER (label = other) AS a, max(n) FILTER (label = other) AS n, min(t / n) FILTER (label <> other) AS b FROM t GROUP BY 1, 2),
r AS (SELECT run, avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM m GROUP BY 1)
SELECT run::INT AS run, round(silhouette, 6) AS silhouette, round((SELECT count(*) FILTER (silhouette >= (SELECT silhouette FROM r WHERE run = -1)) / count(*) FROM r), 6) AS p FROM r""")
def label_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, dims = _whole(spark, sf_dir)
    return cluster.permutation_null(d, "vec_id", dims, "label", REPS)


@query()
def shuffle_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.shuffle_null(_scored(spark, sf_dir)[1], "pid", FEATURES, 3)


@query()
def copula_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.copula_null(_scored(spark, sf_dir)[1], "pid", FEATURES, 3, 1_000)


@query()
def copula_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, dims = _whole(spark, sf_dir)
    draws = cluster.gaussian_copula_draws(d, "vec_id", dims, 2)
    return draws.groupBy("rep").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in dims))


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, dims = _whole(spark, sf_dir)
    z = cohort.standard_scores(d, dims)
    return cluster.principal_components(z, "vec_id", dims, "x0")[1]


@query()
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top loadings of each component, and the components' medians and spread in each cohort."""
    raw, z = _scored(spark, sf_dir)
    scores, loadings = cluster.principal_components(z, "pid", FEATURES, "mean_glucose")
    top = cluster.top_loadings(loadings).select(F.lit("loading").alias("kind"), F.col("pc").cast("string").alias("of"), "variable", F.col("loading").alias("value"), F.col("explained").alias("other"))
    groups = cluster.quartiles(scores.withColumn("c", label3()), "c", ["pc1", "pc2"])
    return top.unionByName(groups.select(F.lit("group").alias("kind"), F.col("c").cast("string").alias("of"), "variable", F.col("median").alias("value"), F.col("iqr").alias("other")))


@query()
def frozen_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the participants outside of class 2, with their scaler and names as tables, applied to those in it."""
    d = cohort_features(spark, sf_dir).withColumn("c", label3())
    scaler, centres = (written(t, "frozen") for t in cluster.frozen(d.where("c <> 2"), "pid", FEATURES, 3, "n_lows_70", "n_spikes_140"))
    return cluster.projected(d.where("c = 2"), "pid", scaler, centres)


_BY = f"SELECT pid, {LABEL3} AS c, pid % 2 AS half, g FROM (SELECT user_id AS pid, 45 + value AS g FROM events)"


@query(f"""WITH f AS (SELECT pid, c, half, avg(g) AS mean_glucose, stddev_pop(g) AS glucose_sd, count(*) FILTER (g < 70)::DOUBLE AS n_lows_70, count(*) FILTER (g > 140)::DOUBLE AS n_spikes_140 FROM ({_BY}) GROUP BY 1, 2, 3),
l AS (UNPIVOT f ON mean_glucose, glucose_sd, n_lows_70, n_spikes_140 INTO NAME variable VALUE v),
m AS (SELECT c, variable, half, median(v) AS m, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT a.c, a.variable, a.n AS n_first, b.n AS n_second, round(a.m, 6) AS first, round(b.m, 6) AS second, round(b.m - a.m, 6) AS gap FROM m a JOIN m b ON a.c = b.c AND a.variable = b.variable AND a.half = 0 AND b.half = 1""")
def cohort_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of each class's features in two cohorts, side by side."""
    g = F.col("g")
    f = readings(spark, sf_dir).groupBy("pid").agg(F.avg(g).alias("mean_glucose"), F.stddev_pop(g).alias("glucose_sd"), F.count_if(g < 70).cast("double").alias("n_lows_70"), F.count_if(g > 140).cast("double").alias("n_spikes_140"))
    f = f.withColumns({"c": label3(), "half": F.pmod("pid", F.lit(2))})
    return cohort.matched_medians(f.where("half = 0"), f.where("half = 1"), "c", ["mean_glucose", "glucose_sd", "n_lows_70", "n_spikes_140"])


@query("""WITH f AS (SELECT user_id AS pid, event_id % 2 AS part, avg(value) AS level, stddev_pop(value) AS spread, max(value) AS peak FROM events GROUP BY 1, 2),
l AS (UNPIVOT f ON level, spread, peak INTO NAME variable VALUE v), p AS (SELECT a.variable, a.v AS x, b.v AS y FROM l a JOIN l b ON a.pid = b.pid AND a.variable = b.variable AND a.part = 0 AND b.part = 1),
r AS (SELECT variable, count(*) AS n, corr(x, y) AS r, median(abs(x - y)) AS mad FROM p GROUP BY 1)
SELECT variable, n, round(r, 6) AS r, round(mad, 6) AS mad, r = (SELECT min(r) FROM r) AS least FROM r""")
def extractor_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractors of the same features (here over readings of even and odd number): agreement of each, and the least."""
    f = lambda part: readings(spark, sf_dir).where(F.col("rid") % 2 == part).groupBy("pid").agg(F.avg(F.col("g") - 45).alias("level"), F.stddev_pop(F.col("g") - 45).alias("spread"), F.max(F.col("g") - 45).alias("peak"))
    return cohort.agreement(f(0), f(1), "pid", ["level", "spread", "peak"])


_FOLD = f"""WITH l AS (SELECT doc_id, toxic, rep, {portable_hash_sql('doc_id', 'rep')} AS h FROM labels, (SELECT unnest([0, 1]) AS rep)),
f AS (SELECT doc_id, toxic, rep, ((row_number() OVER (PARTITION BY rep, toxic ORDER BY h // 10000, h, doc_id) - 1) % 5)::INT AS fold FROM l)"""


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 5, 2)


@query(f"{_FOLD} SELECT doc_id, toxic, rep, fold FROM f")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir).select("doc_id", "toxic", "rep", "fold")


@query(f"""{_FOLD}, x AS (SELECT f.*, d.n_chars::DOUBLE AS n FROM f JOIN documents d USING (doc_id)), s AS (SELECT a.rep, a.fold, avg(b.n) AS m, stddev_pop(b.n) AS sd FROM (SELECT DISTINCT rep, fold FROM x) a JOIN x b ON a.rep = b.rep AND a.fold <> b.fold GROUP BY 1, 2)
SELECT x.doc_id, x.rep, round((n - m) / sd, 6) AS z FROM x JOIN s USING (rep, fold)""")
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _folds(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("z")), "doc_id")
    return classify.fold_scores(d, ["z"]).select("doc_id", "rep", "z")


_GUESS = "WITH g AS (SELECT doc_id, l.toxic AS actual, CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS predicted, n_chars, quality FROM labels l JOIN documents d USING (doc_id))"


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", F.col("toxic").alias("actual"), F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0).alias("predicted"), "n_chars", "quality")


_CLASS = f"""{_GUESS}, a AS (SELECT actual AS class, count(*) AS support FROM g GROUP BY 1), p AS (SELECT predicted AS class, count(*) AS n_predicted FROM g GROUP BY 1), h AS (SELECT actual AS class, count(*) AS hits FROM g WHERE actual = predicted GROUP BY 1),
m AS (SELECT class, coalesce(support, 0) AS support, coalesce(n_predicted, 0) AS n_predicted, coalesce(hits, 0) AS hits, coalesce(coalesce(hits, 0) / nullif(support, 0), 0) AS recall, coalesce(coalesce(hits, 0) / nullif(n_predicted, 0), 0) AS precision FROM a FULL JOIN p USING (class) LEFT JOIN h USING (class))"""


@query(f"{_CLASS} SELECT class, support, n_predicted, hits, round(recall, 6) AS recall, round(precision, 6) AS precision FROM m")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.class_metrics(_guesses(spark, sf_dir), "actual", "predicted")


@query(f"""{_CLASS}, b AS (SELECT avg(recall) AS ba, min(recall) AS mr, sum(hits) / sum(support) AS acc, min(support) AS smallest FROM m WHERE support > 0)
SELECT round(ba, 6) AS balanced_accuracy, round(mr, 6) AS min_recall, round(acc, 6) AS accuracy, smallest, CASE WHEN smallest >= 25 THEN 'ok' ELSE 'skipped: smallest class ' || smallest END AS status,
CASE WHEN NOT (ba - 0.1 > 0.5) THEN 'at chance' WHEN mr < 0.1 THEN 'association only' WHEN mr < 0.5 THEN 'association, no assignment' ELSE 'separable: ' || CASE WHEN ba < 0.6 THEN 'weak' WHEN ba < 0.75 THEN 'moderate' ELSE 'strong' END END AS verdict,
CASE WHEN ba > 0.6 THEN 'B' WHEN ba + 0.1 < 0.4 THEN 'C' ELSE 'A' END AS branch FROM b""")
def graded_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = classify.balanced_accuracy(classify.class_metrics(_guesses(spark, sf_dir), "actual", "predicted"))
    ba = F.col("balanced_accuracy")
    return b.select("*", classify.evaluable(F.col("smallest")).alias("status"), classify.verdict(ba, ba - 0.1, F.lit(0.01), F.col("min_recall"), F.lit(0.5)).alias("verdict"), classify.branch(F.lit(0.4), F.lit(0.6), ba, ba + 0.1).alias("branch"))


@query(f"""{_GUESS}, k AS (SELECT quality, actual = 1 AS p, rank() OVER (PARTITION BY quality ORDER BY n_chars) + (count(*) OVER (PARTITION BY quality, n_chars) - 1) / 2 AS rk FROM g)
SELECT quality, count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg, round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / nullif(count(*) FILTER (p) * count(*) FILTER (NOT p), 0), 6) AS auc FROM k GROUP BY 1""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.roc_auc(_guesses(spark, sf_dir), "n_chars", F.col("actual") == 1, ["quality"])


_POISSON = "CASE WHEN h < 367879 THEN 0 WHEN h < 735759 THEN 1 WHEN h < 919699 THEN 2 WHEN h < 981012 THEN 3 WHEN h < 996340 THEN 4 WHEN h < 999406 THEN 5 ELSE 6 END"


@query(f"""{_GUESS}, b AS (SELECT b, actual, predicted, {portable_hash_sql('doc_id', 'b')} AS h FROM g, (SELECT unnest(range(2000)) AS b)), w AS (SELECT b, actual, predicted, {_POISSON} AS w FROM b),
r AS (SELECT b, actual, sum(CASE WHEN actual = predicted THEN w ELSE 0 END) / nullif(sum(w), 0) AS r FROM w GROUP BY 1, 2), e AS (SELECT b, avg(r) AS acc FROM r GROUP BY 1)
SELECT round(quantile_cont(acc, 0.025), 6) AS ci_low, round(quantile_cont(acc, 0.975), 6) AS ci_high, count(*) AS reps FROM e""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.bootstrap_interval(_guesses(spark, sf_dir), "doc_id", "actual", "predicted", 2_000)


@query(f"{_GUESS}, h AS (SELECT rep, avg((CASE WHEN {portable_hash_sql('doc_id', 'rep', 5)} % 9 = 0 THEN 1 ELSE 0 END = actual)::INT) AS acc FROM g, (SELECT unnest(range(20)) AS rep) GROUP BY 1) SELECT round((count(*) FILTER (acc >= 0.78) + 1) / (count(*) + 1), 6) AS p, count(*) AS reps FROM h")
def empirical_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _guesses(spark, sf_dir).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    guess = F.when(portable_hash(F.col("doc_id"), F.col("rep"), 5) % 9 == 0, 1).otherwise(0)
    null = g.groupBy("rep").agg(F.avg((guess == F.col("actual")).cast("int")).alias("acc"))
    return classify.empirical_p(null, "acc", 0.78)


@query(f"{_GUESS}, c AS (SELECT actual, count(*) AS n FROM g GROUP BY 1) SELECT doc_id, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 6) AS weight FROM g JOIN c USING (actual)")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.balanced_weights(_guesses(spark, sf_dir), "actual").select("doc_id", "weight")


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    d, dims = _whole(spark, sf_dir)
    return classify.stratified_folds(d.withColumn("y", F.col("label") % 3), "vec_id", "y", 5), dims


@query()
def logistic_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision, plain and class-balanced, with the macro one-versus-rest area."""
    d, dims = _classes(spark, sf_dir)
    out = []
    for arm, balanced in (("plain", False), ("balanced", True)):
        oof = written(classify.logistic_out_of_fold(d, "vec_id", dims, "y", 5, balanced), "oof")
        auc = classify.macro_auc(oof, "actual", "probability", 3).select("macro_auc")
        out.append(classify.class_metrics(oof, "actual", "predicted").withColumns({"arm": F.lit(arm), "macro_auc": F.lit(auc.head()[0])}))
    return out[0].unionByName(out[1])


@query()
def accuracy_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced accuracy of classes told from cohort features, its interval, and p by refits on permuted labels."""
    d = _scored(spark, sf_dir)[1].withColumn("y", label3())
    return classify.permutation_test(d, "pid", FEATURES, "y")


_ARMS = {"account": ["bal"], "orders": ["n_orders", "mean_price", "max_price"]}


@query(f"""WITH a AS ({ANALYSIS}), c AS (SELECT *, bal IS NOT NULL AND n_orders IS NOT NULL AND mean_price IS NOT NULL AND max_price IS NOT NULL AS whole FROM a)
SELECT arm, count(*) AS n, sum(person_id)::BIGINT AS ids FROM (
SELECT 'account' AS arm, person_id FROM c WHERE whole UNION ALL SELECT 'orders', person_id FROM c WHERE whole UNION ALL SELECT 'both', person_id FROM c WHERE whole UNION ALL SELECT 'account, all rows', person_id FROM c WHERE bal IS NOT NULL) GROUP BY 1""")
def arm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each arm: the same complete ones, and the control on all rows its own columns allow."""
    arms = classify.arms(analysis(spark, sf_dir), _ARMS)
    return functools.reduce(DataFrame.unionByName, (rows.agg(F.lit(name).alias("arm"), F.count("*").alias("n"), F.sum("person_id").alias("ids")) for name, rows, _ in arms))


def _rungs() -> list[classify.Rung]:
    """From the narrowest arm to the widest: few persons, one segment (as the fasted ones), two measurements side by side, one."""
    own, whole = F.col("segment") == "BUILDING", ["bal", "mean_price", "max_price"]
    return [classify.Rung("few", whole, own & (F.col("n_orders") > 20)), classify.Rung("one segment", whole, own), classify.Rung("paired", ["bal", "n_orders"]), classify.Rung("account", ["bal"])]


_RUNG = lambda k, arm, where: f"SELECT {k} AS rung, '{arm}' AS arm, y, count(*) FILTER ({where}) AS c FROM a GROUP BY y"
_WHOLE = "bal IS NOT NULL AND mean_price IS NOT NULL AND max_price IS NOT NULL"


@query(f"""WITH a AS (SELECT *, nation % 3 AS y FROM ({ANALYSIS})), r AS ({' UNION ALL '.join((
    _RUNG(0, 'few', f"{_WHOLE} AND segment = 'BUILDING' AND n_orders > 20"), _RUNG(1, 'one segment', f"{_WHOLE} AND segment = 'BUILDING'"),
    _RUNG(2, 'paired', 'bal IS NOT NULL AND n_orders IS NOT NULL'), _RUNG(3, 'account', 'bal IS NOT NULL')))}),
s AS (SELECT rung, arm, sum(c)::BIGINT AS n, count(*) FILTER (c > 0) AS n_classes, min(c) AS smallest FROM r GROUP BY 1, 2)
SELECT *, CASE WHEN smallest >= 25 THEN 'ok' ELSE 'skipped: smallest class ' || smallest END AS status, coalesce(rung = (SELECT min(rung) FROM s WHERE smallest >= 25), false) AS chosen FROM s""")
def arm_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arm of a ladder is the first with 25 rows in its smallest class, and why those before it aren't."""
    d = analysis(spark, sf_dir).withColumn("y", F.pmod(F.col("nation"), F.lit(3)).cast("int"))
    return classify.ladder(d, "person_id", "y", _rungs())


@query()
def fitted_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analysis(spark, sf_dir).withColumn("y", F.pmod(F.col("nation"), F.lit(3)).cast("int"))
    return classify.fit_ladder(d, "person_id", "y", _rungs())


@query()
def feature_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's accuracy on identical rows, its interval, grade, and whether both together beat each alone."""
    d = analysis(spark, sf_dir).withColumn("y", F.pmod(F.col("nation"), F.lit(3)).cast("int"))
    return classify.compare_arms(d, "person_id", _ARMS, "y")


@query()
def boosted_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both leaf sizes where the rare class is small in a fold; recall, precision and macro area from the trees' shares, over
    three repeats of five folds."""
    d = _scored(spark, sf_dir)[1].withColumn("y", label3())
    rare = d.groupBy("y").count().agg(F.min("count").alias("n")).select(classify.leaf_sizes(F.col("n") * 4 / 5).alias("sizes")).head()
    leaves = list(rare["sizes"] or ())
    oof = written(classify.boosted_out_of_fold(d, "pid", FEATURES, "y", leaves, 5, 3), "oof")
    out = []
    for leaf in leaves:
        own = oof.where(F.col("leaf") == leaf)
        auc = classify.macro_auc(own, "actual", "probability", 3).head()
        out.append(classify.class_metrics(own, "actual", "predicted").withColumns({"leaf": F.lit(leaf), "macro_auc": F.lit(auc["macro_auc"])}))
    return functools.reduce(DataFrame.unionByName, out)


@query()
def forest_out_of_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of 500 class-balanced trees, each row by the trees that didn't draw it."""
    d = _scored(spark, sf_dir)[1].withColumn("y", label3())
    return classify.class_metrics(classify.forest_out_of_bag(d, "pid", FEATURES, "y"), "actual", "predicted")


@query()
def membership_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, z = _scored(spark, sf_dir)
    d = z.join(raw.select("pid", F.col("n_lows_70").alias("_low")), "pid")
    runs = cluster.membership_runs(d, "pid", [FEATURES, FEATURES[:10]], 3, "_low")
    return cluster.recurrence(written(runs, "runs"), "pid", "flag")


@query("""WITH a AS (SELECT count(*) AS n, corr(l_extendedprice, l_quantity) ** 2 AS r2, avg(l_discount) AS discount FROM lineitem), v AS (SELECT 'r2' AS what, r2 AS value, 0.85::DOUBLE AS published FROM a UNION ALL SELECT 'discount', discount, 0.05::DOUBLE FROM a UNION ALL SELECT 'share', 0.2::DOUBLE, 0.5::DOUBLE FROM a)
SELECT what, round(value, 6) AS value, published, round(abs(value - published), 6) AS gap, abs(value - published) <= 0.01 AS within_tolerance FROM v""")
def tolerance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values against published ones, reported and not enforced."""
    a = table(spark, sf_dir, "lineitem").agg(F.pow(F.corr("l_extendedprice", "l_quantity"), F.lit(2)).alias("r2"), F.avg("l_discount").cast("double").alias("discount"), F.lit(0.2).alias("share"))
    return cohort.against_published(a, {"r2": 0.85, "discount": 0.05, "share": 0.5}, 0.01)
