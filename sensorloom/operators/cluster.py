"""K-means cohorts and how good and stable they are.

Rows have an id and feature columns. Distances to centres are column expressions (centres are few). Validity indices
that need all pairs work on blocks of rows with a bounded number of points each and never emit a pair.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import cohort, normal, replicates, stats
from sensorloom.session import written

#: Rows of a group of exact distances, and of a step inside it.
BLOCK, STEP = 4_000, 1_000


def vectors(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def squared_distance(columns: Sequence[Column], centre: Sequence[float]) -> Column:
    return functools.reduce(operator.add, ((c - float(v)) * (c - float(v)) for c, v in zip(columns, centre, strict=True)))


def nearest(columns: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre; the first of equals."""
    options = F.array(*(F.struct(squared_distance(columns, c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)))
    return F.array_min(options)["k"]


def fit_centres(df: DataFrame, key: str, columns: Sequence[str], k: int, starts: int = 20, seed: int = 0) -> tuple[list[list[float]], float]:
    """Centres of the best of several starts, and their cost."""
    fit = replicates.fit_runs(replicates.points(df, key, columns), [0], k, starts, seed=seed)[0]
    return fit.centres.tolist(), fit.cost


def assign(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], name: str = "cluster") -> DataFrame:
    return df.withColumn(name, nearest([F.col(c) for c in columns], centres))


# The three names.
def name_clusters(df: DataFrame, cluster: str, lows: str, highs: str) -> DataFrame:
    """(cluster, name): the greatest median of ``lows`` is Hypo-Prone, of the rest the greatest of ``highs`` Spiker, then
    Stable; ties go to the lower number."""
    own = stats.group_quantiles(df, cluster, list(dict.fromkeys([lows, highs])), [0.5])
    m = own.groupBy(cluster).agg(*(F.max(F.when(F.col("variable") == c, F.col("value"))).alias(name) for name, c in (("l", lows), ("h", highs))))
    first = m.orderBy(F.desc("l"), cluster).limit(1).select(cluster).withColumn("name", F.lit("Hypo-Prone"))
    rest = m.join(first, cluster, "left_anti")
    second = rest.orderBy(F.desc("h"), cluster).limit(1).select(cluster).withColumn("name", F.lit("Spiker"))
    return first.unionByName(second).unionByName(rest.join(second, cluster, "left_anti").select(cluster).withColumn("name", F.lit("Stable")))


def centroids(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def dispersion_indices(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin. Centroids are few and go to all tasks."""
    c = centroids(df, columns, cluster)
    rows = c.collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    centre = {r[cluster]: [r[x] for x in columns] for r in rows}
    mean = [sum(r["n"] * r[x] for r in rows) / n for x in columns]
    between = sum(r["n"] * sum((a - b) ** 2 for a, b in zip(centre[r[cluster]], mean, strict=True)) for r in rows)
    centres = df.sparkSession.createDataFrame(list(centre.items()), f"`{cluster}` {df.schema[cluster].dataType.simpleString()}, _c array<double>")
    met = df.select(cluster, F.array(*columns).cast("array<double>").alias("_x")).join(F.broadcast(centres), cluster)
    own = F.aggregate(F.zip_with("_x", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    spread = {r[cluster]: (r["w"], r["s"]) for r in met.select(cluster, own.alias("d")).groupBy(cluster).agg(F.sum("d").alias("w"), F.avg(F.sqrt("d")).alias("s")).collect()}
    within = sum(w for w, _ in spread.values())
    far = lambda a, b: math.dist(centre[a], centre[b])
    db = sum(max((spread[a][1] + spread[b][1]) / far(a, b) for b in centre if b != a) for a in centre) / k
    ch = between / (k - 1) / (within / (n - k))
    return df.agg(F.count("*").alias("n"), F.lit(ch).alias("calinski_harabasz"), F.lit(db).alias("davies_bouldin"))


def silhouettes(df: DataFrame, key: str, columns: Sequence[str], cluster: str) -> DataFrame:
    """(key, cluster, silhouette) by Euclidean distances; 0 in a cluster of one row.

    Rows are dealt into groups of about ``BLOCK`` rows, and pairs of groups are the tiles of a triangular grid: each tile is a
    task of its own that makes every distance between its two groups once and adds it to both rows' sums by cluster. A row
    goes to as many tiles as the grid is wide, so what is shuffled grows with rows times groups and the work with all
    distances; for many rows use ``squared_silhouette``. Pairs are never emitted.
    """
    rows = df.select(F.col(key).alias("key"), F.col(cluster).cast("int").alias("cluster"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    side = max(1, math.ceil(df.count() / BLOCK))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(side)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    tiled = dealt.withColumn("o", other).select(F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), "g", "key", "cluster", "x")
    kind = df.schema[key].dataType.simpleString()

    def sums(tile: tuple, table: pa.Table) -> pa.Table:
        first, second = (k.as_py() for k in tile)
        table = table.combine_chunks()
        g, labels = table["g"].to_numpy(), table["cluster"].to_numpy()
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1)
        names, code = np.unique(labels, return_inverse=True)
        hot = (code[:, None] == np.arange(len(names))).astype(float)
        square, total = (x * x).sum(1), np.zeros((len(g), len(names)))
        count = np.zeros((len(g), len(names)), np.int64)
        one, two = np.flatnonzero(g == first), np.flatnonzero(g == second)
        for i in range(0, len(one), STEP):
            m = one[i : i + STEP]
            for j in range(i if first == second else 0, len(two), STEP):
                n = two[j : j + STEP]
                d = np.sqrt(np.maximum(0, square[m][:, None] - 2 * x[m] @ x[n].T + square[n]))
                same = first == second and i == j
                if same:
                    np.fill_diagonal(d, 0.0)
                total[m] += d @ hot[n]
                count[m] += hot[n].sum(0).astype(np.int64)
                if not same:
                    total[n] += d.T @ hot[m]
                    count[n] += hot[m].sum(0).astype(np.int64)
        of, label = np.nonzero(count)
        take = pa.array(of)
        return pa.Table.from_arrays([table["key"].take(take), table["cluster"].take(take), pa.array(names[label].astype(np.int32)), pa.array(total[of, label]), pa.array(count[of, label])], ["key", "cluster", "other", "total", "n"])

    each = tiled.groupBy("a", "b").applyInArrow(sums, f"key {kind}, cluster int, other int, total double, n bigint")
    each = each.groupBy("key", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("cluster") == F.col("other")
    d = each.groupBy("key", "cluster").agg(F.sum(F.when(own, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))
    return d.select(F.col("key").alias(key), F.col("cluster").alias(cluster), s.alias("silhouette"))


def squared_silhouette(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """(rows, mean squared-Euclidean silhouette) from sums by cluster: no pairs."""
    d = df.select(F.lit(1).alias("_all"), cluster, F.array(*(F.col(c).cast("double") for c in columns)).alias("_x"))
    return squared_silhouettes(d, "_x", cluster, ["_all"]).select("n", "silhouette")


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings from counts; 1 for equal partitions whatever their codes."""
    keys = list(by) or ["_all"]
    d = df.withColumn("_all", F.lit(1)).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("c"))
    two = lambda c: c * (c - 1) / 2
    cells = d.groupBy(*keys).agg(F.sum(two(F.col("c"))).alias("ij"), F.sum("c").alias("n"))
    side = lambda c, name: d.groupBy(*keys, c).agg(F.sum("c").alias("m")).groupBy(*keys).agg(F.sum(two(F.col("m"))).alias(name))
    s = cells.join(side("_a", "i"), keys).join(side("_b", "j"), keys)
    chance = F.col("i") * F.col("j") / F.nullif(two(F.col("n")), F.lit(0.0))
    top = (F.col("i") + F.col("j")) / 2 - chance
    ari = F.when(top == 0, 1.0).otherwise((F.col("ij") - chance) / top)
    return s.select(*(k for k in keys if k != "_all"), "n", ari.alias("ari"))


def selection_sweep(df: DataFrame, key: str, columns: Sequence[str], ks: Sequence[int], starts: int = 20, medians: Sequence[str] = ()) -> DataFrame:
    """For each k and cluster: the k's cost, validity indices and number of clusters under 5 %, the cluster's size and its
    medians of the columns named, which may be others than those clustered."""
    rows = replicates.points(df, key, columns, extra=medians)
    fits = replicates.fit_runs(rows, list(ks), {k: k for k in ks}, starts)
    found = replicates.quality(rows, fits)
    tiny = {k: sum(n < 0.05 * sum(q.sizes) for n in q.sizes) for k, q in found.items()}
    whole = df.sparkSession.createDataFrame([(k, fits[k].cost, q.silhouette, q.calinski_harabasz, q.davies_bouldin, tiny[k]) for k, q in found.items()], "k int, cost double, silhouette double, calinski_harabasz double, davies_bouldin double, n_tiny int")
    each = replicates.assigned(rows, fits, medians).groupBy(F.col("run").alias("k"), "cluster").agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in medians))
    return each.join(F.broadcast(whole), "k")


def stability(df: DataFrame, key: str, columns: Sequence[str], k: int, seeds: int = 20, draws: int = 200, splits: int = 50, starts: int = 5, seed: int = 0) -> DataFrame:
    """(kind, rep, ari): labels of other seeds and of fits on resamples (rows drawn with replacement) against those of all
    rows, over all rows; and of fits on one half of the rows, over the other half. Each kind is fitted in shared passes."""
    rows = replicates.points(df, key, columns)
    base = replicates.fit_runs(rows, [0], k, starts, seed=seed)
    if not base:
        return df.sparkSession.createDataFrame([], "kind string, rep int, ari double")
    out = []
    for kind, reps, drawn, judged in (("seed", seeds, None, None), ("bootstrap", draws, replicates.poisson_draws(seed), None), ("half", splits, replicates.halves(seed), replicates.halves(seed, True))):
        fits = replicates.fit_runs(rows, range(reps), k, 1 if kind == "seed" else starts, drawn, seed=seed + 1)
        out += [(kind, r, a) for r, a in replicates.agreement(rows, fits, base[0], judged).items()]
    return df.sparkSession.createDataFrame(out, "kind string, rep int, ari double")


def interval(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: replicates, mean, deviation, and the interval that holds 95 % of them."""
    return df.groupBy(by).agg(F.count("*").alias("reps"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def permutation_null(df: DataFrame, key: str, columns: Sequence[str], cluster: str, reps: int, seed: int = 0) -> DataFrame:
    """(run, silhouette, p): the squared silhouette of the labels (run -1) and of labels dealt anew to all rows; p is the
    share of runs, with the labels' own, that reach it.

    Features are written once, whatever the number of runs; each run's labels follow from a hash. Runs until it returns.
    """
    sizes = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n")).orderBy(cluster).collect()
    code = F.coalesce(*(F.when(F.col(cluster) == r[cluster], F.lit(k)) for k, r in enumerate(sizes)), F.lit(None).cast("int")) if sizes else F.lit(None).cast("int")
    rows = replicates.points(df.withColumn("y", code).where("y is not null"), key, columns, extra=["y"])
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    labels = replicates.dealt_labels(rows, [counts.get(k, 0) for k in range(len(sizes))], reps, seed)

    def labelled(batch: pa.RecordBatch, mine: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x, keys, y = replicates.matrix(batch["x"]), batch["key"].to_numpy(), batch["y"].to_numpy()
        for r in mine:
            yield r, x, labels.of(keys, y, r)

    found = replicates.validity(rows, dict.fromkeys(range(-1, reps), len(sizes)), labelled)
    each = {r: q.silhouette for r, q in found.items()}
    p = sum(v >= each[-1] for v in each.values()) / len(each) if each else None
    return df.sparkSession.createDataFrame([(r, v, p) for r, v in each.items()], "run int, silhouette double, p double")


def squared_silhouettes(df: DataFrame, vector: str, cluster: str, by: Sequence[str]) -> DataFrame:
    """(by, n, silhouette) as ``squared_silhouette``, for many labelings at once; ``vector`` is an array column.

    Sums by cluster are few for each labeling and join its rows.
    """
    norm = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v)
    d = df.withColumn("_q", norm)
    width = df.select(F.size(vector)).head()
    sums = d.groupBy(*by, cluster).agg(F.count("*").alias("n"), F.sum("_q").alias("q"), F.array(*(F.sum(F.col(vector)[k]) for k in range(width[0] if width else 0))).alias("s"))
    packed = sums.groupBy(*by).agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "q", "s")).alias("all"))
    met = d.join(packed, list(by))
    dot = lambda s: F.aggregate(F.zip_with(F.col(vector), s, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    far = F.transform("all", lambda o: F.struct((o["c"] == F.col(cluster)).alias("own"), o["n"].alias("n"), (o["n"] * F.col("_q") + o["q"] - 2 * dot(o["s"])).alias("t")))
    met = met.select(*by, far.alias("far"))
    own = F.filter("far", lambda o: o["own"])[0]
    other = F.array_min(F.transform(F.filter("far", lambda o: ~o["own"]), lambda o: o["t"] / o["n"]))
    met = met.select(*by, own["n"].alias("n"), (own["t"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"), other.alias("b"))
    s = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return met.groupBy(*by).agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))


def _null_summary(spark, observed: float, null: dict[int, float], plus_one: bool) -> DataFrame:
    """One row: observed value, mean and deviation of the null, z, and the share of the null that reaches it."""
    values = list(null.values())
    d = spark.createDataFrame([(v,) for v in values], "v double")
    reach = F.count_if(F.col("v") >= observed)
    return d.agg(F.lit(observed).alias("observed"), F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_sd"), ((observed - F.avg("v")) / F.nullif(F.stddev_pop("v"), F.lit(0.0))).alias("z"), ((reach + int(plus_one)) / (F.count("*") + 1)).alias("p"), F.count("*").alias("reps"))


def shuffle_null(df: DataFrame, key: str, columns: Sequence[str], k: int, reps: int = 100, starts: int = 5, seed: int = 0) -> DataFrame:
    """Silhouette of k-means against tables whose columns are shuffled one by one, each fitted anew (no one is added to the
    share's numerator).

    Features are written once, in blocks of random rows; each run shuffles a block's columns by a seed in the task that
    reads it. Values change rows inside a block, which is the whole table up to ``replicates.TASK_ROWS`` rows.
    """
    own = replicates.points(df, key, columns)
    observed = replicates.quality(own, replicates.fit_runs(own, [0], k, starts, seed=seed))[0].silhouette
    rows, deal = replicates.in_blocks(own), replicates.shuffled_columns(seed)
    found = replicates.quality(rows, replicates.fit_runs(rows, range(reps), k, starts, seed=seed, deal=deal), deal)
    return _null_summary(df.sparkSession, observed, {r: q.silhouette for r, q in found.items()}, False)


def copula_null(df: DataFrame, key: str, columns: Sequence[str], k: int, draws: int = 200, starts: int = 5, seed: int = 0) -> DataFrame:
    """Silhouette of k-means against draws with the columns' marginals and correlation but no clusters, each brought to
    standard scores and fitted anew.

    Up to ``HELD`` values a draw is made, fitted and judged by one task, and only its silhouette leaves it. Draws that are
    fewer than the tasks that can run are stored as blocks instead, which all tasks share; so are those of larger tables.
    """
    own = replicates.points(df, key, columns)
    observed = replicates.quality(own, replicates.fit_runs(own, [0], k, starts, seed=seed))[0].silhouette
    small = 0 < df.count() * len(columns) <= HELD
    if small and draws >= df.sparkSession.sparkContext.defaultParallelism:
        return _null_summary(df.sparkSession, observed, held_silhouettes(df, key, columns, k, draws, starts, seed), True)
    rows = drawn_blocks(df, key, columns, draws, seed) if small else replicates.points(gaussian_copula_draws(df, key, columns, draws, seed), "row", columns, "rep")
    scaled = replicates.standard_scores(rows, range(draws))
    found = replicates.quality(rows, replicates.fit_runs(rows, range(draws), k, starts, seed=seed, deal=scaled), scaled)
    return _null_summary(df.sparkSession, observed, {r: q.silhouette for r, q in found.items()}, True)


#: Draws of a task's chunk, values of a marginal's block, and looked-up values of a group.
DRAWS, VALUES, LOOKUPS = 20_000, 65_536, 2_000_000
#: Values of all marginals up to which they are sent to the tasks that draw (8 bytes each).
HELD = 16_000_000


def normal_covariance(df: DataFrame, key: str, columns: Sequence[str]) -> tuple[np.ndarray, list[int]]:
    """Covariance of the columns' normal scores (of mid-rank less one half over the number of values), over rows with both,
    and the number of values of each column. Ranks are running sums over distinct values; runs until it returns."""
    width = len(columns)
    long = _by_column(df.select(F.col(key).alias("key"), *columns), ["key"], columns)
    sizes = {r["column"]: r["n"] for r in long.groupBy("column").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(j, 0) for j in range(width)]
    ranked = stats.mid_ranks(long, ["column"], "value")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch["column"].to_numpy()
            z = normal.inverse((batch["rank"].to_numpy(zero_copy_only=False).astype(float) - 0.5) / np.array(n, float)[of])
            yield pa.RecordBatch.from_arrays([batch["key"], batch["column"], pa.array(z)], ["key", "column", "z"])

    kind = df.schema[key].dataType.simpleString()
    scores = ranked.select("key", "column", "rank").mapInArrow(scored, f"key {kind}, column int, z double")
    rows = scores.groupBy("key").agg(F.collect_list("column").alias("j"), F.collect_list("z").alias("z")).withColumn("_g", F.lit(0))

    def sums(batch: pa.RecordBatch, runs: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        z, there = np.zeros((2, batch.num_rows, width))
        of = np.repeat(np.arange(batch.num_rows), np.diff(batch["j"].offsets.to_numpy()))
        j = batch["j"].flatten().to_numpy()
        z[of, j], there[of, j] = batch["z"].flatten().to_numpy(), 1.0
        yield 0, np.stack([there.T @ there, z.T @ there, z.T @ z]).ravel()

    total = replicates.Spread(rows, 1, False).sums([0], sums).get(0, np.zeros(3 * width * width))
    count, one, product = total.reshape(3, width, width)
    return (product - one * one.T / np.maximum(count, 1)) / np.maximum(count - 1, 1), n


def _by_column(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(ids, column: its place among ``columns``, value) of what isn't null."""
    each = F.array(*(F.struct(F.lit(j).alias("column"), F.col(c).cast("double").alias("value")) for j, c in enumerate(columns)))
    return df.select(*ids, F.explode(each).alias("e")).select(*ids, "e.column", "e.value").where("value is not null")


def marginal_blocks(df: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """(column, block, values): all values of each column in order, ``size`` of them and the one that follows to a block."""
    long = _by_column(df, [], columns)
    counted = stats.running_sums(long.groupBy("column", "value").agg(F.count("*").alias("ties")), ["column"], "value", ["ties"])
    places = counted.select("column", "value", F.explode(F.sequence(F.col("ties_upto") - F.col("ties"), F.col("ties_upto") - 1)).alias("at"))
    # The first value of a block is also the one behind the block before.
    both = places.select("column", "value", "at", F.explode(F.array_distinct(F.array(F.floor(F.col("at") / size), F.floor((F.greatest(F.col("at"), F.lit(1)) - 1) / size)))).alias("block"))
    return both.groupBy("column", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def drawn(seed: int, chunk: int, rows: int, low: np.ndarray) -> np.ndarray:
    """Uniform marginals of a chunk's draws with the correlation that ``low`` factors."""
    return normal.quick_cdf(np.random.default_rng([seed, chunk]).standard_normal((rows, len(low))) @ low.T)


def _held_draws(df: DataFrame, key: str, columns: Sequence[str], draws: int, seed: int) -> Callable[[int], np.ndarray]:
    """A function for tasks that makes a chunk of the draws of ``gaussian_copula_draws`` as rows of 4-byte floats. The sorted
    values of the columns, ``HELD`` at most, are broadcast."""
    spark, width, total = df.sparkSession, len(columns), df.count() * draws
    covariance, sizes = normal_covariance(df, key, columns)
    low = np.linalg.cholesky(covariance + 1e-9 * np.eye(width))
    counted = _by_column(df, [], columns).groupBy("column", "value").agg(F.count("*").alias("ties")).toArrow()
    of, value, ties = (counted[c].to_numpy() for c in ("column", "value", "ties"))
    known = []
    for j in range(width):
        own = np.flatnonzero(of == j)
        own = own[np.argsort(value[own])]
        known.append(np.repeat(value[own], ties[own]) if len(own) else np.array([np.nan]))
    shared, most = spark.sparkContext.broadcast(known), np.maximum(np.array(sizes), 1) - 1

    def draw(chunk: int) -> np.ndarray:
        at = drawn(seed, chunk, min(DRAWS, total - chunk * DRAWS), low) * most
        x = np.empty(at.shape, "<f4")
        for j, values in enumerate(shared.value):
            place = at[:, j].copy()
            below = place.astype(np.int64)
            share = place - below
            x[:, j] = values.take(below, mode="clip") * (1 - share) + values.take(below + 1, mode="clip") * share
        return x

    return draw


def drawn_blocks(df: DataFrame, key: str, columns: Sequence[str], draws: int, seed: int = 0) -> DataFrame:
    """The draws of ``gaussian_copula_draws`` as a written table of blocks (run, first: row of the run, rows, values: 4-byte
    floats by row), for up to ``HELD`` values. Rows with a missing value are left out."""
    spark, n = df.sparkSession, df.count()
    drawn_rows, total = _held_draws(df, key, columns, draws, seed), n * draws

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch["id"].to_pylist():
                x = drawn_rows(chunk)
                ids = np.arange(chunk * DRAWS, chunk * DRAWS + len(x))
                run, row, good = ids // n, ids % n, ~np.isnan(x).any(1)
                for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(run)) + 1):
                    own = part[good[part]]
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array([int(run[part[0]])], pa.int32()), pa.array([int(row[part[0]])], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([x[own].tobytes()], pa.binary())], ["run", "first", "rows", "values"])

    chunks = -(-total // DRAWS)
    tasks = min(chunks, max(spark.sparkContext.defaultParallelism, chunks // 64))
    return written(spark.range(0, chunks, 1, tasks).mapInArrow(draw, "run int, first bigint, rows int, values binary"), "draws")


def held_silhouettes(df: DataFrame, key: str, columns: Sequence[str], k: int, draws: int, starts: int = 5, seed: int = 0) -> dict[int, float]:
    """Squared silhouette of k-means on the standard scores of each draw of ``drawn_blocks``.

    A draw is no larger than the sorted values that every task holds, so the task that makes it goes through all steps of its
    fits in memory: nothing is written, and only a number for each draw leaves a task.
    """
    spark, n = df.sparkSession, df.count()
    drawn_rows, width = _held_draws(df, key, columns, draws, seed), len(columns)
    # A task makes whole chunks: small draws share them, and large ones are a task each.
    each = max(1, min(draws // (4 * spark.sparkContext.defaultParallelism), 10 * DRAWS // n))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch["id"].to_pylist():
                chunk, made = -1, None
                for run in range(task * each, min(draws, (task + 1) * each)):
                    x, at = np.empty((n, width)), 0
                    while at < n:
                        start = run * n + at
                        if start // DRAWS != chunk:
                            chunk = start // DRAWS
                            made = drawn_rows(chunk)
                        part = made[start % DRAWS :][: n - at]
                        x[at : at + len(part)] = part
                        at += len(part)
                    there = ~np.isnan(x).any(1)
                    x = x if there.all() else x[there]
                    if len(x):
                        replicates.to_standard_scores(x)
                        value = replicates.held_silhouette(x, replicates.fit_held(x, k, starts, run, seed=seed))
                        yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([value])], ["run", "silhouette"])

    got = spark.range(0, -(-draws // each), 1, -(-draws // each)).mapInArrow(judged, "run int, silhouette double").toArrow()
    return dict(sorted(zip(got["run"].to_pylist(), got["silhouette"].to_pylist(), strict=True)))


def gaussian_copula_draws(df: DataFrame, key: str, columns: Sequence[str], draws: int, seed: int = 0, values: int = VALUES) -> DataFrame:
    """(rep, row, columns): draws with the columns' own marginals and the covariance of their normal scores.

    The small covariance is factored on the driver. A chunk of draws is made by a seed of its own; each uniform is a place
    among all sorted values of its column, between two of which the value lies on a line. Places go packed to the block of
    values that holds them and the values go back to their chunk: no column is whole in any task, and there are no knots.
    """
    spark, n, width, names = df.sparkSession, df.count(), len(columns), list(columns)
    kinds = "rep bigint, row bigint, " + ", ".join(f"`{c}` double" for c in names)
    if not n * draws:
        return spark.createDataFrame([], kinds)
    covariance, sizes = normal_covariance(df, key, columns)
    low = np.linalg.cholesky(covariance + 1e-9 * np.eye(width))
    blocks = marginal_blocks(df, columns, values)
    salts = max(1, -(-draws * min(n, values) // LOOKUPS))
    total, most = n * draws, np.maximum(np.array(sizes), 1) - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch["id"].to_pylist():
                at = drawn(seed, chunk, min(DRAWS, total - chunk * DRAWS), low) * most
                out = []
                for j in range(width):
                    below = at[:, j].astype(np.int64)
                    block = below // values
                    order = np.argsort(block, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                        out.append((j, int(block[part[0]]), chunk % salts, chunk, part.astype("<u4").tobytes(), (at[part, j] - block[part[0]] * values).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["column", "block", "salt", "chunk", "rows", "at"])

    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        known = held["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        found = []
        for at in asked["at"]:
            at = np.frombuffer(at.as_buffer(), "<f8")
            below = at.astype(np.int64)
            share = at - below
            found.append((known[below] * (1 - share) + known[np.minimum(below + 1, len(known) - 1)] * share).tobytes())
        return pa.Table.from_arrays([*(asked[c].combine_chunks() for c in ("chunk", "column", "rows")), pa.array(found, pa.binary())], ["chunk", "column", "rows", "values"])

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        ids = np.arange(chunk * DRAWS, min(total, (chunk + 1) * DRAWS))
        x = np.full((width, len(ids)), np.nan)
        for j, rows, found in zip(table["column"].to_pylist(), table["rows"].to_pylist(), table["values"].to_pylist(), strict=True):
            x[j, np.frombuffer(rows, "<u4")] = np.frombuffer(found, "<f8")
        return pa.Table.from_arrays([pa.array(ids // n), pa.array(ids % n), *(pa.array(v, from_pandas=True) for v in x)], ["rep", "row", *names])

    asked = spark.range(0, -(-total // DRAWS)).mapInArrow(ask, "column int, block bigint, salt bigint, chunk bigint, rows binary, at binary")
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    by = ["column", "block", "salt"]
    found = asked.groupBy(*by).cogroup(salted.groupBy(*by)).applyInArrow(answer, "chunk bigint, column int, rows binary, values binary")
    return found.groupBy("chunk").applyInArrow(whole, kinds)


def principal_components(df: DataFrame, key: str, columns: Sequence[str], anchor: str, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Scores (key, pc1..) and loadings (pc, variable, loading, explained) of standard scores; the anchor loads positive."""
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors(df, columns))
    load, explained = model.pc.toArray(), model.explainedVariance.toArray()
    load = load * np.where(load[list(columns).index(anchor)] < 0, -1.0, 1.0)
    x = [F.col(c) for c in columns]
    scores = df.select(key, *(functools.reduce(operator.add, (c * float(w) for c, w in zip(x, load[:, i], strict=True))).alias(f"pc{i + 1}") for i in range(k)))
    rows = [(i + 1, c, float(load[j, i]), float(explained[i])) for i in range(k) for j, c in enumerate(columns)]
    return scores, df.sparkSession.createDataFrame(rows, "pc int, variable string, loading double, explained double")


def top_loadings(loadings: DataFrame, n: int = 5) -> DataFrame:
    """The n greatest absolute loadings of each component, with their place; ties by name."""
    by = Window.partitionBy("pc").orderBy(F.desc(F.abs("loading")), "variable")
    return loadings.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def quartiles(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, variable, n, median, iqr) of each column in each group."""
    q = stats.group_quantiles(df, by, columns, [0.25, 0.5, 0.75]).groupBy(by, "variable", "n").agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"q{k}") for k in range(3)))
    return q.select(by, "variable", "n", F.col("q1").alias("median"), (F.col("q2") - F.col("q0")).alias("iqr"))


def frozen(df: DataFrame, key: str, columns: Sequence[str], k: int, lows: str, highs: str, starts: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """What another cohort needs to be placed by this one's clusters, as two tables: scaler (variable, mean, sd) and
    centres (cluster, name, variable, value)."""
    filled = cohort.fill_medians(df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)), columns)
    row = filled.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).head()
    scale = [(c, row[f"{c}_m"], row[f"{c}_s"] or 1.0) for c in columns]
    spark = df.sparkSession
    z = filled.select(key, *((F.col(c) - m) / s for c, m, s in scale)).toDF(key, *columns)
    centres, _ = fit_centres(z, key, columns, k, starts, seed)
    named = name_clusters(assign(z, columns, centres).select(key, "cluster").join(filled, key), "cluster", lows, highs)
    values = spark.createDataFrame([(j, c, float(v)) for j, centre in enumerate(centres) for c, v in zip(columns, centre, strict=True)], "cluster int, variable string, value double")
    return spark.createDataFrame(scale, "variable string, mean double, sd double"), values.join(F.broadcast(named), "cluster").select("cluster", "name", "variable", "value")


def projected(df: DataFrame, key: str, scaler: DataFrame, centres: DataFrame) -> DataFrame:
    """(key, name): the name of the nearest frozen centre; a missing feature counts as this cohort's own median."""
    scale = scaler.orderBy("variable").collect()
    columns = [r["variable"] for r in scale]
    at: dict[tuple[int, str], dict[str, float]] = {}
    for r in centres.collect():
        at.setdefault((r["cluster"], r["name"]), {})[r["variable"]] = r["value"]
    filled = cohort.fill_medians(df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)), columns)
    z = [(F.col(r["variable"]) - r["mean"]) / r["sd"] for r in scale]
    names = sorted(at)
    which = nearest(z, [[at[c][v] for v in columns] for c in names])
    return filled.select(key, F.element_at(F.array(*(F.lit(name) for _, name in names)), which + 1).alias("name"))


def membership_runs(df: DataFrame, key: str, sets: Sequence[Sequence[str]], k: int, lows: str, seeds: int = 20, mixtures: int = 5, seed: int = 0) -> DataFrame:
    """(arm, run, key, flag): in every run whether a row is in the cluster with the greatest median of ``lows``.

    Arms: k-means by seed for each set of features; the first set without one feature after another; a hierarchical one
    (bisecting k-means); and Gaussian mixtures by seed. Columns are standard scores; all k-means runs share their passes.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = replicates.points(df, key, columns, extra=["_low"] if "_low" in df.columns else [lows])
    held = rows.columns[-1]
    masks, arms = {}, {}
    for j, chosen in enumerate(sets):
        for _ in range(seeds):
            arms[len(masks)], masks[len(masks)] = f"set {j + 1}", np.array([c in chosen for c in columns])
    for left in sets[0]:
        arms[len(masks)], masks[len(masks)] = "leave one out", np.array([c in sets[0] and c != left for c in columns])
    labels = replicates.assigned(rows, replicates.fit_runs(rows, list(masks), k, masks=masks, seed=seed), [held])
    first = rows.select("key", held, *(F.col("x")[columns.index(c)].alias(c) for c in sets[0]))
    more = [("bisecting", BisectingKMeans(k=k, seed=seed))] + [("mixture", GaussianMixture(k=k, seed=seed + j)) for j in range(mixtures)]
    ready = vectors(first, sets[0])
    for run, (arm, estimator) in enumerate(more, len(masks)):
        arms[run] = arm
        labels = labels.unionByName(estimator.fit(ready).transform(ready).select(F.lit(run).alias("run"), "key", F.col("prediction").alias("cluster"), held))
    named = df.sparkSession.createDataFrame(list(arms.items()), "run int, arm string")
    m = labels.groupBy("run", "cluster").agg(F.median(held).alias("m")).groupBy("run").agg(F.max_by("cluster", F.struct("m", -F.col("cluster"))).alias("chosen"))
    return labels.join(m, "run").join(F.broadcast(named), "run").select("arm", "run", F.col("key").alias(key), (F.col("cluster") == F.col("chosen")).alias("flag"))


def recurrence(runs: DataFrame, key: str, flag: str, core: float = 0.8) -> DataFrame:
    """Share of runs in which each row has the flag, whether it reaches the core share, and whether runs differ on it."""
    d = runs.groupBy(key).agg(F.avg(F.col(flag).cast("double")).alias("frequency"), F.count("*").alias("n_runs"))
    return d.withColumns({"core": F.col("frequency") >= core, "crosses": (F.col("frequency") > 0) & (F.col("frequency") < 1)})
