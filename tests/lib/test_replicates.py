"""Fits of many replicates in shared passes against the same computed one by one."""

import random

import numpy as np
from pyspark.sql import functions as F

from sensorloom.functions.columns import portable_hash
from sensorloom.operators import cluster, replicates


def table_of(spark, rows):
    return spark.createDataFrame([(k, *map(float, x)) for k, x in rows], "id long, " + ", ".join(f"x{k} double" for k in range(len(rows[0][1]))))


def blobs(n=120, seed=3):
    rng = random.Random(seed)
    return [(k, [rng.gauss(6.0 * (k % 3 == j), 1.0) for j in range(3)]) for k in range(n)]


def test_hashes_are_the_portable_ones(spark):
    keys = [0, 5, 999_999, 1_000_003, 12_345_678]
    got = {r.k: r.h for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", portable_hash(F.col("k"), 4, 2).alias("h")).collect()}
    assert replicates.hashes(np.array(keys), 4, 2).tolist() == [got[k] for k in keys]


def test_runs_end_where_no_centre_moves(spark):
    rows = blobs()
    x = np.array([v for _, v in rows])
    keys = np.array([k for k, _ in rows])
    p = replicates.points(table_of(spark, rows), "id", ["x0", "x1", "x2"])
    draws = replicates.poisson_draws(1)
    masks = {1: np.array([True, True, False])}
    for weight, m in ((None, None), (draws, None), (None, masks)):
        fits = replicates.fit_runs(p, range(3), 3, 4, weight, m)
        for r, fit in fits.items():
            w = np.ones(len(x)) if weight is None else weight(keys, r)
            near = fit.distances(x).argmin(1)
            for c in range(3):
                assert np.allclose(fit.centres[c], np.average(x[near == c], axis=0, weights=w[near == c]))
            assert abs(fit.cost - (w * fit.distances(x).min(1)).sum()) < 1e-6
    labels = {(r.run, r.key): r.cluster for r in replicates.assigned(p, fits).collect()}
    assert all(labels[1, k] == fits[1].distances(x).argmin(1)[k] for k in range(len(x)))


def test_quality_is_that_of_the_operators(spark):
    d = table_of(spark, blobs(60))
    cols = ["x0", "x1", "x2"]
    p = replicates.points(d, "id", cols)
    fits = replicates.fit_runs(p, [3, 4], {3: 3, 4: 4}, 3)
    found = replicates.quality(p, fits)
    for k, fit in fits.items():
        own = cluster.assign(d, cols, fit.centres.tolist())
        assert abs(found[k].silhouette - cluster.squared_silhouette(own, cols, "cluster").head().silhouette) < 1e-9
        want = cluster.dispersion_indices(own, cols, "cluster").head()
        assert abs(found[k].calinski_harabasz - want.calinski_harabasz) < 1e-6 and abs(found[k].davies_bouldin - want.davies_bouldin) < 1e-9
        base = cluster.assign(d, cols, fits[3].centres.tolist(), "base")
        ari = cluster.adjusted_rand(cluster.assign(base, cols, fit.centres.tolist()), "base", "cluster").head().ari
        assert abs(replicates.agreement(p, {k: fit}, fits[3])[k] - ari) < 1e-12


def test_labels_are_dealt_by_the_order_of_a_hash(spark):
    # Keys that agree modulo 1,000,003 have equal hashes in all runs: cuts fall between them by key.
    keys = [*range(400), *(7 + 1_000_003 * j for j in range(1, 120))]
    own = {k: i % 4 for i, k in enumerate(keys)}
    d = spark.createDataFrame([(k, y) for k, y in own.items()], "key long, y int").repartition(3)
    sizes = [sum(y == c for y in own.values()) for c in range(4)]
    labels = replicates.dealt_labels(d, sizes, 30)
    folds = replicates.dealt_folds(d, labels, range(-1, 30), sizes, 5, 1)
    x, y = np.array(keys), np.array(list(own.values()))
    kept = []
    for run in range(30):
        got = labels.of(x, y, run)
        order = sorted(keys, key=lambda k: (int(replicates.hashes(np.array([k]), run)[0]), k))
        want = dict(zip(order, np.repeat(range(4), sizes).tolist()))
        assert got.tolist() == [want[k] for k in keys]
        kept.append((got == y).mean())
    # By chance a quarter of the rows keeps its label; no run is near the whole.
    assert abs(np.mean(kept) - 0.25) < 0.03 and max(kept) < 0.5
    for run in (-1, 0, 7):
        label = labels.of(x, y, run)
        fold = folds.of(x, label, run)
        assert all(max(n) - min(n) <= 1 for n in (np.bincount(fold[label == c], minlength=5).tolist() for c in range(4)))
    one = spark.createDataFrame([(1, 0)], "key long, y int")
    assert replicates.dealt_labels(one, [1], 2).of(np.array([1]), np.array([0]), 1).tolist() == [0]


def test_shuffled_columns_keep_values_and_lose_ties(spark):
    rng = random.Random(2)
    rows = [(k, [(v := rng.gauss(0, 1)), 2 * v, -v]) for k in range(200)]
    x = np.array([v for _, v in rows])
    deal = replicates.shuffled_columns(3)
    for run in range(3):
        own = deal(np.arange(200), x, run)
        assert (own == deal(np.arange(200), x, run)).all()
        assert (np.sort(own, 0) == np.sort(x, 0)).all() and ((own == x).sum(0) < 10).all()
        assert abs(np.corrcoef(own[:, 0], own[:, 1])[0, 1]) < 0.3
    blocks = replicates.in_blocks(replicates.points(table_of(spark, rows), "id", ["x0", "x1", "x2"]))
    got = sorted((r.key, r.x) for r in blocks.mapInArrow(replicates._pieces, "key bigint, x array<double>").collect())
    assert got == rows


def test_features_are_written_once(spark, monkeypatch):
    """What the nulls write doesn't grow with the number of runs."""
    from sensorloom.operators import classify
    from sensorloom.session import written

    cols, sizes = ["x0", "x1", "x2"], []
    d = table_of(spark, blobs(90)).withColumn("y", (F.col("id") % 3).cast("int"))

    def counted(df, name):
        out = written(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(replicates, "written", counted)
    monkeypatch.setattr(classify, "written", counted)
    for null in (lambda n: cluster.permutation_null(d, "id", cols, "y", n), lambda n: cluster.shuffle_null(d, "id", cols, 3, n, 2), lambda n: classify.permutation_test(d, "id", cols, "y", n)):
        seen = []
        for reps in (2, 40):
            sizes.clear()
            assert null(reps).count() > 0
            seen.append(list(sizes))
        assert seen[0] == seen[1] and all(n <= 90 for _, n in seen[0])


def test_permuted_refits_of_planted_and_of_no_classes(spark):
    from sensorloom.operators import classify

    cols = ["x0", "x1", "x2"]
    d = table_of(spark, blobs(150)).withColumn("y", (F.col("id") % 3).cast("int"))
    found = classify.permutation_test(d, "id", cols, "y", 200).head()
    assert found.balanced_accuracy > 0.95 and found.p == 1 / 201 and found.reps == 200 and found.verdict == "separable: strong" and found.status == "ok"
    rng = random.Random(11)
    noise = table_of(spark, [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(150)]).withColumn("y", (F.col("id") % 3).cast("int"))
    found = classify.permutation_test(noise, "id", cols, "y", 200).head()
    assert found.p > 0.05 and found.verdict == "at chance" and abs(found.balanced_accuracy - 1 / 3) < 0.15


def test_nulls_of_blobs_and_of_noise(spark):
    cols = ["x0", "x1", "x2"]
    found = cluster.shuffle_null(table_of(spark, blobs(90)), "id", cols, 3, 19, 3).head()
    assert found.z > 3 and found.p == 0.0 and found.reps == 19
    rng = random.Random(1)
    noise = table_of(spark, [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(90)])
    assert cluster.copula_null(noise, "id", cols, 3, 19, 3).head().p > 0.05
    assert cluster.copula_null(table_of(spark, blobs(90)), "id", cols, 3, 19, 3).head().p < 0.2


def test_normal_distribution():
    from statistics import NormalDist

    from sensorloom.operators import normal

    x = np.linspace(-7, 7, 1001)
    assert np.abs(normal.cdf(x) - [NormalDist().cdf(v) for v in x]).max() < 1e-13
    p = np.r_[1e-9, 1e-5, np.linspace(0.001, 0.999, 999), 1 - 1e-5, 1 - 1e-9]
    assert np.abs(normal.inverse(p) - [NormalDist().inv_cdf(v) for v in p]).max() < 1e-6


def test_copula_draws_lie_on_the_whole_marginals(spark):
    """Every drawn value is the interpolation between two of all sorted values, whatever the size of a block."""
    rng = np.random.default_rng(4)
    n, cols = 5_000, ["x0", "x1", "x2"]
    x = rng.gamma(2.0, 1.0, (n, 3))
    x[:, 1] = x[:, 0] + rng.normal(size=n)
    x[:, 2] = np.round(x[:, 2])  # many ties
    d = table_of(spark, list(enumerate(x.tolist())))
    order = lambda v: (np.searchsorted(np.sort(v), v, "left") + np.searchsorted(np.sort(v), v, "right") + 1) / 2
    from sensorloom.operators import normal

    want = np.cov(np.stack([normal.inverse((order(x[:, j]) - 0.5) / n) for j in range(3)]))
    covariance, sizes = cluster.normal_covariance(d, "id", cols)
    assert np.abs(covariance - want).max() < 1e-9 and sizes == [n] * 3
    low = np.linalg.cholesky(covariance + 1e-9 * np.eye(3))
    for values in (cluster.VALUES, 700):
        got = cluster.gaussian_copula_draws(d, "id", cols, 6, 9, values).toPandas().sort_values(["rep", "row"])
        assert len(got) == 6 * n and not got.isnull().any().any()
        u = np.concatenate([cluster.drawn(9, k, min(cluster.DRAWS, 6 * n - k * cluster.DRAWS), low) for k in range(2)])
        for j, c in enumerate(cols):
            at = u[:, j] * (n - 1)
            assert np.abs(got[c].to_numpy() - np.interp(at, np.arange(n), np.sort(x[:, j]))).max() < 1e-9
    assert cluster.gaussian_copula_draws(d.limit(0), "id", cols, 3).count() == 0


def test_logistic_has_no_slope_left(spark):
    rng = np.random.default_rng(5)
    n = 150
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1]
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int) + (x[:, 1] > 3)
    fold = np.arange(n) % 3
    d = spark.createDataFrame([(k, 7, int(y[k]), int(fold[k]), x[k].tolist()) for k in range(n)], "key long, run int, y int, fold int, x array<double>")
    for balanced in (False, True):
        model = replicates.logistic_runs(d, 3, 3, balanced)
        for f in range(3):
            own = fold != f
            z = (x[own] - x[own].mean(0)) / x[own].std(0)
            z = np.c_[z, np.ones(own.sum())]
            w = (own.sum() / (3 * np.bincount(y[own], minlength=3)))[y[own]] if balanced else np.ones(own.sum())
            p = np.exp(z @ model.weights[7, f].T)
            p /= p.sum(1, keepdims=True)
            slope = ((p - np.eye(3)[y[own]]) * w[:, None]).T @ z + model.weights[7, f] * [1, 1, 1, 0]
            assert np.abs(slope).max() < 1e-4
        out = replicates.out_of_fold_shares(d, model).collect()
        assert len(out) == n and all(np.allclose(r.probability, model.shares(7, r.fold, x[[r.key]])[0]) for r in out)


def test_frozen_clusters_name_another_cohort(spark):
    rows = blobs(90)
    d = table_of(spark, rows)
    scaler, centres = cluster.frozen(d, "id", ["x0", "x1", "x2"], 3, "x0", "x1")
    names = {r.id: r.name for r in cluster.projected(d.where("id < 30"), "id", scaler, centres).collect()}
    assert len(names) == 30 and all(names[k] == ["Hypo-Prone", "Spiker", "Stable"][k % 3] for k in names)


def test_top_loadings_and_recurrence(spark):
    d = spark.createDataFrame([(1, "a", -0.9), (1, "b", 0.5), (1, "c", 0.5), (2, "a", 0.1)], "pc int, variable string, loading double")
    assert [(r.pc, r.variable, r.place) for r in cluster.top_loadings(d, 2).orderBy("pc", "place").collect()] == [(1, "a", 1), (1, "b", 2), (2, "a", 1)]
    runs = cluster.membership_runs(table_of(spark, blobs(60)).withColumn("_low", F.col("x0")), "id", [["x0", "x1", "x2"], ["x0", "x1"]], 3, "_low", 3, 1)
    assert {r.arm: r["count"] for r in runs.select("arm", "run").distinct().groupBy("arm").count().collect()} == {"set 1": 3, "set 2": 3, "leave one out": 3, "bisecting": 1, "mixture": 1}
    share = {r.id: r.frequency for r in cluster.recurrence(runs, "id", "flag").collect()}
    assert min(share[k] for k in range(0, 60, 3)) > 0.5 and max(share[k] for k in range(1, 60, 3)) < 0.5


def test_silhouettes_over_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(130, 3)), np.r_[rng.integers(0, 3, 129), 9]
    x[:, 0] += y
    d = table_of(spark, list(enumerate(x.tolist()))).join(spark.createDataFrame([(k, int(c)) for k, c in enumerate(y)], "id long, y int"), "id")
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = {}
    for k in range(130):
        mean = {c: far[k, y == c].sum() / ((y == c).sum() - (c == y[k])) for c in set(y.tolist()) if (y == c).sum() > (c == y[k])}
        a, b = mean.get(y[k]), min(v for c, v in mean.items() if c != y[k])
        want[k] = 0.0 if a is None else (b - a) / max(a, b)
    for block, step in ((10_000, 1_000), (40, 7), (9, 4)):
        monkeypatch.setattr(cluster, "BLOCK", block)
        monkeypatch.setattr(cluster, "STEP", step)
        got = {r.id: r.silhouette for r in cluster.silhouettes(d, "id", ["x0", "x1", "x2"], "y").collect()}
        assert len(got) == 130 and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_null_draws_are_stored_as_small_blocks(spark, monkeypatch):
    """The draws of the null are those of the operator, and no shuffled or full-width copy of them is written."""
    sizes = []
    real = cluster.written
    monkeypatch.setattr(cluster, "written", lambda df, name: sizes.append((name, df.columns)) or real(df, name))
    d, cols = table_of(spark, blobs(150)), ["x0", "x1"]
    monkeypatch.setattr(cluster, "DRAWS", 100)
    blocks = cluster.drawn_blocks(d, "id", cols, 4, 3)
    assert sizes == [("draws", ["run", "first", "rows", "values"])]
    n = d.count()
    want = cluster.gaussian_copula_draws(d, "id", cols, 4, 3).toPandas().sort_values(["rep", "row"])[cols].to_numpy()
    got = np.full(want.shape, np.nan)
    for r in blocks.collect():
        at = r["run"] * n + r["first"]
        got[at : at + r["rows"]] = np.frombuffer(r["values"], "<f4").reshape(r["rows"], -1)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6)
    monkeypatch.setattr(cluster, "gaussian_copula_draws", lambda *a: 1 / 0)
    assert cluster.copula_null(d, "id", cols, 3, 5, 2).head()["reps"] == 5


def test_fits_of_a_run_share_a_product():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(9_000, 4)), rng.integers(0, 3, 9_000).astype(float)
    for mask in (None, np.array([True, False, True, True])):
        fits = [replicates.Fit(rng.normal(size=(3, 4)), 0.0, mask) for _ in range(5)]
        for fit, got in zip(fits, replicates._nearest_sums(x, w, fits), strict=True):
            far = fit.distances(x)
            near = far.argmin(1)
            held = (near == np.arange(3)[:, None]) * w
            assert np.allclose(got, np.r_[(w * far.min(1)).sum(), held.sum(1), (held @ x).ravel()])


def test_curvature_is_sent_without_what_follows_from_it():
    rng = np.random.default_rng(2)
    for classes, width in ((1, 3), (2, 4), (3, 16), (5, 2)):
        z, w = rng.normal(size=(200, width)), rng.random(200)
        p = rng.random((200, classes))
        p /= p.sum(1, keepdims=True)
        hot = np.eye(classes)[rng.integers(0, classes, 200)]
        packed = replicates._Curved(classes, width)
        sent = packed.sums(z, p, hot, w)
        slope, bend = packed.whole(sent)
        want = np.empty((classes, width, classes, width))
        for a in range(classes):
            for b in range(classes):
                want[a, :, b] = z.T @ (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None])
        assert np.allclose(slope, (((p - hot) * w[:, None]).T @ z).ravel()) and np.allclose(bend.reshape(want.shape), want)
        assert len(sent) <= classes * width * (classes * width + 3) / 2
    # The size that accuracy_permutations sends for a fold: 3 classes, 15 features.
    assert len(replicates._Curved(3, 16).sums(np.ones((1, 16)), np.full((1, 3), 1 / 3), np.eye(3)[:1], np.ones(1))) == 440


def _plain(x, centres, iterations=50):
    """Steps of k-means over all rows: centres and cost."""
    for _ in range(iterations):
        far = ((x[:, None] - centres) ** 2).sum(2)
        near, cost = far.argmin(1), far.min(1).sum()
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-9:
            break
    return centres, cost


def test_fits_in_memory_look_again_at_few_rows(monkeypatch):
    rng = np.random.default_rng(8)
    seen, real = [], replicates._nearest
    monkeypatch.setattr(replicates, "_nearest", lambda x, *a: seen.append(len(x)) or real(x, *a))
    cloud = rng.normal(size=(9_000, 4)) * [3.0, 1.0, 1.0, 0.3]
    far_off = np.r_[cloud[:2_000], [[1e4, 0, 0, 0], [0, -1e5, 0, 0]]]
    alike = rng.integers(0, 2, (1_000, 2)).astype(float)
    for x, k in ((cloud, 3), (cloud, 2), (cloud, 6), (cloud[:300], 1), (far_off, 3), (alike, 3), (alike, 5), (cloud[:2], 3), (np.zeros((50, 2)), 2)):
        for run in range(3):
            seen.clear()
            got = replicates.fit_held(x, k, 4, run, seed=1)
            head = x[: replicates.SAMPLE]
            want = [_plain(x, replicates._starts(head, np.ones(len(head)), k, replicates._start_seed(1, run, s))) for s in range(4)]
            best = min(cost for _, cost in want)
            size = 1 + (x**2).sum()
            assert abs(got.cost - best) < 1e-9 * size
            assert any(np.allclose(got.centres, c, atol=1e-6) for c, cost in want if cost - best < 1e-9 * size)
    x = rng.normal(size=(20_000, 4))
    seen.clear()
    replicates.fit_held(x, 3, 1, 0, seed=2)
    assert sum(seen) < 15 * len(x)


def test_draws_of_a_null_stay_in_their_task(spark, monkeypatch):
    """The null writes no draw, and finds what passes over written draws find."""
    rng = np.random.default_rng(6)
    x = rng.gamma(2.0, 1.0, (150, 3))
    x[:, 1] += x[:, 0]
    d, cols = table_of(spark, list(enumerate(x.tolist()))), ["x0", "x1", "x2"]
    for size in (cluster.DRAWS, 100, 64):
        monkeypatch.setattr(cluster, "DRAWS", size)
        blocks = cluster.drawn_blocks(d, "id", cols, 21, 3)
        scaled = replicates.standard_scores(blocks, range(21))
        want = replicates.quality(blocks, replicates.fit_runs(blocks, range(21), 3, 4, seed=3, deal=scaled), scaled)
        got = cluster.held_silhouettes(d, "id", cols, 3, 21, 4, 3)
        assert list(got) == list(range(21)) and max(abs(got[r] - want[r].silhouette) for r in got) < 1e-9
    monkeypatch.setattr(cluster, "written", lambda *a: 1 / 0)
    assert cluster.copula_null(d, "id", cols, 3, 21, 2).head()["reps"] == 21
    empty = d.withColumn("x2", F.lit(None).cast("double"))
    assert cluster.held_silhouettes(empty, "id", cols, 3, 21, 4, 3) == {}
