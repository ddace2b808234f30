import random
"""Trees of many runs in shared passes: planted classes, noise, and one tree against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import classify, replicates, stats, trees


def frame(spark, x, y):
    cols = [f"x{j}" for j in range(x.shape[1])]
    d = spark.createDataFrame([(k, *map(float, v), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "id long, " + ", ".join(f"{c} double" for c in cols) + ", y int")
    return d.repartition(2), cols


def planted(n=300, seed=1):
    """Three classes, the last one rare; the first two features tell them."""
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(n) % 12 == 0, 2, np.arange(n) % 2)
    x = rng.normal(size=(n, 5))
    x[:, 0] += 4 * (y == 1)
    x[:, 1] += 4 * (y == 2)
    return x, y


def recalls(df):
    return {r["class"]: r["recall"] for r in classify.class_metrics(df.where("predicted is not null"), "actual", "predicted").collect()}


def test_quantiles_are_those_of_the_whole_column(spark):
    rng = np.random.default_rng(0)
    rows = [(k % 3, float(np.round(v, 1)), None if k % 7 == 0 else float(k)) for k, v in enumerate(rng.normal(size=500))]
    d = spark.createDataFrame(rows, "g int, a double, b double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = stats.quantiles(d, ["a", "b"], shares)
    for j, c in ((1, "a"), (2, "b")):
        assert np.allclose(got[c], np.quantile([r[j] for r in rows if r[j] is not None], shares))
    each = {(r.g, r.variable, r.k): r.value for r in stats.group_quantiles(d, "g", ["a", "b"], shares).collect()}
    for (g, c, k), v in each.items():
        assert abs(v - np.quantile([r[1 + (c == "b")] for r in rows if r[0] == g and r[1 + (c == "b")] is not None], shares[k])) < 1e-9
    assert len(each) == 3 * 2 * len(shares)
    assert stats.quantiles(d.where("false"), ["a"], [0.5]) == {"a": [None]}


def test_first_cut_is_the_best_of_all(spark):
    x, y = planted(200)
    d, cols = frame(spark, x, y)
    rows, classes = trees.binned(d, "id", cols, "y")
    assert classes == 3
    forest = trees.grow_forest(rows, classes, 4, True, 1, seed=3)
    held = sorted((r.key, r.b, r.y) for r in rows.collect())
    b, own = np.stack([np.frombuffer(r[1], np.uint8) for r in held]), np.array([r[2] for r in held])
    keys, w = np.array([r[0] for r in held]), forest.weights[own]
    for t, tree in enumerate(forest.trees):
        times = replicates.poisson_draws(3)(keys, t) * w
        best = (-1.0, None)
        for f in np.random.default_rng([3, t, 0]).permutation(5)[:2]:
            for cut in range(trees.BINS - 1):
                sides = [np.bincount(own[s], times[s], 3) for s in ((b[:, f] <= cut), (b[:, f] > cut))]
                if all(s.sum() for s in sides):
                    gain = sum((s**2).sum() / s.sum() for s in sides)
                    best = max(best, (gain, (int(f), cut)), key=lambda v: v[0])
        node = tree.walk(b)
        got = sum((v**2).sum() / v.sum() for v in (np.bincount(own[node == c], times[node == c], 3) for c in (1, 2)))
        assert abs(got - best[0]) < 1e-9 and len(tree.feature) == 3


def test_forest_out_of_bag(spark):
    x, y = planted()
    d, cols = frame(spark, x, y)
    out = classify.forest_out_of_bag(d.unionByName(d.limit(3).withColumn("x0", F.lit(None).cast("double"))), "id", cols, "y", 60, 6)
    rows = out.collect()
    assert len(rows) == len(y) and all(10 < r.votes < 35 for r in rows)
    assert min(recalls(out).values()) > 0.8
    # A row's votes are those of the trees whose draws leave it out.
    left = [sum(replicates.poisson_draws(0)(np.array([r.id]), t)[0] == 0 for t in range(60)) for r in rows[:5]]
    assert left == [r.votes for r in rows[:5]]
    noise = np.random.default_rng(9).normal(size=x.shape)
    found = recalls(classify.forest_out_of_bag(frame(spark, noise, np.arange(len(y)) % 3)[0], "id", cols, "y", 60, 6))
    assert abs(np.mean(list(found.values())) - 1 / 3) < 0.12


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting(spark, classes):
    x, y = planted()
    y = np.minimum(y, classes - 1)
    d, cols = frame(spark, x, y)
    out = classify.boosted_out_of_fold(d, "id", cols, "y", [2, 20], 3, 2, 12)
    rows = out.collect()
    assert len(rows) == len(y) * 4 and {(r.rep, r.fold, r.leaf) for r in rows} == {(a, b, c) for a in (0, 1) for b in range(3) for c in (2, 20)}
    assert all(abs(sum(r.probability) - 1) < 1e-9 and len(r.probability) == classes for r in rows)
    assert min(recalls(out.where("leaf = 2")).values()) > 0.75
    noise = np.random.default_rng(9).normal(size=x.shape)
    found = recalls(classify.boosted_out_of_fold(frame(spark, noise, np.arange(len(y)) % classes)[0], "id", cols, "y", [20], 3, 1, 6))
    assert abs(np.mean(list(found.values())) - 1 / classes) < 0.12


def test_more_tasks_same_trees(spark):
    x, y = planted(250)
    d, cols = frame(spark, x, y)
    rows, classes = trees.binned(d, "id", cols, "y")
    one = trees.grow_forest(rows, classes, 5, depth=4)
    many = trees.grow_forest(rows.repartition(3), classes, 5, depth=4)
    assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() for a, b in zip(one.trees, many.trees, strict=True))


def test_waves_bound_what_a_task_holds():
    from sensorloom.operators import trees

    assert list(trees._waves([3, 4, 5, 7], [5, 5, 20, 1], 10)) == [[3, 4], [5], [7]]
    assert list(trees._waves([], [], 10)) == []


def test_trees_in_waves_are_the_same(spark, monkeypatch):
    from sensorloom.operators import replicates, trees

    rng = random.Random(4)
    d = spark.createDataFrame([(k, rng.random(), rng.random(), k % 3) for k in range(200)], "id long, a double, b double, y int")
    rows, classes = trees.binned(d, "id", ["a", "b"], "y")
    one = trees.grow_forest(rows, classes, 4, depth=3)
    parts = []
    real = replicates.Spread.sums
    monkeypatch.setattr(replicates.Spread, "sums", lambda self, runs, *more: parts.append(len(runs)) or real(self, runs, *more))
    monkeypatch.setattr(trees, "HELD", 1)
    many = trees.grow_forest(rows, classes, 4, depth=3)
    assert max(parts) == 1
    assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() for a, b in zip(one.trees, many.trees, strict=True))
