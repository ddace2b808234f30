"""Vector queries on arrays whose first four components say nothing and whose others say all."""

import random

import pytest

from sensorloom.plans import cluster_queries as q


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 0.01) for _ in range(4)] + [rng.gauss(9.0 * (j == k % 3), 0.01) for j in range(4)], k % 3) for k in range(90)]
    path = str(tmp_path_factory.mktemp("wide"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_classes(spark, wide):
    got = q.QUERIES["logistic_out_of_fold"](spark, wide).collect()
    assert len(got) == 6 and min(r.recall for r in got) > 0.9 and {r.arm for r in got} == {"plain", "balanced"}


def test_clusters(spark, wide):
    null = {r.run: (r.silhouette, r.p) for r in q.QUERIES["label_permutations"](spark, wide).collect()}
    assert null[-1][0] > 0.99 and max(v for k, (v, _) in null.items() if k >= 0) < 0.5 and null[-1][1] == 0.001
    assert min(r.silhouette for r in q.QUERIES["silhouettes"](spark, wide).collect()) > 0.99
    assert q.QUERIES["dispersion_indices"](spark, wide).head().davies_bouldin < 0.01


def test_columns(spark, wide):
    names = [f"x{k}" for k in range(8)]
    assert q.QUERIES["copula_draws"](spark, wide).columns == ["rep", "n", *names]
    assert {r.variable for r in q.QUERIES["principal_components"](spark, wide).collect()} == set(names)
