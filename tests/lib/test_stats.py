"""Small fixtures and invariants of the statistics, clustering and classification operators."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sensorloom.operators import classify, cluster, cohort, stats


def test_mid_ranks_and_ties(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0)], "i int, v double").withColumn("name", F.lit("x"))
    assert {r.i: r["rank"] for r in stats.mid_ranks(d, ["name"], "v").collect()} == {1: 1.5, 2: 1.5, 3: 3.0}
    tied = d.withColumn("v", F.lit(1.0)).withColumn("g", F.col("i") % 2)
    assert stats.kruskal_wallis(tied, ["name"], "v", "g").head().h is None


def test_u_statistics_mirror(spark):
    rng = random.Random(2)
    rows = [("x", rng.choice("ab"), float(rng.randrange(12))) for _ in range(60)]
    d = spark.createDataFrame(rows, "name string, g string, v double")
    one, two = (stats.mann_whitney(d, ["name"], "v", "g", *p).head() for p in (("a", "b"), ("b", "a")))
    a, b = ([v for _, g, v in rows if g == x] for x in "ab")
    assert one.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert one.u + two.u == len(a) * len(b) and abs(one.cliffs_delta + one.rank_biserial) < 1e-12


def test_exact_u():
    p = stats.exact_u(3, 4)
    assert abs(p[-1] - 1) < 1e-12 and abs(p[0] - 1 / 35) < 1e-12 and len(p) == 13


def test_false_discovery(spark):
    d = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.04,), (None,)], "p double")
    assert [None if r.q is None else round(r.q, 9) for r in stats.benjamini_hochberg(d).collect() if r.p is not None] == [0.04] * 4
    assert stats.benjamini_hochberg(d, missing_is_one=True).where("p is null").head().q == 1.0


def test_fisher_and_least_squares(spark):
    assert abs(stats.fisher_exact(3, 1, 1, 3) - 0.4857142857) < 1e-9
    d = spark.createDataFrame([(float(2 * x + 3 * g + 1), float(x), g) for x in range(6) for g in (0, 1)], "y double, x double, g int")
    b = stats.least_squares(d, "y", {"x": F.col("x"), "g": F.col("g")})
    assert abs(b["x"][0] - 2) < 1e-9 and abs(b["g"][0] - 3) < 1e-9 and abs(b["intercept"][0] - 1) < 1e-9


def test_equal_partitions(spark):
    d = spark.createDataFrame([(k % 3, (k + 1) % 3 * 7) for k in range(30)], "a int, b int")
    assert cluster.adjusted_rand(d, "a", "b").head().ari == 1.0


def planted(spark):
    rng = random.Random(1)
    rows = [(k, k % 3, 10.0 * (k % 3) + rng.random(), 5.0 * (k % 3) ** 2 + rng.random()) for k in range(90)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double")


def test_planted_clusters(spark):
    d = planted(spark)
    z = cohort.standard_scores(d, ["a", "b"])
    got = cluster.assign(z, ["a", "b"], cluster.fit_centres(z, "id", ["a", "b"], 3)[0])
    assert cluster.adjusted_rand(got, "y", "cluster").head().ari == 1.0
    s = cluster.silhouettes(d, "id", ["a", "b"], "y")
    assert s.where("silhouette < 0.8 or silhouette > 1").count() == 0


def test_planted_classes(spark):
    d = classify.stratified_folds(planted(spark), "id", "y", 3)
    assert d.groupBy("y", "fold").count().where("count <> 10").count() == 0
    for oof in (classify.logistic_out_of_fold(d, "id", ["a", "b"], "y", 3, True), classify.boosted_out_of_fold(planted(spark), "id", ["a", "b"], "y", [2], 3, 1, 6)):
        assert classify.balanced_accuracy(classify.class_metrics(oof, "actual", "predicted")).head().balanced_accuracy > 0.95
        assert classify.macro_auc(oof, "actual", "probability", 3).head().macro_auc > 0.99
        assert all(abs(sum(r.probability) - 1) < 1e-9 for r in oof.collect())


def test_permutations_of_planted_and_random_labels(spark):
    rng = random.Random(4)
    d = planted(spark)
    got = classify.permutation_test(d, "id", ["a", "b"], "y", reps=19, folds=3).head()
    assert got.balanced_accuracy == 1.0 and got.p == 1 / 20 and got.ci_low == 1.0 and got.reps == 19
    noise = spark.createDataFrame([(k, k % 2, rng.random(), rng.random()) for k in range(80)], "id long, y int, a double, b double")
    assert classify.permutation_test(noise, "id", ["a", "b"], "y", reps=19, folds=4).head().p > 0.05


def test_arms_use_the_same_rows(spark):
    rows = [(k, k % 2, float(k % 2) + 0.01 * k, None if k % 5 == 0 else 1.0 * k) for k in range(60)]
    d = spark.createDataFrame(rows, "id long, y int, a double, b double")
    found = {name: {r.id for r in some.collect()} for name, some, _ in classify.arms(d, {"a": ["a"], "b": ["b"]})}
    assert found["a"] == found["b"] == found["both"] == {k for k in range(60) if k % 5} and found["a, all rows"] == set(range(60))
    out = {r.arm: r for r in classify.compare_arms(d, "id", {"a": ["a"], "b": ["b"]}, "y", reps=3, folds=3).collect()}
    assert len(out) == 4 and out["a"].branch == "A" and sum(r.leads for r in out.values()) == 1


def test_boosted_bootstrap_is_the_same_as_by_rows(spark):
    from sensorloom.operators import replicates

    rng = random.Random(6)
    rows = [(k, rng.randrange(3), rng.randrange(3)) for k in range(70)]
    got = classify.bootstrap_interval(spark.createDataFrame(rows, "id long, a int, p int"), "id", "a", "p", 40).head()
    each = []
    for r in range(40):
        w = replicates.poisson_draws()(np.array([k for k, _, _ in rows]), r)
        each.append(np.mean([sum(x for x, (_, a, p) in zip(w, rows) if a == c == p) / sum(x for x, (_, a, _) in zip(w, rows) if a == c) for c in range(3)]))
    assert abs(got.ci_low - np.quantile(each, 0.025)) < 1e-12 and abs(got.ci_high - np.quantile(each, 0.975)) < 1e-12


def test_p_of_t_and_intervals(spark):
    # Student's t: with one degree of freedom it is Cauchy's, with two it has a closed form.
    assert abs(stats.student_p(1.0, 1) - 0.5) < 1e-6
    for t in (0.3, 1.7, 4.0):
        assert abs(stats.student_p(t, 2) - (1 - t / math.sqrt(2 + t * t))) < 1e-6
    assert abs(stats.student_p(2.0, 10_000) - stats.normal_p(2.0)) < 1e-4
    assert abs(stats.student_quantile(0.05, 10) - 2.228139) < 1e-4
    d = spark.createDataFrame([(float(x), 2.0 * x + (-1) ** x) for x in range(20)], "x double, y double")
    got = {r.term: r for r in stats.coefficients(d, "y", {"x": F.col("x")}).collect()}
    assert got["x"].low < 2 < got["x"].high and got["x"].p < 1e-6 and abs(got["x"].t - got["x"].beta / got["x"].se) < 1e-9


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(8)
    rows = list({(rng.choice("ab"), rng.randrange(500)): rng.randrange(1, 9) for _ in range(400)}.items())
    d = spark.createDataFrame([(b, v, n) for (b, v), n in rows], "b string, v int, n long")
    for down in (False, True):
        got = {(r.b, r.v): r.n_upto for r in stats.running_sums(d, ["b"], "v", ["n"], down).collect()}
        assert got == {(b, v): sum(m for (c, w), m in rows if c == b and (w >= v if down else w <= v)) for (b, v), _ in rows}


def test_class_never_predicted(spark):
    d = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "a int, p int")
    m = {r["class"]: (r.recall, r.precision) for r in classify.class_metrics(d, "a", "p").collect()}
    assert m[1] == (0.0, 0.0) and m[0] == (1.0, 1 / 3)


def test_guards_and_joins(spark):
    import pytest

    d = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    with pytest.raises(cohort.GuardError):
        cohort.assert_unique(d, "k")
    e = spark.createDataFrame([(1, 200), (1, 400)], "k int, t int")
    o = spark.createDataFrame([(1, 20), (1, 370)], "k int, t int")
    # 200: 20 is exactly 180 before; 400: 370 is exactly 30 before. Both ends count.
    assert cohort.not_preceded(e, o, "k", "t", "t", 180, 30).count() == 0
    assert cohort.not_preceded(e, o, "k", "t", "t", 179, 31).count() == 2
    med = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0)], "k int, v double")
    assert {r.k: r.v for r in cohort.fill_medians(med, ["v"]).collect()} == {1: 1.0, 2: 2.5, 3: 4.0}


def test_copula_keeps_marginals(spark):
    rng = random.Random(5)
    rows = [(k, (x := rng.gauss(0, 1)), x + 0.2 * rng.gauss(0, 1)) for k in range(400)]
    d = spark.createDataFrame(rows, "id long, a double, b double")
    got = cluster.gaussian_copula_draws(d, "id", ["a", "b"], 3).agg(F.corr("a", "b").alias("r"), F.min("a").alias("lo"), F.max("a").alias("hi")).head()
    assert got.r > 0.9 and got.lo >= min(r[1] for r in rows) - 1e-9 and got.hi <= max(r[1] for r in rows) + 1e-9
    assert not math.isnan(got.r)


def test_chances_are_those_of_the_distributions(spark):
    from statistics import NormalDist

    from sensorloom.operators import chances

    z = [0.0, 0.3, 1.0, 1.96, 2.9, 3.1, 4.2, 5.5, 8.0, 20.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(chances.normal_p(F.col("z")).alias("p")).collect()]
    assert all(math.isclose(a, math.erfc(v / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-300) or v > 1.9 and math.isclose(a, math.erfc(v / math.sqrt(2)), rel_tol=1e-7) for a, v in zip(got, z))
    # Chi-squared: one degree is a squared normal, two exponential; more by the recurrence of its density's integral.
    rows = [(h, d) for h in (0.0, 0.5, 3.0, 9.0, 40.0) for d in range(1, 12)]
    got = {(r.h, r.d): r.p for r in spark.createDataFrame(rows, "h double, d int").withColumn("p", chances.chi_squared_p(F.col("h"), F.col("d"))).collect()}
    want = {(h, 1): math.erfc(math.sqrt(h / 2)) for h, _ in rows} | {(h, 2): math.exp(-h / 2) for h, _ in rows}
    for h, d in rows:
        if d > 2:
            want[h, d] = want[h, d - 2] + (h / 2) ** (d / 2 - 1) * math.exp(-h / 2) / math.gamma(d / 2)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in rows)
    rows = [(t, d) for t in (0.0, 0.1, 1.0, 2.2, -3.0, 9.0) for d in (1, 2, 3, 7, 30, 151, 2_000, 9_999, 10_001, 300_000)]
    got = {(r.t, r.d): r.p for r in spark.createDataFrame(rows, "t double, d int").withColumn("p", chances.student_p(F.col("t"), F.col("d"))).collect()}
    # By Simpson's rule, whose steps are too wide for very many degrees of freedom.
    assert all(abs(got[t, d] - stats.student_p(t, d)) < 1e-7 for t, d in rows if d < 100_000)
    assert abs(got[2.2, 300_000] - 2 * NormalDist().cdf(-2.2)) < 1e-5


def test_small_samples_are_exact(spark):
    import itertools

    rng = random.Random(8)
    rows, want = [], {}
    for g in range(12):
        n1, n2 = rng.choice([1, 2, 3, 4]), rng.choice([1, 3, 5, 6])
        values = rng.sample(range(1000), n1 + n2)
        rows += [(g, int(k >= n1), float(v)) for k, v in enumerate(values)]
        u = lambda own: sum(a > b for a in own for b in set(values) - set(own))  # noqa: B023, E731
        every = [u(c) for c in itertools.combinations(values, n1)]
        mine = u(values[:n1])
        low = min(mine, n1 * n2 - mine)
        want[g] = min(1.0, 2 * sum(x <= low for x in every) / len(every))
    rows += [(50, 0, 1.0), (50, 0, 2.0), (50, 1, 2.0), (50, 1, 3.0)]
    got = {r.g: r for r in stats.mann_whitney(spark.createDataFrame(rows, "g int, c int, value double"), ["g"], "value", "c", 0, 1, p=True).collect()}
    assert all(got[g].exact and abs(got[g].p - want[g]) < 1e-12 for g in want)
    assert not got[50].exact and abs(got[50].p - math.erfc(got[50].z / math.sqrt(2))) < 1e-9


def test_fisher_from_the_mode_outwards():
    rng = random.Random(2)
    for _ in range(300):
        a, b, c, d = (rng.choice([0, 1, 2, 5, 17, 60]) for _ in range(4))
        row, col, n = a + b, a + c, a + b + c + d
        chance = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        p = sum(v for v in chance.values() if v <= chance[a] * (1 + 1e-7)) / math.comb(n, col)
        assert abs(stats.fisher_exact(a, b, c, d) - p) < 1e-9
    assert 0 < stats.fisher_exact(2_501_000, 2_500_000, 2_500_000, 2_500_000) < 1


def test_ladder_takes_the_first_arm_that_is_large_enough(spark):
    rng = random.Random(3)
    rows = [(k, k % 2, float(k % 2) + rng.gauss(0, 0.1), None if k % 3 else 1.0 * k, k % 10 == 0) for k in range(120)]
    d = spark.createDataFrame(rows, "id long, y int, a double, b double, fasted boolean")
    rungs = [classify.Rung("fasted", ["a"], F.col("fasted")), classify.Rung("paired", ["a", "b"]), classify.Rung("all", ["a"])]
    got = {r.arm: r for r in classify.fit_ladder(d, "id", "y", rungs, reps=9, folds=3).collect()}
    assert got["fasted"].status == "skipped: smallest class 0" and got["fasted"].n == 12 and got["fasted"].balanced_accuracy is None
    assert got["paired"].status == "skipped: smallest class 20" and got["all"].chosen and not got["paired"].chosen
    assert got["all"].balanced_accuracy > 0.95 and got["all"].p == 0.1
    none = classify.fit_ladder(d, "id", "y", rungs[:2]).collect()
    assert len(none) == 2 and not any(r.chosen for r in none)


def test_decisions_by_rules_as_data(spark):
    d = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", None)], "rule string, value double")
    got = {r.rule: (r.value, r.tripped) for r in stats.decisions(d, [("a", 0.6, True), ("b", 0.6, False), ("c", 0.1, True), ("d", 0.1, True)]).collect()}
    assert got == {"a": (0.5, True), "b": (0.5, False), "c": (None, False), "d": (None, False)}


def test_equal_orders_are_tied_whatever_their_row_order(spark, tmp_path):
    import duckdb

    from sensorloom.plans import stats_queries, views

    prices = [0.1, 0.2, 0.3]
    spark.createDataFrame([(k, 0, 1.0, "A") for k in (1, 2)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    rows = [(c, x) for c, own in ((1, prices), (2, prices[::-1])) for x in own]
    orders = spark.createDataFrame(rows, "o_custkey long, o_totalprice double").coalesce(1)
    orders.selectExpr("*", "timestamp'2024-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    assert len({r["mean_price"] for r in views.analysis(spark, str(tmp_path)).collect()}) == 1
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(stats_queries.SQL["mid_ranks"]).fetchall()
    got = [(r["person_id"], r["variable"], r["rank"]) for r in stats_queries.QUERIES["mid_ranks"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {r[2] for r in got if r[1] == "mean_price"} == {1.5}
