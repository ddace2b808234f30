"""Queries of the rank statistics, effect sizes and regressions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.columns import local_hour
from sensorloom.operators import chances, cluster, cohort, series, stats
from sensorloom.plans import cohort_queries
from sensorloom.plans.registering import register
from sensorloom.plans.series_queries import BASE, GRID, R
from sensorloom.plans.views import ANALYSIS, HOUR, LABEL3, analysis, label3, offset, readings
from sensorloom.session import table, written

QUERIES, SQL = {}, {}
query = register(QUERIES, SQL)

VARIABLES = ("bal", "mean_price", "max_price", "n_orders")
L = LABEL3.replace("pid", "person_id")
LONG = f"WITH a AS ({ANALYSIS}), l AS (" + " UNION ALL ".join(f"SELECT person_id, {L} AS c, '{v}' AS variable, {v}::DOUBLE AS value FROM a WHERE {v} IS NOT NULL" for v in VARIABLES) + ")"
RANKS = """k AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY variable, value) AS ties FROM l)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir).select("person_id", label3("person_id").alias("c"), *(F.col(v).cast("double").alias(v) for v in VARIABLES))
    return stats.unpivot(a, ("person_id", "c"), VARIABLES)


@query(f"{LONG}, {RANKS} SELECT person_id, variable, round(rk, 6) AS rank FROM k")
def mid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mid_ranks(_long(spark, sf_dir), ["variable"], "value").select("person_id", "variable", "rank")


KW = f"""{LONG}, {RANKS}, g AS (SELECT variable, c, count(*) AS n, sum(rk) AS s FROM k GROUP BY 1, 2),
t AS (SELECT variable, count(*)::DOUBLE AS n, sum(ties * ties - 1)::DOUBLE AS tie FROM k GROUP BY 1),
h AS (SELECT variable, any_value(t.n) AS n, count(*) AS kk, (12 / (any_value(t.n) * (any_value(t.n) + 1)) * sum(s * s / g.n) - 3 * (any_value(t.n) + 1)) / (1 - any_value(tie) / (any_value(t.n) ** 3 - any_value(t.n))) AS h FROM g JOIN t USING (variable) GROUP BY 1)"""


@query(f"{KW} SELECT variable, n::BIGINT AS n, kk AS k, round(h, 6) AS h, round(greatest(0, (h - kk + 1) / (n - kk)), 6) AS eta2, round(exp(-h / 2), 6) AS p FROM h")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kruskal_wallis(_long(spark, sf_dir), ["variable"], "value", "c")


BH = "least(1, min(p * m / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))"


@query(f"{KW}, p AS (SELECT variable, exp(-h / 2) AS p FROM h), r AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM p) SELECT variable, round(p, 6) AS p, round({BH}, 6) AS q, round(least(1, 3 * p), 6) AS p_bonferroni FROM r")
def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.kruskal_wallis(_long(spark, sf_dir), ["variable"], "value", "c").select("variable", "p")
    return stats.benjamini_hochberg(d).withColumn("p_bonferroni", stats.bonferroni(F.col("p"), 3))


MW = f"""{LONG.replace(', l AS', ', l0 AS')}, l AS (SELECT * FROM l0 WHERE c IN (0, 1)), {RANKS},
g AS (SELECT variable, count(*) FILTER (c = 0) AS n1, count(*) FILTER (c = 1) AS n2, sum(rk) FILTER (c = 0) AS r1, count(*)::DOUBLE AS n, sum(ties * ties - 1)::DOUBLE AS tie FROM k GROUP BY 1),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM g)"""


@query(f"""{MW} SELECT variable, n1, n2, round(u, 6) AS u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial, round(2 * u / (n1 * n2) - 1, 6) AS cliffs_delta,
round(greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))), 6) AS z FROM u""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mann_whitney(_long(spark, sf_dir), ["variable"], "value", "c", 0, 1)


_Z = "greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))))"


@query(f"""{MW}, z AS (SELECT variable, {_Z} AS z FROM u) SELECT variable, round(z, 6) AS z, round({chances.normal_p_sql('z')}, 6) AS p FROM z""")
def mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mann_whitney(_long(spark, sf_dir), ["variable"], "value", "c", 0, 1, p=True).select("variable", "z", "p")


@query()
def mann_whitney_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of two classes in every nation and segment: cells of a few rows, whose p is exact where nothing is tied."""
    d = analysis(spark, sf_dir).select("nation", "segment", label3("person_id").alias("c"), F.col("bal").alias("value"))
    return stats.mann_whitney(d.where("value is not null"), ["nation", "segment"], "value", "c", 0, 1, p=True)


#: Four groups of persons, the last one rare.
_FOUR = "CASE WHEN person_id % 10 = 0 THEN 3 ELSE person_id % 3 END"
_H4 = KW.replace(f"{L} AS c", f"{_FOUR} AS c")


@query(f"{_H4} SELECT variable, n::BIGINT AS n, kk AS k, round(h, 6) AS h, round(greatest(0, (h - kk + 1) / (n - kk)), 6) AS eta2, round({chances.chi_squared_p_sql('greatest(h, 0)', 3)}, 6) AS p FROM h")
def kruskal_four_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _long(spark, sf_dir).withColumn("c", F.when(F.col("person_id") % 10 == 0, 3).otherwise(F.col("person_id") % 3))
    return stats.kruskal_wallis(d, ["variable"], "value", "c")


@query(f"""WITH a0 AS ({ANALYSIS}), a AS (SELECT nation, bal AS x, max_price AS y FROM a0 WHERE max_price IS NOT NULL),
k AS (SELECT nation, rank() OVER (PARTITION BY nation ORDER BY x) + (count(*) OVER (PARTITION BY nation, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY nation ORDER BY y) + (count(*) OVER (PARTITION BY nation, y) - 1) / 2 AS ry FROM a)
SELECT nation, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(analysis(spark, sf_dir).select("nation", "bal", "max_price"), "bal", "max_price", ["nation"])


@query(f"""WITH a0 AS ({ANALYSIS}), a AS (SELECT nation, bal AS x, max_price AS y FROM a0 WHERE max_price IS NOT NULL),
k AS (SELECT nation, rank() OVER (PARTITION BY nation ORDER BY x) + (count(*) OVER (PARTITION BY nation, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY nation ORDER BY y) + (count(*) OVER (PARTITION BY nation, y) - 1) / 2 AS ry FROM a),
r AS (SELECT nation, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY 1), t AS (SELECT *, CASE WHEN 1 - rho * rho > 1e-12 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END AS t, n - 2 AS df FROM r)
SELECT nation, n, round(rho, 6) AS rho, round(t, 6) AS t, df, round({chances.student_p_sql('t', 'df')}, 6) AS p FROM t""")
def spearman_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman_p(stats.spearman(analysis(spark, sf_dir).select("nation", "bal", "max_price"), "bal", "max_price", ["nation"]))


@query(f"""{LONG} SELECT variable, round(CASE WHEN count(*) FILTER (c = 2) >= 2 THEN (avg(value) FILTER (c = 2) - avg(value) FILTER (c <> 2)) /
  sqrt(((count(*) FILTER (c = 2) - 1) * var_samp(value) FILTER (c = 2) + (count(*) FILTER (c <> 2) - 1) * var_samp(value) FILTER (c <> 2)) / (count(*) - 2)) END, 6) AS d FROM l GROUP BY 1""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).groupBy("variable").agg(stats.cohens_d("value", F.col("c") == 2).alias("d"))


@query(f"""WITH a AS ({ANALYSIS}), s AS (SELECT avg(bal) FILTER (g) AS m1, avg(bal) FILTER (NOT g) AS m2, var_samp(bal) FILTER (g) / count(*) FILTER (g) AS s1, var_samp(bal) FILTER (NOT g) / count(*) FILTER (NOT g) AS s2, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2 FROM (SELECT bal, person_id % 3 = 0 AS g FROM a))
SELECT round(m1 - m2, 6) AS gap, round((m1 - m2) / sqrt(s1 + s2), 6) AS t, round((s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)), 4) AS df, round(m1 - m2 - 1.96 * sqrt(s1 + s2), 6) AS low, round(m1 - m2 + 1.96 * sqrt(s1 + s2), 6) AS high FROM s""".replace("4) AS df", "6) AS df"))
def welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analysis(spark, sf_dir).withColumn("g", F.col("person_id") % 3 == 0)
    return d.agg(*(c.alias(k) for k, c in stats.welch("bal", F.col("g")).items()))


@query(f"""WITH a AS ({ANALYSIS}), t AS (SELECT nation, count(*) FILTER (x AND y) AS n11, count(*) FILTER (x AND NOT y) AS n10, count(*) FILTER (NOT x AND y) AS n01, count(*) FILTER (NOT x AND NOT y) AS n00
  FROM (SELECT nation, bal > 5000 AS x, person_id % 2 = 0 AS y FROM a) GROUP BY 1) SELECT *, round(n11 * n00 / nullif(n10 * n01, 0), 6) AS odds_ratio FROM t""")
def odds_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stats.odds_ratio(F.col("bal") > 5000, F.col("person_id") % 2 == 0)
    return analysis(spark, sf_dir).groupBy("nation").agg(*(c.alias(k) for k, c in cells.items()))


_LF = lambda k: f"lgamma(({k}) + 1)"
_CELL = "(" + " + ".join(map(_LF, ("n11 + n10", "n01 + n00", "n11 + n01", "n10 + n00"))) + "".join(f" - {_LF(k)}" for k in ("n11 + n10 + n01 + n00", "{0}", "n11 + n10 - {0}", "n11 + n01 - {0}", "n00 - n11 + {0}")) + ")"


@query(f"""WITH a AS ({ANALYSIS}), t AS (SELECT nation, count(*) FILTER (x AND y) AS n11, count(*) FILTER (x AND NOT y) AS n10, count(*) FILTER (NOT x AND y) AS n01, count(*) FILTER (NOT x AND NOT y) AS n00
  FROM (SELECT nation, bal > 5000 AS x, person_id % 2 = 0 AS y FROM a) GROUP BY 1),
e AS (SELECT *, unnest(range(greatest(0, n11 - n00), least(n11 + n10, n11 + n01) + 1)) AS k FROM t),
q AS (SELECT nation, sum(exp({_CELL.format('k')})) FILTER ({_CELL.format('k')} <= {_CELL.format('n11')} + 1e-7) AS p FROM e GROUP BY 1)
SELECT t.*, round(n11 * n00 / nullif(n10 * n01, 0), 6) AS odds_ratio, round(least(1, p), 6) AS p FROM t JOIN q USING (nation)""")
def fisher_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_p(odds_ratios(spark, sf_dir), stats.fisher_exact, ["n11", "n10", "n01", "n00"])


@query(f"""WITH a AS ({ANALYSIS}), f AS (SELECT bal, (person_id % 3 = 0)::INT AS g, n_orders AS x FROM a WHERE n_orders IS NOT NULL),
s AS (SELECT regr_slope(bal, g) AS crude, covar_pop(bal, g) AS yg, covar_pop(bal, x) AS yx, var_pop(g) AS gg, var_pop(x) AS xx, covar_pop(g, x) AS gx FROM f)
SELECT round(crude, 6) AS crude, round((yg * xx - yx * gx) / (gg * xx - gx * gx), 6) AS adjusted, round((1 - abs((yg * xx - yx * gx) / (gg * xx - gx * gx)) / abs(crude)) * 100, 4) AS explained_pct FROM s""".replace("100, 4)", "100, 6)"))
def ancova(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analysis(spark, sf_dir).where("n_orders is not null")
    group = (F.col("person_id") % 3 == 0).cast("int")
    crude = stats.least_squares(d, "bal", {"g": group})["g"][0]
    adjusted = stats.least_squares(d, "bal", {"g": group, "x": F.col("n_orders")})["g"][0]
    # The one row of results hangs on an aggregate of the table.
    return d.agg(F.lit(crude).alias("crude"), F.lit(adjusted).alias("adjusted"), F.lit((1 - abs(adjusted) / abs(crude)) * 100).alias("explained_pct"), F.count("*").alias("n")).drop("n")


@query(f"""WITH a AS ({ANALYSIS}), f AS (SELECT bal, {L} AS c FROM a)
, s AS (SELECT sqrt(sum(v) / (sum(n) - 3)) AS s, max(n) FILTER (c = 0) AS n0, max(n) FILTER (c = 1) AS n1, max(n) FILTER (c = 2) AS n2 FROM (SELECT c, count(*) AS n, var_pop(bal) * count(*) AS v FROM f GROUP BY 1))
SELECT round(avg(bal) FILTER (c = 1), 6) AS intercept, round(avg(bal) FILTER (c = 0) - avg(bal) FILTER (c = 1), 6) AS level0, round(avg(bal) FILTER (c = 2) - avg(bal) FILTER (c = 1), 6) AS level2,
round(any_value(s) * sqrt(1 / any_value(n0) + 1 / any_value(n1)), 6) AS level0_se, round(any_value(s) * sqrt(1 / any_value(n2) + 1 / any_value(n1)), 6) AS level2_se FROM f, s""")
def treatment_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analysis(spark, sf_dir).withColumn("c", label3("person_id"))
    b = stats.least_squares(d, "bal", {"level0": (F.col("c") == 0).cast("int"), "level2": (F.col("c") == 2).cast("int")})
    return d.agg(*(F.lit(b[k][0]).alias(k) for k in ("intercept", "level0", "level2")), *(F.lit(b[k][1]).alias(f"{k}_se") for k in ("level0", "level2")), F.count("*").alias("n")).drop("n")


@query()
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models with standard errors, p and intervals."""
    d = analysis(spark, sf_dir).where("n_orders is not null").withColumn("c", label3("person_id"))
    level = lambda k: (F.col("c") == k).cast("int")
    crude = stats.coefficients(d, "bal", {"level0": level(0), "level2": level(2)}).withColumn("model", F.lit("crude"))
    return crude.unionByName(stats.coefficients(d, "bal", {"level0": level(0), "level2": level(2), "n_orders": F.col("n_orders")}).withColumn("model", F.lit("adjusted")))


SWEEP = f"""WITH r AS (SELECT user_id AS pid, count(*) FILTER (45 + value < 70) AS v FROM events GROUP BY 1), e AS (SELECT v, count(*) AS c, count(*) FILTER ({LABEL3} = 2) AS h FROM r GROUP BY 1),
d AS (SELECT v AS cutoff, sum(c) OVER w AS n, sum(h) OVER w AS hits, (SELECT sum(h) FROM e) AS pos FROM e WINDOW w AS (ORDER BY v DESC))"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readings(spark, sf_dir).groupBy("pid").agg(F.count_if(F.col("g") < 70).alias("v"))
    return stats.threshold_sweep(d, "v", label3() == 2)


@query(f"{SWEEP} SELECT cutoff, n::BIGINT AS n_selected, hits::BIGINT AS hits, round(hits / (n + pos - hits), 6) AS jaccard, round(hits / n, 6) AS precision, round(hits / pos, 6) AS recall FROM d")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


#: The limits of the decision table, and whether a value below trips.
RULES = (("T1", 0.7, True), ("T2", 0.7, True), ("T3", 0.3, False), ("T4", 0.6, True))


@query(f"""{SWEEP}, j AS (SELECT max(hits / (n + pos - hits)) AS v FROM d),
m AS (SELECT user_id AS pid, event_id % 5 AS run, avg((45 + value < 70)::INT) >= 0.25 AS flag FROM events GROUP BY 1, 2), c AS (SELECT pid, avg(flag::INT) AS f FROM m GROUP BY 1),
o AS (SELECT sum(abs(l_quantity)) AS q, sum(l_extendedprice) AS p, any_value(l_partkey) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
x AS (SELECT avg(((q % 10 >= 4 AND (q * 7) % 10 >= 4) OR (k % 2 = 0 AND p >= 20000 AND q <= 30))::INT) AS v FROM o),
h AS (SELECT bool_or(ts < timestamp '2024-01-16') AS a, bool_or(ts >= timestamp '2024-01-16') AS b FROM events WHERE value < 10 GROUP BY user_id),
v AS (SELECT 'T1' AS rule, avg((f >= 0.8)::INT) AS value, 0.7 AS limit_value, true AS below FROM c WHERE f > 0 UNION ALL SELECT 'T2', v, 0.7, true FROM j UNION ALL SELECT 'T3', v, 0.3, false FROM x UNION ALL SELECT 'T4', avg((a AND b)::INT), 0.6, true FROM h)
SELECT rule, round(value, 6) AS value, round(limit_value::DOUBLE, 6) AS limit_value, CASE WHEN below THEN value < limit_value ELSE value > limit_value END AS tripped FROM v""")
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1: share of the core (member in 80 % of runs) among all that are a member in any; T2: best overlap of a threshold
    rule; T3: share of artifacts; T4: share present in both halves. Each is written by its operator and judged by rules."""
    r = readings(spark, sf_dir)
    runs = r.groupBy("pid", F.pmod("rid", F.lit(5)).alias("run")).agg((F.avg((F.col("g") < 70).cast("double")) >= 0.25).alias("flag"))
    core = cluster.recurrence(runs, "pid", "flag").where("frequency > 0").agg(F.avg(F.col("core").cast("double")).alias("value"))
    best = _sweep(spark, sf_dir).agg(F.max("jaccard").alias("value"))
    faults = cohort_queries.artifact_flags(spark, sf_dir).agg(F.avg(F.col("artifact").cast("double")).alias("value"))
    halves = cohort_queries.half_presence(spark, sf_dir).where("discovery + validation > 0").agg(F.avg(F.col("both_halves").cast("double")).alias("value"))
    each = [d.select(F.lit(rule).alias("rule"), F.col("value").cast("double").alias("value")) for rule, d in (("T1", core), ("T2", best), ("T3", faults), ("T4", halves))]
    return stats.decisions(written(functools.reduce(DataFrame.unionByName, each), "values"), RULES)


_SITE = f"""{R}, {GRID}, {BASE}, h AS (SELECT pid, {HOUR} AS hour, baseline, g - baseline AS excursion FROM base), o AS (SELECT pid, avg(baseline) AS mb, avg(excursion) AS me FROM h GROUP BY 1),
p AS (SELECT h.pid, h.hour::INT AS hour, avg(baseline) - any_value(mb) AS b, avg(excursion) - any_value(me) AS e, {LABEL3.replace('pid', 'h.pid')} AS c FROM h JOIN o USING (pid) GROUP BY 1, 2)"""


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.rolling_baseline(series.regular_grid(readings(spark, sf_dir), 360))
    return series.hourly_offsets(d, local_hour(F.col("ts"), offset()), ("baseline", "excursion")).withColumn("c", label3())


@query(f"{_SITE} SELECT hour, round(avg(b) FILTER (c = 0) - avg(b) FILTER (c = 1), 6) AS baseline_gap, round(avg(e) FILTER (c = 0) - avg(e) FILTER (c = 1), 6) AS excursion_gap, round(stddev_pop(e) FILTER (c = 0) / sqrt(count(e) FILTER (c = 0)) * 1.96, 6) AS band FROM p GROUP BY 1")
def hourly_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda v, k: F.when(F.col("c") == k, F.col(v))
    gap = lambda v: F.avg(side(v, 0)) - F.avg(side(v, 1))
    band = F.stddev_pop(side("excursion", 0)) / F.sqrt(F.count(side("excursion", 0))) * 1.96
    return _offsets(spark, sf_dir).groupBy("hour").agg(gap("baseline").alias("baseline_gap"), gap("excursion").alias("excursion_gap"), band.alias("band"))


@query(f"""{_SITE}, w AS (SELECT pid, c, avg(b) AS b, avg(e) AS e FROM p WHERE hour BETWEEN 16 AND 23 GROUP BY 1, 2), s AS (SELECT avg(b) FILTER (c = 0) - avg(b) FILTER (c = 1) AS bg, avg(e) FILTER (c = 0) - avg(e) FILTER (c = 1) AS eg FROM w)
SELECT round(bg, 6) AS baseline_gap, round(eg, 6) AS excursion_gap, round(eg / (bg + eg), 6) AS excursion_fraction, abs(eg) > abs(bg) AS excursion_dominant FROM s""")
def gap_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _offsets(spark, sf_dir).where("hour between 16 and 23").groupBy("pid", "c").agg(F.avg("baseline").alias("b"), F.avg("excursion").alias("e"))
    gap = lambda v: F.avg(F.when(F.col("c") == 0, F.col(v))) - F.avg(F.when(F.col("c") == 1, F.col(v)))
    s = w.agg(gap("b").alias("baseline_gap"), gap("e").alias("excursion_gap"))
    return s.select("*", (F.col("excursion_gap") / (F.col("baseline_gap") + F.col("excursion_gap"))).alias("excursion_fraction"), (F.abs("excursion_gap") > F.abs("baseline_gap")).alias("excursion_dominant"))


@query(f"""WITH a AS ({ANALYSIS}), c AS (SELECT 'max_price' AS metric, count(*) AS n, count(DISTINCT max_price) AS d, corr(rx, ry) AS rho FROM (SELECT max_price, rank() OVER (ORDER BY bal) + (count(*) OVER (PARTITION BY bal) - 1) / 2 AS rx, rank() OVER (ORDER BY max_price) + (count(*) OVER (PARTITION BY max_price) - 1) / 2 AS ry FROM a WHERE max_price IS NOT NULL)
UNION ALL SELECT 'n_orders', count(*), count(DISTINCT n_orders), corr(rx, ry) FROM (SELECT n_orders, rank() OVER (ORDER BY bal) + (count(*) OVER (PARTITION BY bal) - 1) / 2 AS rx, rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2 AS ry FROM a WHERE n_orders IS NOT NULL))
SELECT metric, round(rho, 6) AS rho FROM c WHERE n >= 30 AND d >= 3 ORDER BY abs(rho) DESC, metric LIMIT 1""")
def best_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir).select("bal", F.col("max_price"), F.col("n_orders").cast("double").alias("n_orders"))
    d = stats.unpivot(a, ("bal",), ("max_price", "n_orders"))
    rho = stats.spearman(d, "bal", "value", ["variable"])
    known = d.groupBy("variable").agg(F.countDistinct("value").alias("d")).where("d >= 3")
    return rho.where("n >= 30").join(known, "variable").orderBy(F.desc(F.abs("rho")), "variable").limit(1).select(F.col("variable").alias("metric"), "rho")
