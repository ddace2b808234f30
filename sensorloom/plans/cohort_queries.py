"""Queries of the cohort operators: casts, joins, aggregates, top-n and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions import columns as fx
from sensorloom.operators import cohort, stats
from sensorloom.plans.registering import register
from sensorloom.plans.views import ANALYSIS, HOUR, LABEL3, READINGS, analysis, label3, offset, readings
from sensorloom.session import table, written

QUERIES, SQL = {}, {}
query = register(QUERIES, SQL)

A = f"WITH a AS ({ANALYSIS})"
R = f"WITH r AS ({READINGS})"
SEGMENTS = {"BUILDING": "bld", "MACHINERY": "mac", "AUTOMOBILE": "car"}


@query("""SELECT event_id, CASE lower(trim(v)) WHEN 'low' THEN 39.0 WHEN 'high' THEN 401.0 ELSE TRY_CAST(v AS DOUBLE) END AS g, TRY_CAST(w AS DOUBLE) AS k
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' Low ' WHEN event_id % 13 = 0 THEN 'HIGH' WHEN event_id % 17 = 0 THEN event_type ELSE value::VARCHAR END AS v,
  CASE WHEN event_id % 5 = 0 THEN event_type ELSE (event_id % 97)::VARCHAR END AS w FROM events)""")
def reading_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    v = F.when(i % 11 == 0, " Low ").when(i % 13 == 0, "HIGH").when(i % 17 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    w = F.when(i % 5 == 0, F.col("event_type")).otherwise((i % 97).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", fx.reading_value(v).alias("g"), fx.numeric(w).alias("k"))


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN event_type ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS TIMESTAMP)::DATE AS day,
  extract(hour FROM TRY_CAST(CASE WHEN event_id % 7 = 0 THEN event_type ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP))::INT AS hour FROM events""")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    at = fx.instant(text)
    return table(spark, sf_dir, "events").select("event_id", F.to_date(at).alias("day"), F.hour(at).alias("hour"))


@query(f"""{A} SELECT person_id, CASE segment WHEN 'BUILDING' THEN 'bld' WHEN 'MACHINERY' THEN 'mac' WHEN 'AUTOMOBILE' THEN 'car' END AS short,
  CASE WHEN lower(segment) LIKE 'build%' THEN 'first' WHEN contains(lower(segment), 'house') THEN 'second' ELSE 'other' END AS rule,
  CASE WHEN x >= 0.14 THEN 'large' WHEN x >= 0.06 THEN 'medium' WHEN x >= 0.01 THEN 'small' ELSE 'negligible' END AS band,
  CASE WHEN x < 0.001 THEN '***' WHEN x < 0.01 THEN '**' WHEN x < 0.05 THEN '*' ELSE '' END AS mark,
  CASE WHEN h < 5.7 THEN 'normal' WHEN h < 6.5 THEN 'prediabetes' WHEN h >= 6.5 THEN 'diabetes' END AS hba1c,
  round(bal * 28.70, 6) AS insulin, round(bal * 4.783, 6) AS homa, round(1 / (log10(abs(bal) + 2) + log10(person_id + 50)), 6) AS quicki, round(ln((abs(bal) + 1) * (person_id + 50) / 2), 6) AS tyg
FROM (SELECT *, (person_id % 200) / 1000.0 AS x, 4.0 + (person_id % 40) / 10.0 AS h FROM a)""")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, bal, low = F.col("person_id"), F.col("bal"), F.lower("segment")
    x, h = (i % 200) / 1000.0, 4.0 + (i % 40) / 10.0
    return analysis(spark, sf_dir).select(
        "person_id",
        cohort.lookup("segment", SEGMENTS).alias("short"),
        F.when(low.startswith("build"), "first").when(low.contains("house"), "second").otherwise("other").alias("rule"),
        fx.effect_band(x).alias("band"), fx.stars(x).alias("mark"), fx.hba1c_band(h).alias("hba1c"),
        (bal * fx.INSULIN_UNITS).alias("insulin"), (bal * fx.HOMA_UNITS).alias("homa"),
        fx.quicki(F.abs(bal) + 2, i + 50).alias("quicki"), fx.tyg(F.abs(bal) + 1, i + 50).alias("tyg"),
    )


@query(f"{A} SELECT nation, count(*) AS n, count(*) FILTER (n_orders IS NOT NULL AND mean_price IS NOT NULL) AS n_complete FROM a GROUP BY 1")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    kept = a.dropna(subset=["n_orders", "mean_price"]).groupBy("nation").agg(F.count("*").alias("k"))
    return a.groupBy("nation").agg(F.count("*").alias("n")).join(kept, "nation", "left").select("nation", "n", F.coalesce("k", F.lit(0)).cast("bigint").alias("n_complete"))


@query("""WITH l AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer),
r AS (SELECT o_custkey AS k, CASE WHEN max(o_orderkey) % 3 = 0 THEN NULL ELSE max(o_orderkey)::DOUBLE END AS v FROM orders GROUP BY 1)
SELECT l.k, l.s, round(r.v, 6) AS v FROM l LEFT JOIN r USING (k)""")
def right_column_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))
    last = F.max("o_orderkey")
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.when(last % 3 != 0, last.cast("double")).alias("v"))
    return cohort.right_wins(left, right, "k").select("k", "s", "v")


@query(f"{A} SELECT person_id, round(coalesce(mean_price, (SELECT median(mean_price) FROM a)), 4) AS mean_price, round(coalesce(n_orders, (SELECT median(n_orders) FROM a)), 6) AS n_orders FROM a", digits=4)
def median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analysis(spark, sf_dir).select("person_id", "mean_price", F.col("n_orders").cast("double").alias("n_orders"))
    return cohort.fill_medians(d, ["mean_price", "n_orders"])


_Z = "(({0} - avg({0}) OVER ()) / stddev_pop({0}) OVER ())"


@query(f"{A}, f AS (SELECT person_id, bal, coalesce(mean_price, (SELECT median(mean_price) FROM a)) AS mean_price FROM a) SELECT person_id, round({_Z.format('bal')}, 6) AS z_bal, round(({_Z.format('bal')} + {_Z.format('mean_price')}) / 2, 6) AS severity FROM f")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cohort.fill_medians(analysis(spark, sf_dir).select("person_id", "bal", "mean_price"), ["mean_price"])
    z = cohort.standard_scores(d, ["bal"]).select("person_id", F.col("bal").alias("z_bal"))
    return cohort.severity(d, ["bal", "mean_price"]).select("person_id", "severity").join(z, "person_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(abs(l_quantity)) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT *, q % 10 >= 4 AS d, (q * 7) % 10 >= 4 AS u, l_partkey % 2 = 0 AS n FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, d AND u AS square_wave, n AND p >= 20000 AND q <= 30 AS compression, (d AND u) OR (n AND p >= 20000 AND q <= 30) AS artifact FROM f""")
def artifact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum(F.abs("l_quantity")).alias("q"), F.sum("l_extendedprice").alias("p"))
    d = d.select("l_orderkey", "l_linenumber", "l_partkey", (q % 10 * 10).alias("step_down"), (q * 7 % 10 * 10).alias("step_up"), (F.col("l_partkey") % 2 == 0).alias("nocturnal"), F.col("p").alias("dur_min"), q.alias("within_range"))
    return cohort.artifact_flags(d, step=40, minutes=20000, flat=30).select("l_orderkey", "l_linenumber", "l_partkey", "square_wave", "compression", "artifact")


@query("""SELECT c.c_custkey AS person_id, n.n_name AS nation, r.r_name AS site, c.c_mktsegment AS segment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def site_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    d = c.join(o.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    d = d.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select(F.col("c_custkey").alias("person_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("site"), F.col("c_mktsegment").alias("segment"))


@query("""SELECT c.c_custkey AS person_id, count(o.o_orderkey) AS n_orders FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def labels_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "right").groupBy(F.col("c_custkey").alias("person_id")).agg(F.count("o_orderkey").alias("n_orders"))


@query("""SELECT c_custkey AS person_id, p.o_orderpriority AS last_priority FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) p ON p.o_custkey = c_custkey""")
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = cohort.last_wins(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    c = table(spark, sf_dir, "customer")
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("person_id"), F.col("o_orderpriority").alias("last_priority"))


@query(f"""{R}, w AS (SELECT pid, {HOUR} BETWEEN 8 AND 19 AS d, {HOUR} < 6 AS n, g FROM r)
SELECT coalesce(x.pid, y.pid) AS pid, round(x.m, 6) AS day_mean, round(y.m, 6) AS night_mean FROM (SELECT pid, avg(g) AS m FROM w WHERE d GROUP BY 1 HAVING count(*) > 10) x FULL JOIN (SELECT pid, avg(g) AS m FROM w WHERE n GROUP BY 1 HAVING count(*) > 10) y ON x.pid = y.pid""")
def side_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readings(spark, sf_dir).withColumn("h", fx.local_hour(F.col("ts"), offset()))
    side = lambda a, b, name: d.where(fx.in_hours(F.col("h"), a, b)).groupBy("pid").agg(F.avg("g").alias(name), F.count("*").alias("n")).where("n > 10").drop("n")
    return side(8, 20, "day_mean").join(side(0, 6, "night_mean"), "pid", "full_outer")


@query("""WITH d AS (SELECT user_id AS pid, ts::DATE AS day, event_type AS t FROM events),
a AS (SELECT pid, day, count(*) AS n_views FROM d WHERE t = 'view' GROUP BY 1, 2), b AS (SELECT pid, day, count(*) AS n_clicks FROM d WHERE t = 'click' GROUP BY 1, 2)
SELECT coalesce(a.pid, b.pid) AS pid, coalesce(a.day, b.day) AS day, coalesce(n_views, 0) AS n_views, coalesce(n_clicks, 0) AS n_clicks FROM a FULL JOIN b ON a.pid = b.pid AND a.day = b.day""")
def day_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), F.to_date("ts").alias("day"), "event_type")
    part = lambda t, name: e.where(F.col("event_type") == t).groupBy("pid", "day").agg(F.count("*").alias(name))
    return cohort.overlay_days(part("view", "n_views"), part("click", "n_clicks"), ["pid", "day"])


@query(f"""{R}, l AS (SELECT pid, rid, ts FROM r WHERE g < 50), x AS (SELECT pid, ts FROM r WHERE g > 180),
k AS (SELECT l.pid, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.pid = l.pid AND x.ts BETWEEN l.ts - INTERVAL 3 DAY AND l.ts - INTERVAL 12 HOUR) GROUP BY 1)
SELECT u.pid, coalesce(k.n, 0) AS n_free FROM (SELECT DISTINCT pid FROM r) u LEFT JOIN k USING (pid)""")
def non_prandial_lows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = 3_600_000_000
    free = cohort.not_preceded(r.where("g < 50"), r.where("g > 180"), "pid", "s", "s", 72 * hour, 12 * hour)
    return cohort.count_with_zero(r, free, "pid", "n_free")


@query("""SELECT o_orderkey, q.l_quantity AS first_quantity FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1) q ON o_orderkey = q.l_orderkey""")
def eav_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = cohort.attribute(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 1, "first_quantity", ("l_partkey", "l_suppkey", "l_extendedprice"))
    orders = cohort.assert_unique(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey")
    return orders.join(one, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "first_quantity")


@query(f"""{A} SELECT nation, count(*) AS n, count(n_orders) AS n_with, round(median(bal), 6) AS med_bal, round(avg(bal), 6) AS mean_bal, count(DISTINCT segment) AS n_segments, round(median(mean_price), 6) AS med_price,
  round(quantile_cont(bal, 0.025), 6) AS p025, round(quantile_cont(bal, 0.25), 6) AS p25, round(quantile_cont(bal, 0.75), 6) AS p75, round(quantile_cont(bal, 0.975), 6) AS p975 FROM a GROUP BY 1""")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = written(analysis(spark, sf_dir), "analysis")
    shares = [0.5, 0.025, 0.25, 0.75, 0.975]
    q = stats.group_quantiles(d, "nation", ["bal", "mean_price"], shares)
    at = lambda c, k, name: F.max(F.when((F.col("variable") == c) & (F.col("k") == k), F.col("value"))).alias(name)
    middle = q.groupBy("nation").agg(at("bal", 0, "med_bal"), at("mean_price", 0, "med_price"), *(at("bal", k, name) for k, name in enumerate(("p025", "p25", "p75", "p975"), 1)))
    counts = d.groupBy("nation").agg(F.count("*").alias("n"), F.count("n_orders").alias("n_with"), F.avg("bal").alias("mean_bal"), F.countDistinct("segment").alias("n_segments"))
    return counts.join(middle, "nation", "left")


_SEG = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"{A} SELECT nation, {', '.join(f'''count(*) FILTER (segment = '{s}') AS n_{s}''' for s in _SEG)}, {', '.join(f'''round(count(*) FILTER (segment = '{s}') / nullif(count(*) FILTER (segment IN {_SEG}), 0), 6) AS share_{s}''' for s in _SEG)} FROM a GROUP BY 1")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.crosstab(analysis(spark, sf_dir), "nation", "segment", _SEG)


_HIST = f"{R}, h AS (SELECT {LABEL3} AS label, {HOUR}::INT AS hour, count(*) AS n, count(*) FILTER (g < 70) AS n_low FROM r GROUP BY 1, 2)"


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = fx.local_hour(F.col("ts"), offset()).cast("int")
    return readings(spark, sf_dir).groupBy(label3().alias("label"), hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("g") < 70).alias("n_low"))


@query(f"{_HIST} SELECT label, hour, n, n_low, round(1000 * n_low / greatest(n, 1), 6) AS per_1000 FROM h")
def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir).withColumn("per_1000", 1000 * F.col("n_low") / F.greatest("n", F.lit(1)))


@query(f"""{_HIST} SELECT label, sum(n)::BIGINT AS n_readings, sum(n_low)::BIGINT AS n_lows, round(100 * sum(n_low) / sum(n), 6) AS pct_low, round(100 * sum(n_low) FILTER (hour < 6) / sum(n_low), 6) AS night_share,
  round(100 * sum(n_low) FILTER (hour < 6) / sum(n) FILTER (hour < 6), 6) AS night_pct, round(100 * sum(n_low) FILTER (hour >= 6) / sum(n) FILTER (hour >= 6), 6) AS day_pct,
  arg_max(hour, (n_low / n, -hour)) AS peak_hour, arg_min(hour, (n_low / n, hour)) AS trough_hour FROM h GROUP BY 1""")
def low_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, low, n = F.col("hour"), F.col("n_low"), F.col("n")
    night = lambda c: F.sum(F.when(h < 6, c))
    day = lambda c: F.sum(F.when(h >= 6, c))
    return _histogram(spark, sf_dir).groupBy("label").agg(
        F.sum(n).alias("n_readings"), F.sum(low).alias("n_lows"), (100 * F.sum(low) / F.sum(n)).alias("pct_low"), (100 * night(low) / F.sum(low)).alias("night_share"),
        (100 * night(low) / night(n)).alias("night_pct"), (100 * day(low) / day(n)).alias("day_pct"),
        F.max_by(h, F.struct(low / n, -h)).alias("peak_hour"), F.min_by(h, F.struct(low / n, h)).alias("trough_hour"),
    )


_COVER = """WITH c AS (SELECT user_id AS pid, ts::DATE AS day, count(*) AS n, count(DISTINCT extract(hour FROM ts)) AS hours_worn, count(*) FILTER (value > 20) AS n_usable, count(*) FILTER (value - 20 = 0) AS n_zero, count(*) FILTER (value - 20 = 100) AS n_hundred FROM events GROUP BY 1, 2)"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "pid")
    return cohort.daily_coverage(e, "pid", "ts", F.col("value") - 20)


@query(f"{_COVER} SELECT * FROM c")
def daily_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


@query(f"""{_COVER}, d AS (SELECT pid, count(*) FILTER (n >= 3) AS sensor_days, count(*) FILTER (hours_worn >= 2) AS wear_days, count(*) FILTER (n_usable >= 1) AS usable_days FROM c GROUP BY 1),
e AS (SELECT *, concat_ws(';', CASE WHEN sensor_days < 9 THEN 'sensor_days<9' END, CASE WHEN wear_days < 18 THEN 'wear_days<18' END, CASE WHEN usable_days < 24 THEN 'usable_days<24' END) AS reason FROM d)
SELECT *, reason = '' AS included FROM e""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"sensor": (F.col("n") >= 3, 9), "wear": (F.col("hours_worn") >= 2, 18), "usable": (F.col("n_usable") >= 1, 24)}
    return cohort.eligibility(_coverage(spark, sf_dir), "pid", rules)


@query(SQL["eligibility"].replace("SELECT *, reason = '' AS included FROM e", "SELECT x AS reason, count(*) AS n FROM (SELECT unnest(string_split(reason, ';')) AS x FROM e WHERE reason <> '') GROUP BY 1"))
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = eligibility(spark, sf_dir).where("reason <> ''")
    return d.select(F.explode(F.split("reason", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT user_id AS pid, ts::DATE AS day, event_type AS t, value AS v, CASE WHEN event_id % 10 = 0 THEN -5.0 ELSE event_id % 60 END AS m FROM events),
a AS (SELECT pid, day, sum(CASE WHEN t IN ('view', 'click') THEN v ELSE 0 END) AS steps, sum(CASE WHEN t = 'click' THEN greatest(0, m) ELSE 0 END) AS active_min, sum(CASE WHEN t = 'view' THEN greatest(0, m) ELSE 0 END) AS sedentary_min FROM d GROUP BY 1, 2)
SELECT pid, day, round(steps, 6) AS steps, round(active_min, 6) AS active_min, round(sedentary_min, 6) AS sedentary_min, steps > 200 AS extreme, steps < 100 AND active_min > 60 AS anomaly FROM a""")
def activity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.when(F.col("event_id") % 10 == 0, -5).otherwise(F.col("event_id") % 60)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), "ts", (F.col("ts") + F.make_dt_interval(mins=minutes.cast("int"))).alias("till"), "event_type", "value")
    d = cohort.activity_totals(e, "pid", "ts", "till", "event_type", "value", ["click"], ["view"], ["view", "click"])
    return d.withColumns({"extreme": F.col("steps") > 200, "anomaly": (F.col("steps") < 100) & (F.col("active_min") > 60)})


@query(f"{A} SELECT nation, round(corr(bal, max_price), 6) AS r, round(corr(bal, max_price) ** 2, 6) AS r2, round(median(abs(max_price - mean_price)), 6) AS med_gap FROM a GROUP BY 1")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.corr("bal", "max_price")
    return analysis(spark, sf_dir).groupBy("nation").agg(r.alias("r"), F.pow(r, 2).alias("r2"), F.median(F.abs(F.col("max_price") - F.col("mean_price"))).alias("med_gap"))


_NUM = ["bal", "n_orders", "mean_price", "max_price"]
_PAIRS = [(a, b) for k, a in enumerate(_NUM) for b in _NUM[k + 1 :]]
_FULL = f"{A}, f AS (SELECT bal, coalesce(n_orders, (SELECT median(n_orders) FROM a)) AS n_orders, coalesce(mean_price, (SELECT median(mean_price) FROM a)) AS mean_price, coalesce(max_price, (SELECT median(max_price) FROM a)) AS max_price FROM a)"


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analysis(spark, sf_dir).select("person_id", *(F.col(c).cast("double").alias(c) for c in _NUM))
    return cohort.fill_medians(d, _NUM)


@query(f"{_FULL} SELECT a, b, round(r, 6) AS r FROM ({' UNION ALL '.join(f'''SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM f''' for a, b in _PAIRS)}) ORDER BY abs(r) DESC, a, b LIMIT 5")
def correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.correlated_pairs(_filled(spark, sf_dir), _NUM)


@query(f"{_FULL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a} / 1000, {b} / 1000), 6) AS cov FROM f" for k, a in enumerate(_NUM) for b in _NUM[k:]))
def covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _filled(spark, sf_dir).select(*((F.col(c) / 1000).alias(c) for c in _NUM))
    return cohort.covariances(d, _NUM)


@query(f"{A} SELECT CASE WHEN segment = 'BUILDING' THEN 'Oral' WHEN segment = 'MACHINERY' THEN 'Insulin' ELSE 'Unmed' END AS cohort, count(*) AS n, {', '.join(f'count(*) FILTER (c = {k}) AS n_{k}, round(100 * count(*) FILTER (c = {k}) / count(*), 1) AS pct_{k}' for k in range(3))} FROM (SELECT *, {LABEL3.replace('pid', 'person_id')} AS c FROM a) GROUP BY 1")
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("segment") == "BUILDING", "oral agents").when(F.col("segment") == "MACHINERY", "some insulin").otherwise("healthy")
    d = analysis(spark, sf_dir).select(fx.treatment(group).alias("cohort"), label3("person_id").alias("c"))
    parts = [x for k in range(3) for x in (F.count_if(F.col("c") == k).alias(f"n_{k}"), F.round(100 * F.count_if(F.col("c") == k) / F.count("*") + 3e-10, 1).alias(f"pct_{k}"))]
    return d.groupBy("cohort").agg(F.count("*").alias("n"), *parts)


@query(f"""{A}, z AS (SELECT person_id, {_Z.format('bal')} AS s, person_id % 50 = 0 AS few FROM a),
n AS (SELECT greatest(count(*) FILTER (few), round_even(0.03 * count(*), 0)::BIGINT) AS n FROM z), k AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, person_id) AS rk FROM z)
SELECT person_id, CASE WHEN few THEN 'few' WHEN rk <= n THEN 'extreme' ELSE 'mild' END AS level FROM k, n""")
def severity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cohort.standard_scores(analysis(spark, sf_dir).select("person_id", "bal"), ["bal"]).withColumn("bal", F.round(F.col("bal") + 3e-10, 9))
    return cohort.extreme_levels(d, "person_id", "bal", F.col("person_id") % 50 == 0).select("person_id", "level")


@query(f"""{A}, c AS (SELECT segment, {LABEL3.replace('pid', 'person_id')} AS c, count(*) AS n FROM a GROUP BY 1, 2), w AS (SELECT *, n / sum(n) OVER (PARTITION BY segment) AS share, sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS baseline FROM c)
SELECT segment, c, n, round(share, 6) AS share, round(baseline, 6) AS baseline, round(share - baseline, 6) AS difference FROM w""")
def stage_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.composition(analysis(spark, sf_dir).withColumn("c", label3("person_id")), "segment", "c")


@query(f"""{A}, z AS (SELECT person_id, {LABEL3.replace('pid', 'person_id')} AS c, {_Z.format('bal')} AS s, person_id % 50 = 0 AS few FROM a),
n AS (SELECT greatest(count(*) FILTER (few), round_even(0.03 * count(*), 0)::BIGINT) AS n FROM z), k AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, person_id) AS rk FROM z),
x AS (SELECT person_id, c, CASE WHEN few THEN 'few' WHEN rk <= n THEN 'extreme' ELSE 'mild' END AS level FROM k, n),
l AS (SELECT 'pair' AS labels, c AS label FROM x WHERE c < 2 UNION ALL SELECT 'three', c FROM x UNION ALL SELECT 'extremes', (level = 'extreme')::INT FROM x WHERE level <> 'few' UNION ALL
SELECT 'four', CASE WHEN level = 'few' THEN 3 WHEN level = 'extreme' THEN 2 WHEN c = 1 THEN 1 ELSE 0 END FROM x UNION ALL SELECT 'rare', (level = 'few')::INT FROM x)
SELECT labels, label, count(*) AS n FROM l GROUP BY 1, 2""")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the classes of every task."""
    level = severity_levels(spark, sf_dir).withColumn("c", label3("person_id"))
    return cohort.label_sets(level, "person_id", "c", "level").groupBy("labels", "label").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT l_suppkey AS pid, count(*) AS n, avg((l_returnflag <> 'R')::INT) AS pass_frac, count(DISTINCT l_shipdate::DATE) AS n_days FROM lineitem GROUP BY 1)
SELECT pid, n, round(pass_frac, 6) AS pass_frac, n_days FROM d WHERE n >= 5 AND pass_frac >= 0.6 AND n_days >= 2 ORDER BY n DESC, pid LIMIT 10""")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pid")).agg(F.count("*").alias("n"), F.avg((F.col("l_returnflag") != "R").cast("int")).alias("pass_frac"), F.countDistinct(F.to_date("l_shipdate")).alias("n_days"))
    return d.where("n >= 5 and pass_frac >= 0.6 and n_days >= 2").orderBy(F.desc("n"), "pid").limit(10)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_any,
  round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS jaccard""")
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return cohort.jaccard(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "k")


@query("""WITH a AS (SELECT DISTINCT user_id AS k, ts::DATE AS day FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id AS k, ts::DATE AS day FROM events WHERE event_type = 'error')
SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'any', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'first', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def date_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("day"), "event_type")
    a, b = (e.where(F.col("event_type") == t).select("k", "day") for t in ("view", "error"))
    part = lambda name, d: d.select(F.lit(name).alias("part"), "*")
    return part("both", a.intersect(b)).unionByName(part("any", a.union(b).distinct())).unionByName(part("first", a.subtract(b)))


@query("""WITH h AS (SELECT user_id AS pid, CASE WHEN ts < timestamp '2024-01-16' THEN 'discovery' ELSE 'validation' END AS half, value FROM events)
SELECT pid, count(*) FILTER (half = 'discovery' AND value < 10) AS discovery, count(*) FILTER (half = 'validation' AND value < 10) AS validation, count(*) FILTER (half = 'discovery' AND value < 10) > 0 AND count(*) FILTER (half = 'validation' AND value < 10) > 0 AS both_halves FROM h GROUP BY 1""")
def half_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "discovery").otherwise("validation")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), half.alias("half"), "value")
    d = e.where("value < 10").groupBy("pid").pivot("half", ["discovery", "validation"]).count()
    out = e.select("pid").distinct().join(d, "pid", "left").fillna(0, ["discovery", "validation"])
    return out.withColumn("both_halves", (F.col("discovery") > 0) & (F.col("validation") > 0))


@query("""SELECT nation, n FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) ORDER BY n DESC, nation""")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nation")


@query("""SELECT rep, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd1, round(stddev_pop(v), 6) AS sd0, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (SELECT l_linenumber AS rep, l_discount + l_tax AS v FROM lineitem) GROUP BY 1""")
def replicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_discount") + F.col("l_tax")
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("rep"), v.alias("v"))
    return d.groupBy("rep").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd1"), F.stddev_pop("v").alias("sd0"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("""SELECT k, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT json_extract_string(props, '$.k')::INT AS k, value FROM events) GROUP BY 1""")
def json_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query(f"{R}, c AS (SELECT pid, count(*) AS n FROM r GROUP BY 1) SELECT 'few' AS tag, pid, n FROM c WHERE {LABEL3} = 2 UNION ALL SELECT 'rest', pid, n FROM c WHERE {LABEL3} <> 2")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = readings(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n"))
    tag = lambda name, d: d.select(F.lit(name).alias("tag"), "pid", "n")
    return tag("few", c.where(label3() == 2)).unionByName(tag("rest", c.where(label3() != 2)))


@query("""SELECT v AS value, count(*) AS n, sum(count(*)) OVER (ORDER BY v)::BIGINT AS upto FROM (SELECT l_quantity AS v FROM lineitem) GROUP BY 1""")
def sorted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.count("*").alias("n"))
    return stats.running_sums(d, [], "value", ["n"]).withColumnRenamed("n_upto", "upto")
