"""Queries of the series and feature operators over the readings view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.columns import in_hours, local_hour, local_time
from sensorloom.operators import features, series
from sensorloom.plans.registering import register
from sensorloom.plans.views import HOUR, LABEL3, OFFSET, READINGS, label3, offset, readings
from sensorloom.session import table

QUERIES, SQL = {}, {}
query = register(QUERIES, SQL)

R = f"WITH r AS ({READINGS})"
ORD = "PARTITION BY pid ORDER BY ts, rid"
_UP = "g > 140 AND lag(g) OVER w <= 140"
EVENTS = f"""i AS (SELECT *, row_number() OVER ({ORD}) - 1 AS idx, lag(g) OVER ({ORD}) AS prev, lead(g) OVER ({ORD}) AS next FROM r),
x AS (SELECT *, min(CASE WHEN g < 70 THEN idx END) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND 35 FOLLOWING) AS low_idx,
      max(CASE WHEN prev IS NULL OR prev <> g THEN idx END) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS begin_idx FROM i),
e AS (SELECT pid, low_idx, arg_min(g, idx) AS peak, low_idx - arg_min(begin_idx, idx) AS steps FROM x
      WHERE g > 140 AND (next IS NULL OR next < g) AND low_idx IS NOT NULL GROUP BY pid, low_idx),
ev AS (SELECT e.pid, e.low_idx, e.peak, i.g AS nadir, e.steps FROM e JOIN i ON e.pid = i.pid AND e.low_idx = i.idx)"""


@query(f"""{R}, {EVENTS},
d AS (SELECT *, (g - lag(g) OVER w) / 5 AS ch, coalesce({_UP}, false) AS up FROM r WINDOW w AS ({ORD}))
SELECT d.pid, count(*) AS n_readings, round(avg(g), 6) AS mean_glucose, round(stddev_pop(g), 6) AS glucose_sd, round(100 * stddev_pop(g) / avg(g), 6) AS glucose_cv,
  round(100 * avg((g > 140)::INT), 6) AS pct_above_140, round(100 * avg((g > 180)::INT), 6) AS pct_above_180, round(100 * avg((g < 70)::INT), 6) AS pct_below_70, round(100 * avg((g < 54)::INT), 6) AS pct_below_54,
  count(*) FILTER (g < 70) AS n_lows_70, count(*) FILTER (g < 54) AS n_lows_54,
  round(coalesce(avg(ch) FILTER (ch > 0), 0), 6) AS avg_rise_rate, round(coalesce(avg(-ch) FILTER (ch < 0), 0), 6) AS avg_fall_rate,
  count(*) FILTER (up) AS n_spikes_140, coalesce(any_value(k.n), 0) AS n_reactive_events
FROM d LEFT JOIN (SELECT pid, count(*) AS n FROM ev GROUP BY 1) k ON d.pid = k.pid GROUP BY d.pid HAVING count(*) >= 50""")
def features_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.core_features(readings(spark, sf_dir))


@query(f"""{R}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pid, ts ORDER BY rid) = 1),
d AS (SELECT *, g - lag(g) OVER w AS up, lead(g) OVER w - g AS af, ts - lag(ts) OVER w AS g1, lead(ts) OVER w - ts AS g2 FROM f WINDOW w AS ({ORD}))
SELECT pid, rid, CASE WHEN g1 <= INTERVAL 12 HOUR AND g2 <= INTERVAL 12 HOUR THEN CASE WHEN up > 25 AND af < -15 THEN 'peak' WHEN up < -25 AND af > 15 THEN 'valley' END END AS reversal FROM d""")
def sign_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sign_reversals(series.first_records(readings(spark, sf_dir)), gap_minutes=720).select("pid", "rid", "reversal")


@query(f"""{R}, d AS (SELECT pid, rid, g::FLOAT - lag(g::FLOAT) OVER ({ORD}) AS delta FROM r)
SELECT pid, rid, round(delta::DOUBLE, 3) AS delta, {LABEL3} = 2 AS is_hp FROM d WHERE abs(delta) > 25""", digits=3)
def rate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = series.rate_flags(readings(spark, sf_dir))
    return flags.select("pid", "rid", F.col("delta").cast("double").alias("delta"), (label3() == 2).alias("is_hp"))


@query(f"""{R}, d AS (SELECT pid, g::FLOAT - lag(g::FLOAT) OVER ({ORD}) AS delta FROM r)
SELECT pid, count(*) AS n_flags FROM d WHERE abs(delta) > 25 GROUP BY 1 ORDER BY n_flags DESC, pid LIMIT 10""")
def top_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = series.rate_flags(readings(spark, sf_dir))
    return flags.groupBy("pid").agg(F.count("*").alias("n_flags")).orderBy(F.desc("n_flags"), "pid").limit(10)


@query(f"""{R}, d AS (SELECT pid, (g - lag(g) OVER ({ORD})) / 5 AS ch FROM r)
SELECT pid, round(coalesce(avg(ch) FILTER (ch > 0), 0), 6) AS avg_rise_rate, round(coalesce(avg(-ch) FILTER (ch < 0), 0), 6) AS avg_fall_rate FROM d GROUP BY 1""")
def change_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.change_rates(readings(spark, sf_dir))


@query(f"""{R}, d AS (SELECT pid, g, lag(g) OVER ({ORD}) AS p FROM r)
SELECT pid, count(*) FILTER (g > 140 AND p <= 140) AS spikes_a, count(*) FILTER (g > 140 AND (p <= 140 OR p IS NULL)) AS spikes_b FROM d GROUP BY 1""")
def spike_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readings(spark, sf_dir).withColumns({"a": series.crossing(), "b": series.crossing(count_initial=True)})
    return d.groupBy("pid").agg(F.count_if("a").alias("spikes_a"), F.count_if("b").alias("spikes_b"))


@query(f"{R}, {EVENTS} SELECT pid, low_idx, round(peak, 6) AS peak, round(nadir, 6) AS nadir, steps FROM ev")
def reactive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.reactive_events(readings(spark, sf_dir)).select("pid", F.col("low_idx").cast("bigint").alias("low_idx"), "peak", "nadir", F.col("steps").cast("bigint").alias("steps"))


@query(f"""{R}, {EVENTS}, a AS (SELECT pid, count(*) AS n, avg(peak) AS p, avg(nadir) AS q, avg(peak - nadir) AS d, avg(steps * 5) AS m FROM ev GROUP BY 1)
SELECT u.pid, coalesce(n, 0) AS n_reactive, coalesce(n, 0) > 0 AS has_reactive, round(p, 6) AS mean_peak, round(q, 6) AS mean_nadir, round(d, 6) AS mean_drop, round(m, 6) AS mean_minutes
FROM (SELECT DISTINCT pid FROM r) u LEFT JOIN a USING (pid)""")
def reactive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return series.reactive_summary(r, series.reactive_events(r))


@query("""WITH d AS (SELECT user_id AS pid, ts::DATE AS day, ts, event_id AS rid, event_type = 'view' AS v FROM events),
c AS (SELECT *, CASE WHEN lag(v) OVER w IS DISTINCT FROM v THEN 1 ELSE 0 END AS n FROM d WINDOW w AS (PARTITION BY pid, day ORDER BY ts, rid)),
k AS (SELECT *, sum(n) OVER (PARTITION BY pid, day ORDER BY ts, rid ROWS UNBOUNDED PRECEDING) AS run FROM c),
e AS (SELECT pid, day, run, sum(v::INT) AS n FROM k GROUP BY 1, 2, 3)
SELECT pid, day, max(n)::BIGINT AS longest FROM e GROUP BY 1, 2""")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), "ts", F.col("event_id").alias("rid"), F.to_date("ts").alias("day"), "event_type")
    return series.longest_run(e, F.col("event_type"), "view", ("pid", "day"))


@query(f"""{R}, d AS (SELECT pid, ts, rid, ({HOUR} >= 23 OR {HOUR} < 6) AND g < 100 AS v FROM r),
c AS (SELECT *, CASE WHEN lag(v) OVER ({ORD}) IS DISTINCT FROM v THEN 1 ELSE 0 END AS n FROM d),
k AS (SELECT *, sum(n) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS run FROM c),
e AS (SELECT pid, run, count(*) AS n FROM k WHERE v GROUP BY 1, 2)
SELECT u.pid, count(e.n) FILTER (e.n >= 3) AS n_episodes FROM (SELECT DISTINCT pid FROM r) u LEFT JOIN e USING (pid) GROUP BY 1""")
def low_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    night = in_hours(local_hour(F.col("ts"), offset()), 23, 6)
    return series.episodes(readings(spark, sf_dir), night & (F.col("g") < 100))


@query(f"""{R}, d AS (SELECT *, stddev_pop(g) OVER (PARTITION BY pid) AS sd, CASE WHEN g - lag(g) OVER w >= 0 THEN 1 WHEN g - lag(g) OVER w < 0 THEN -1 END AS a,
  CASE WHEN lead(g) OVER w - g >= 0 THEN 1 WHEN lead(g) OVER w - g < 0 THEN -1 END AS b FROM r WINDOW w AS ({ORD})),
t AS (SELECT pid, sd, abs(g - lag(g) OVER ({ORD})) AS amp FROM d WHERE a IS NULL OR b IS NULL OR a <> b)
SELECT pid, round(avg(amp) FILTER (amp > sd), 6) AS mage FROM t GROUP BY 1""")
def mage_turning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.mage_turning_points(readings(spark, sf_dir))


@query(f"""{R}, d AS (SELECT *, stddev_pop(g) OVER (PARTITION BY pid) AS sd,
  coalesce(g > max(g) OVER ({ORD} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AND g > max(g) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), false) AS p,
  coalesce(g < min(g) OVER ({ORD} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AND g < min(g) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), false) AS q FROM r),
t AS (SELECT pid, sd, p, q, abs(g - lag(g) OVER ({ORD})) AS amp FROM d WHERE p OR q),
m AS (SELECT pid, CASE WHEN bool_or(p) AND bool_or(q) THEN avg(amp) FILTER (amp > sd) END AS m FROM t GROUP BY 1)
SELECT u.pid, round(coalesce(m.m, 0), 6) AS mage FROM (SELECT DISTINCT pid FROM r) u LEFT JOIN m USING (pid)""")
def mage_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.mage_extrema(readings(spark, sf_dir))


SMOOTH = f"""s0 AS (SELECT *, lag(g) OVER ({ORD}) AS p, lead(g) OVER ({ORD}) AS n FROM r),
s1 AS (SELECT *, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN greatest(least(p, g), least(greatest(p, g), n)) END AS m FROM s0),
s AS (SELECT *, coalesce(m, lead(m) OVER ({ORD}), lag(m) OVER ({ORD})) AS gs FROM s1)"""


@query(f"""{R}, {SMOOTH}, d AS (SELECT *, stddev_pop(gs) OVER (PARTITION BY pid) AS sd, CASE WHEN gs - lag(gs) OVER w >= 0 THEN 1 WHEN gs - lag(gs) OVER w < 0 THEN -1 END AS a,
  CASE WHEN lead(gs) OVER w - gs >= 0 THEN 1 WHEN lead(gs) OVER w - gs < 0 THEN -1 END AS b FROM s WINDOW w AS ({ORD})),
t AS (SELECT pid, sd, gs - lag(gs) OVER ({ORD}) AS amp FROM d WHERE a <> b),
m AS (SELECT pid, avg(amp) FILTER (amp > sd) AS up, avg(-amp) FILTER (-amp > sd) AS down FROM t GROUP BY 1)
SELECT u.pid, round(up, 6) AS mage_plus, round(down, 6) AS mage_minus, round(CASE WHEN up > 0 THEN down / up END, 6) AS mage_ratio FROM (SELECT DISTINCT pid FROM r) u LEFT JOIN m USING (pid)""")
def mage_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.mage_directional(readings(spark, sf_dir))


GRID = """b AS (SELECT pid, time_bucket(INTERVAL 6 HOUR, ts, timestamp '1970-01-01') AS t, avg(g) AS g FROM r GROUP BY 1, 2),
sp AS (SELECT pid, unnest(generate_series(min(t), max(t), INTERVAL 6 HOUR)) AS t FROM b GROUP BY pid),
grid AS (SELECT sp.pid, sp.t AS ts, b.g FROM sp LEFT JOIN b ON sp.pid = b.pid AND sp.t = b.t)"""
BASE = """base AS (SELECT *, CASE WHEN count(g) OVER w >= 18 THEN quantile_cont(g, 0.5) OVER w END AS baseline FROM grid
  WINDOW w AS (PARTITION BY pid ORDER BY ts ROWS BETWEEN 18 PRECEDING AND 17 FOLLOWING))"""


@query(f"{R}, {GRID} SELECT pid, ts, round(g, 6) AS g FROM grid")
def regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.regular_grid(readings(spark, sf_dir), 360)


@query(f"{R}, {GRID}, {BASE} SELECT pid, ts, round(baseline, 6) AS baseline, round(g - baseline, 6) AS excursion FROM base")
def rolling_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rolling_baseline(series.regular_grid(readings(spark, sf_dir), 360)).select("pid", "ts", "baseline", "excursion")


@query(f"""{R}, {GRID}, {BASE}, h AS (SELECT *, {HOUR} AS hour, g - baseline AS excursion FROM base),
o AS (SELECT pid, avg(baseline) AS mb, avg(excursion) AS me FROM h GROUP BY 1)
SELECT h.pid, h.hour::INT AS hour, round(avg(baseline) - any_value(mb), 6) AS baseline, round(avg(excursion) - any_value(me), 6) AS excursion FROM h JOIN o USING (pid) GROUP BY 1, 2""")
def hourly_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.rolling_baseline(series.regular_grid(readings(spark, sf_dir), 360))
    return series.hourly_offsets(d, local_hour(F.col("ts"), offset()), ("baseline", "excursion"))


@query(f"""{R}, i AS (SELECT *, row_number() OVER ({ORD}) - 1 AS idx FROM r),
c AS (SELECT *, CASE WHEN lag(g) OVER ({ORD}) IS DISTINCT FROM g THEN 1 ELSE 0 END AS n FROM i),
k AS (SELECT *, sum(n) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS run FROM c),
d AS (SELECT pid, run, min(idx) AS a, max(idx) AS b, min(g) AS g FROM k GROUP BY 1, 2),
t AS (SELECT *, g > lag(g) OVER (PARTITION BY pid ORDER BY run) AND g > lead(g) OVER (PARTITION BY pid ORDER BY run) AND g >= 140 AS top FROM d),
p AS (SELECT * FROM t WHERE top),
w AS (SELECT p.pid, p.run, p.a, p.b, p.g, max(q.run) FILTER (q.run < p.run) AS lo, min(q.run) FILTER (q.run > p.run) AS hi FROM p LEFT JOIN d q ON p.pid = q.pid AND q.g > p.g GROUP BY ALL),
f AS (SELECT w.pid, w.run, w.a, w.b, w.g, min(d.g) FILTER (d.run <= w.run) AS l, min(d.g) FILTER (d.run >= w.run) AS rr FROM w JOIN d ON w.pid = d.pid AND d.run > coalesce(w.lo, -1) AND d.run < coalesce(w.hi, 1::BIGINT << 60) GROUP BY ALL)
SELECT pid, ((a + b) // 2)::BIGINT AS idx, round(g, 6) AS g, round(g - greatest(l, rr), 6) AS prominence FROM f WHERE g - greatest(l, rr) >= 30""")
def excursion_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.peaks(readings(spark, sf_dir))


PEAKS = f"""i AS (SELECT *, row_number() OVER ({ORD}) - 1 AS idx FROM r),
c AS (SELECT *, CASE WHEN lag(g) OVER ({ORD}) IS DISTINCT FROM g THEN 1 ELSE 0 END AS n FROM i),
k AS (SELECT *, sum(n) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS run FROM c),
d AS (SELECT pid, run, min(idx) AS a, max(idx) AS b, min(g) AS g FROM k GROUP BY 1, 2),
t AS (SELECT *, g > lag(g) OVER (PARTITION BY pid ORDER BY run) AND g > lead(g) OVER (PARTITION BY pid ORDER BY run) AND g >= 140 AS top FROM d),
w AS (SELECT p.pid, p.run, p.a, p.b, p.g, max(q.run) FILTER (q.run < p.run) AS lo, min(q.run) FILTER (q.run > p.run) AS hi FROM (SELECT * FROM t WHERE top) p LEFT JOIN d q ON p.pid = q.pid AND q.g > p.g GROUP BY ALL),
f AS (SELECT w.pid, w.run, w.a, w.b, w.g, min(d.g) FILTER (d.run <= w.run) AS l, min(d.g) FILTER (d.run >= w.run) AS rr FROM w JOIN d ON w.pid = d.pid AND d.run > coalesce(w.lo, -1) AND d.run < coalesce(w.hi, 1::BIGINT << 60) GROUP BY ALL),
z AS (SELECT pid, ((a + b) // 2)::BIGINT AS idx, g - greatest(l, rr) AS prominence FROM f WHERE g - greatest(l, rr) >= 30)"""


@query(f"""{R}, {PEAKS}, y AS (SELECT pid, count(DISTINCT (ts + to_hours({OFFSET}))::DATE) AS days FROM r GROUP BY 1)
SELECT z.pid, {HOUR.replace('pid', 'z.pid')}::INT AS hour, count(*) AS n, round(count(*) / any_value(days), 6) AS rate, round(avg(prominence), 6) AS size FROM z JOIN i ON z.pid = i.pid AND z.idx = i.idx JOIN y ON z.pid = y.pid GROUP BY 1, 2""")
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.peak_hours(readings(spark, sf_dir), local_hour(F.col("ts"), offset()), F.to_date(local_time(F.col("ts"), offset())))


@query(f"""{R}, d AS (SELECT pid, rid, ts, CASE WHEN event_id % 2 = 0 AND row_number() OVER (PARTITION BY user_id ORDER BY r.ts, rid) > 3 THEN g END AS v FROM r JOIN events ON rid = event_id),
x AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ts, rid ROWS UNBOUNDED PRECEDING) AS b,
      first_value(v IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ts, rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM d)
SELECT pid, rid, round(CASE WHEN b IS NULL THEN f WHEN f IS NULL THEN b ELSE v END, 6) AS v FROM x""".replace("rid, ts, CASE", "rid, r.ts AS ts, CASE"))
def edge_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("rid") % 2 == 0) & (F.row_number().over(series.by_time()) > 3)
    d = readings(spark, sf_dir).withColumn("v", F.when(late, F.col("g")))
    return series.fill_edges(d, "v").select("pid", "rid", "v")


def _sides(least: int, missing: str) -> str:
    d, n = f"{HOUR} >= 8 AND {HOUR} < 20", f"{HOUR} < 6"
    value = f"CASE WHEN count(*) FILTER ({d}) >= {least} AND count(*) FILTER ({n}) >= {least} THEN avg(g) FILTER ({d}) - avg(g) FILTER ({n}) END"
    return f"round({'coalesce(' + value + ', 0)' if missing == 'zero' else value}, 6)"


@query(f"{R} SELECT pid, {_sides(11, 'null')} AS day_night_null, {_sides(11, 'zero')} AS day_night_zero, {_sides(1, 'null')} AS day_night_any FROM r GROUP BY 1")
def day_night_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = local_hour(F.col("ts"), offset())
    d = readings(spark, sf_dir).withColumn("h", h)
    day, night = in_hours(F.col("h"), 8, 20), in_hours(F.col("h"), 0, 6)
    side = features.side_difference
    return d.groupBy("pid").agg(side(day, night, 11).alias("day_night_null"), side(day, night, 11, "zero").alias("day_night_zero"), side(day, night).alias("day_night_any"))


@query(f"""{R}, d AS (SELECT pid, g, {HOUR} >= 23 OR {HOUR} < 6 AS n FROM r)
SELECT pid, count(*) FILTER (n) AS n_night, round(avg(g) FILTER (n), 6) AS noct_mean, round(min(g) FILTER (n), 6) AS noct_nadir, round(100 * avg((g < 70)::INT) FILTER (n), 6) AS noct_tbr70, round(100 * avg((g > 250)::INT), 6) AS tar_250
FROM d GROUP BY 1 HAVING count(*) FILTER (n) >= 5""")
def nocturnal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.nocturnal_features(readings(spark, sf_dir), local_hour(F.col("ts"), offset()))


@query(f"""{R}, h AS (SELECT pid, {HOUR} AS h, avg(g) AS m, sum(g) AS s, count(*) AS n FROM r GROUP BY 1, 2),
a AS (SELECT pid, sum(s) / sum(n) AS mean24, sum(s) FILTER (h < 6) / sum(n) FILTER (h < 6) AS noct_mean, sum(s) FILTER (h >= 8 AND h < 22) / sum(n) FILTER (h >= 8 AND h < 22) AS day_mean,
  min(m) FILTER (h < 6) AS nadir_block, avg(m) FILTER (h >= 6 AND h < 9) AS morning, max(m) - min(m) AS amp FROM h GROUP BY 1)
SELECT pid, round(mean24, 6) AS mean24, round(noct_mean, 6) AS noct_mean, round(day_mean, 6) AS day_mean, round(nadir_block, 6) AS nadir_block, round(morning, 6) AS morning, round(amp, 6) AS amp, round(morning - nadir_block, 6) AS dawn_delta FROM a""")
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hour_profile(readings(spark, sf_dir), local_hour(F.col("ts"), offset()))


@query(f"""{R}, d AS (SELECT pid, ts + to_hours({'CASE WHEN pid % 3 = 0 THEN -6 ELSE -8 END'}) AS t, g FROM r)
SELECT pid, t::DATE AS day, count(*) AS n, round(avg(g), 6) AS mean_g FROM d GROUP BY 1, 2""")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readings(spark, sf_dir).withColumn("day", F.to_date(local_time(F.col("ts"), offset())))
    return d.groupBy("pid", "day").agg(F.count("*").alias("n"), F.avg("g").alias("mean_g"))
