"""Per-participant features of readings in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import in_hours
from sensorloom.operators import series
from sensorloom.operators.series import G, PID


def percent(condition: Column) -> Column:
    return 100 * F.avg(condition.cast("double"))


def side_difference(day: Column, night: Column, least: int = 1, on_missing: str = "null") -> Column:
    """Mean by day less mean by night, where each side has at least so many readings; else null or 0."""
    g = F.col(G)
    enough = (F.count_if(day & g.isNotNull()) >= least) & (F.count_if(night & g.isNotNull()) >= least)
    gap = F.avg(F.when(day, g)) - F.avg(F.when(night, g))
    value = F.when(enough, gap)
    return F.coalesce(value, F.lit(0.0)) if on_missing == "zero" else value


def core_features(df: DataFrame, least: int = 50, count_initial: bool = False) -> DataFrame:
    """Level, spread, burden, rates, spikes and reactive events of participants with enough readings."""
    d = df.where(F.col(G).isNotNull())
    w = series.by_time()
    d = d.withColumns({"_d": (F.col(G) - F.lag(G).over(w)) / 5, "_up": series.crossing(140.0, count_initial)})
    g = F.col(G)
    level = d.groupBy(PID).agg(
        F.count("*").alias("n_readings"),
        F.avg(g).alias("mean_glucose"),
        F.stddev_pop(g).alias("glucose_sd"),
        (100 * F.stddev_pop(g) / F.avg(g)).alias("glucose_cv"),
        percent(g > 140).alias("pct_above_140"),
        percent(g > 180).alias("pct_above_180"),
        percent(g < 70).alias("pct_below_70"),
        percent(g < 54).alias("pct_below_54"),
        F.count_if(g < 70).alias("n_lows_70"),
        F.count_if(g < 54).alias("n_lows_54"),
        F.coalesce(F.avg(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0.0)).alias("avg_rise_rate"),
        F.coalesce(F.avg(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0.0)).alias("avg_fall_rate"),
        F.count_if("_up").alias("n_spikes_140"),
    )
    events = series.reactive_events(df).groupBy(PID).agg(F.count("*").alias("n"))
    out = level.where(F.col("n_readings") >= least).join(events, PID, "left")
    return out.withColumn("n_reactive_events", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")


def nocturnal_features(df: DataFrame, hour: Column, first: int = 23, last: int = 6, least: int = 5) -> DataFrame:
    """Mean, minimum and share below 70 inside the night window, share over 250 overall."""
    g, night = F.col(G), in_hours(hour, first, last)
    d = df.where(g.isNotNull())
    out = d.groupBy(PID).agg(F.count_if(night).alias("n_night"), F.avg(F.when(night, g)).alias("noct_mean"), F.min(F.when(night, g)).alias("noct_nadir"), (100 * F.avg(F.when(night, (g < 70).cast("double")))).alias("noct_tbr70"), percent(g > 250).alias("tar_250"))
    return out.where(F.col("n_night") >= least)


def hour_profile(df: DataFrame, hour: Column) -> DataFrame:
    """From hourly means: lowest of hours 0-5, mean of hours 6-8, their difference, and the amplitude."""
    hourly = df.where(F.col(G).isNotNull()).groupBy(PID, hour.alias("h")).agg(F.avg(G).alias("m"), F.sum(G).alias("s"), F.count("*").alias("n"))
    h = F.col("h")
    part = lambda c, a, b: F.sum(F.when((h >= a) & (h < b), F.col(c)))
    out = hourly.groupBy(PID).agg(
        (F.sum("s") / F.sum("n")).alias("mean24"),
        (part("s", 0, 6) / part("n", 0, 6)).alias("noct_mean"),
        (part("s", 8, 22) / part("n", 8, 22)).alias("day_mean"),
        F.min(F.when(h < 6, F.col("m"))).alias("nadir_block"),
        F.avg(F.when((h >= 6) & (h < 9), F.col("m"))).alias("morning"),
        (F.max("m") - F.min("m")).alias("amp"),
    )
    return out.withColumn("dawn_delta", F.col("morning") - F.col("nadir_block"))
