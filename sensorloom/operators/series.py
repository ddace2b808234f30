"""Operators on ordered series of readings (pid, ts, rid, g): windows over each participant's time order.

``rid`` breaks ties of one time, so every result is deterministic. Null readings are left out first, each with its own
hour. The readings of a participant are one window partition, sorted by Spark with spilling; only the walls of peaks are
found by NumPy, on chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PID, TS, TIE, G = "pid", "ts", "rid", "g"


def by_time(frame: tuple[int, int] | None = None):
    w = Window.partitionBy(PID).orderBy(TS, TIE)
    return w.rowsBetween(*frame) if frame else w


def first_records(df: DataFrame, keys: tuple[str, ...] = (PID, TS), tie: str = TIE) -> DataFrame:
    """The first record of each key."""
    w = Window.partitionBy(*keys).orderBy(tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sign_reversals(df: DataFrame, gap_minutes: float = 10.0, rise: float = 25.0, fall: float = 15.0) -> DataFrame:
    """Adds ``reversal``: 'peak' or 'valley' of single readings that jump and jump back within the gap, else null."""
    w = by_time()
    minutes = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 60e6
    up, after = F.col(G) - F.lag(G).over(w), F.lead(G).over(w) - F.col(G)
    near = (minutes(F.lag(TS).over(w), F.col(TS)) <= gap_minutes) & (minutes(F.col(TS), F.lead(TS).over(w)) <= gap_minutes)
    return df.where(F.col(G).isNotNull()).withColumn("reversal", F.when(near & (up > rise) & (after < -fall), "peak").when(near & (up < -rise) & (after > fall), "valley"))


def rate_flags(df: DataFrame, limit: float = 25.0) -> DataFrame:
    """Rows whose change from the reading before is over the limit, with ``delta`` in single precision."""
    df, g = df.where(F.col(G).isNotNull()), F.col(G).cast("float")
    delta = g - F.lag(g).over(by_time())
    return df.withColumn("delta", delta).where(F.abs("delta") > limit)


def change_rates(df: DataFrame, minutes: float = 5.0) -> DataFrame:
    """Per participant: mean rise and fall by minute, 0 where there is none."""
    d = df.where(F.col(G).isNotNull()).withColumn("d", (F.col(G) - F.lag(G).over(by_time())) / minutes)
    return d.groupBy(PID).agg(F.coalesce(F.avg(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("avg_rise_rate"), F.coalesce(F.avg(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0.0)).alias("avg_fall_rate"))


def crossing(limit: float = 140.0, count_initial: bool = False) -> Column:
    """Whether a reading climbs over the limit; a first reading over it counts only with ``count_initial``. An expression:
    null readings have to be left out before."""
    before = F.lag(G).over(by_time())
    inside = before <= limit
    return (F.col(G) > limit) & (inside | before.isNull() if count_initial else F.coalesce(inside, F.lit(False)))


def reactive_events(df: DataFrame, high: float = 140.0, low: float = 70.0, reach: int = 36) -> DataFrame:
    """A row for each fall from a top over ``high`` to the first reading below ``low`` among ``reach`` readings.

    A top is a reading after which the series doesn't go on climbing. Tops that lead to one low are one event, named by
    the earliest. Columns: pid, low_idx, peak, nadir, steps (from the first reading of the peak's plateau).
    """
    w = by_time()
    d = df.where(F.col(G).isNotNull()).withColumn("idx", F.row_number().over(w) - 1)
    below = F.when(F.col(G) < low, F.struct("idx", G))
    changed = F.lag(G).over(w).isNull() | (F.lag(G).over(w) != F.col(G))
    d = d.withColumns({"next": F.lead(G).over(w), "fall": F.min(below).over(by_time((0, reach - 1))), "changed": changed})
    d = d.withColumn("begin", F.max(F.when(F.col("changed"), F.col("idx"))).over(by_time((Window.unboundedPreceding, 0))))
    tops = d.where((F.col(G) > high) & (F.col("next").isNull() | (F.col("next") < F.col(G))) & F.col("fall").isNotNull())
    events = tops.groupBy(PID, F.col("fall.idx").alias("low_idx")).agg(F.min(F.struct("idx", G, "begin")).alias("top"), F.min(f"fall.{G}").alias("nadir"))
    return events.select(PID, "low_idx", F.col(f"top.{G}").alias("peak"), "nadir", (F.col("low_idx") - F.col("top.begin")).alias("steps"))


def reactive_summary(df: DataFrame, events: DataFrame, minutes: float = 5.0) -> DataFrame:
    """Per participant: number of events, whether any, means of peak, nadir, drop and minutes to the nadir."""
    e = events.groupBy(PID).agg(F.count("*").alias("n"), F.avg("peak").alias("mean_peak"), F.avg("nadir").alias("mean_nadir"), F.avg(F.col("peak") - F.col("nadir")).alias("mean_drop"), F.avg(F.col("steps") * minutes).alias("mean_minutes"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return df.select(PID).distinct().join(e, PID, "left").select(PID, n.alias("n_reactive"), (n > 0).alias("has_reactive"), "mean_peak", "mean_nadir", "mean_drop", "mean_minutes")


def runs(df: DataFrame, value: Column, keys: tuple[str, ...] = (PID,), order: tuple[str, ...] = (TS, TIE)) -> DataFrame:
    """Adds ``run``: number of the run of equal values (null equals null) inside the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_v", value)
    d = d.withColumn("_new", (~F.col("_v").eqNullSafe(F.lag("_v").over(w))) | (F.row_number().over(w) == 1))
    return d.withColumn("run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_v", "_new")


def longest_run(df: DataFrame, value: Column, wanted: object, keys: tuple[str, ...], order: tuple[str, ...] = (TS, TIE)) -> DataFrame:
    """Per key: the longest run of the wanted value, 0 where it never occurs."""
    d = runs(df.withColumn("_is", value == wanted), value, keys, order)
    each = d.groupBy(*keys, "run").agg(F.sum(F.col("_is").cast("int")).alias("n"))
    return each.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("longest"))


def episodes(df: DataFrame, inside: Column, least: int = 3) -> DataFrame:
    """Per participant: runs of at least so many readings for which the condition holds."""
    d = runs(df.withColumn("_in", F.coalesce(inside, F.lit(False))), F.coalesce(inside, F.lit(False)))
    each = d.where("_in").groupBy(PID, "run").agg(F.count("*").alias("n"))
    counted = each.groupBy(PID).agg(F.sum((F.col("n") >= least).cast("int")).alias("n"))
    return df.select(PID).distinct().join(counted, PID, "left").select(PID, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_episodes"))


def _with_spread(df: DataFrame) -> DataFrame:
    return df.where(F.col(G).isNotNull()).withColumn("_sd", F.stddev_pop(G).over(Window.partitionBy(PID)))


def mage_turning_points(df: DataFrame) -> DataFrame:
    """Mean amplitude between turning points (ends included) over one standard deviation; null if none."""
    w = by_time()
    d = _with_spread(df)
    going = lambda x: F.when(x >= 0, 1).when(x < 0, -1)
    d = d.withColumns({"a": going(F.col(G) - F.lag(G).over(w)), "b": going(F.lead(G).over(w) - F.col(G))})
    turns = d.where("a is null or b is null or a <> b").withColumn("amp", F.abs(F.col(G) - F.lag(G).over(w)))
    return turns.groupBy(PID).agg(F.avg(F.when(F.col("amp") > F.col("_sd"), F.col("amp"))).alias("mage"))


def mage_extrema(df: DataFrame, order: int = 6) -> DataFrame:
    """Mean amplitude over one standard deviation between strict extrema of ``order`` readings to each side, else 0.

    0 as well where a participant lacks a peak or a trough.
    """
    w = by_time()
    d = _with_spread(df)
    sides = ((-order, -1), (1, order))
    top = [F.col(G) > F.max(G).over(by_time(s)) for s in sides]
    bottom = [F.col(G) < F.min(G).over(by_time(s)) for s in sides]
    d = d.withColumns({"peak": F.coalesce(top[0] & top[1], F.lit(False)), "trough": F.coalesce(bottom[0] & bottom[1], F.lit(False))})
    ext = d.where("peak or trough").withColumn("amp", F.abs(F.col(G) - F.lag(G).over(w)))
    each = ext.groupBy(PID).agg(F.avg(F.when(F.col("amp") > F.col("_sd"), F.col("amp"))).alias("m"), F.max("peak").alias("p"), F.max("trough").alias("t"))
    value = F.when(F.col("p") & F.col("t"), F.col("m"))
    return d.select(PID).distinct().join(each, PID, "left").select(PID, F.coalesce(value, F.lit(0.0)).alias("mage"))


def smoothed(df: DataFrame) -> DataFrame:
    """``gs``: median of three readings; the ends take their neighbour's."""
    w = by_time()
    before, after = F.lag(G).over(w), F.lead(G).over(w)
    three = F.greatest(F.least(before, F.col(G)), F.least(F.greatest(before, F.col(G)), after))
    d = df.where(F.col(G).isNotNull()).withColumn("_m", F.when(before.isNotNull() & after.isNotNull(), three))
    return d.withColumn("gs", F.coalesce("_m", F.lead("_m").over(w), F.lag("_m").over(w))).drop("_m")


def mage_directional(df: DataFrame) -> DataFrame:
    """Rising and falling mean amplitudes over one standard deviation on the smoothed series, and their ratio.

    Ends are no turning points; fewer than two turns give nulls.
    """
    w = by_time()
    d = smoothed(df).withColumn("_sd", F.stddev_pop("gs").over(Window.partitionBy(PID)))
    going = lambda x: F.when(x >= 0, 1).when(x < 0, -1)
    d = d.withColumns({"a": going(F.col("gs") - F.lag("gs").over(w)), "b": going(F.lead("gs").over(w) - F.col("gs"))})
    turns = d.where("a <> b").withColumn("amp", F.col("gs") - F.lag("gs").over(w))
    each = turns.groupBy(PID).agg(F.avg(F.when(F.col("amp") > F.col("_sd"), F.col("amp"))).alias("mage_plus"), F.avg(F.when(-F.col("amp") > F.col("_sd"), -F.col("amp"))).alias("mage_minus"))
    ratio = F.when(F.col("mage_plus") > 0, F.col("mage_minus") / F.col("mage_plus"))
    return d.select(PID).distinct().join(each, PID, "left").select(PID, "mage_plus", "mage_minus", ratio.alias("mage_ratio"))


def regular_grid(df: DataFrame, minutes: int = 5, keep_empty: bool = True) -> DataFrame:
    """(pid, ts, g): means by bin on a regular grid from the first bin to the last; empty bins null or left out."""
    own = df.groupBy(PID, F.window(TS, f"{minutes} minutes").start.alias(TS)).agg(F.avg(G).alias(G))
    if not keep_empty:
        return own.where(F.col(G).isNotNull())
    ends = own.groupBy(PID).agg(F.min(TS).alias("a"), F.max(TS).alias("b"))
    spine = ends.select(PID, F.explode(F.sequence("a", "b", F.expr(f"interval {minutes} minutes"))).alias(TS))
    return spine.join(own, [PID, TS], "left")


def rolling_baseline(grid: DataFrame, width: int = 36, least: int = 18) -> DataFrame:
    """Adds ``baseline`` (centred rolling median, null below ``least`` values) and ``excursion`` (reading less baseline)."""
    frame = Window.partitionBy(PID).orderBy(TS).rowsBetween(-(width // 2), (width - 1) // 2)
    median = F.percentile(G, F.lit(0.5)).over(frame)
    d = grid.withColumn("baseline", F.when(F.count(G).over(frame) >= least, median))
    return d.withColumn("excursion", F.col(G) - F.col("baseline"))


def hourly_offsets(df: DataFrame, hour: Column, columns: tuple[str, ...]) -> DataFrame:
    """(pid, hour, ...): hourly mean of each column less the participant's own mean."""
    total = Window.partitionBy(PID)
    d = df.withColumn("hour", hour).withColumns({f"_{c}": F.avg(c).over(total) for c in columns})
    return d.groupBy(PID, "hour").agg(*((F.avg(c) - F.first(f"_{c}")).alias(c) for c in columns))


#: Points of a chunk that a task takes at once, and points whose tables it holds together.
CHUNK, HELD = 4_096, 200_000


def _left_walls(g: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For the points ``at``: the least value from each back to the next higher point before it, and that point's place.

    By doubling: maxima and minima of 1, 2, 4 ... points that end at each point; then all points step back at once, by the
    longest stretch without a higher point. ``g`` begins with a point higher than all.
    """
    tops, lows = [g], [g]
    while 1 << len(tops) <= longest:
        step = 1 << len(tops) - 1
        tops.append(np.r_[tops[-1][:step], np.maximum(tops[-1][step:], tops[-1][:-step])])
        lows.append(np.r_[lows[-1][:step], np.minimum(lows[-1][step:], lows[-1][:-step])])
    own, low, place = g[at], g[at], at - 1
    for top, least, step in zip(tops[::-1], lows[::-1], (1 << k for k in range(len(tops) - 1, -1, -1)), strict=True):
        for _ in range(2):
            free = top[place] <= own
            low = np.where(free, np.minimum(low, least[place]), low)
            place = np.where(free, place - step, place)
    return low, place


def _walled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tops of chunks: the least value to each side inside the chunk, up to a higher point or the chunk's end, and whether the
    next chunk of that side has to say more."""
    for batch in batches:
        points = batch["points"]
        sizes = np.diff(points.offsets.to_numpy())
        ends = np.cumsum(sizes)
        for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // HELD)) + 1):
            if not len(rows):
                continue
            part, n = points.slice(int(rows[0]), len(rows)), sizes[rows]
            flat = part.flatten()
            # A point higher than all between chunks, at the begin and at the end.
            place = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n) + 1
            g = np.full(len(flat) + len(n) + 1, np.inf)
            g[place] = flat.field(G).to_numpy(zero_copy_only=False)
            top = np.flatnonzero(flat.field("top").to_numpy(zero_copy_only=False))
            at, longest = place[top], int(n.max())
            left, before = _left_walls(g, at, longest)
            right, after = _left_walls(g[::-1], len(g) - 1 - at, longest)
            own = np.repeat(rows, n)[top]
            chunk, chunks = (batch[c].to_numpy()[own] for c in ("chunk", "chunks"))
            open_left, open_right = np.isinf(g[before]) & (chunk > 0), np.isinf(g[::-1][after]) & (chunk + 1 < chunks)
            take = pa.array(top)
            yield pa.RecordBatch.from_arrays(
                [batch[PID].take(pa.array(own)), pa.array(chunk), flat.field("a").take(take), flat.field("b").take(take), flat.field(G).take(take), pa.array(left), pa.array(right), pa.array(open_left), pa.array(open_right)],
                [PID, "chunk", "a", "b", G, "left", "right", "open_left", "open_right"],
            )


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least value between a chunk's edge and its point next to it that is higher than a top of another chunk."""
    for batch in batches:
        low = []
        for side, top, values, so_far in zip(batch["side"].to_pylist(), batch[G].to_pylist(), batch["values"], batch["low"].to_pylist(), strict=True):
            v = values.values.to_numpy(zero_copy_only=False)
            higher = np.flatnonzero(v > top)
            rest = v[higher[-1] + 1 :] if side == "left" else v[: higher[0]]
            low.append(min(so_far, float(rest.min(initial=so_far))))
        yield pa.RecordBatch.from_arrays([batch[PID], batch["a"], batch["side"], pa.array(low, pa.float64())], [PID, "a", "side", "low"])


def _plateaus(df: DataFrame, height: float) -> DataFrame:
    """(pid, run, a, b, g, top, points): plateaus as one point from reading a to b, whether a local maximum of that height."""
    w = by_time()
    d = df.where(F.col(G).isNotNull()).withColumn("idx", F.row_number().over(w) - 1)
    d = runs(d, F.col(G)).groupBy(PID, "run").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.min(G).alias(G))
    by_run = Window.partitionBy(PID).orderBy("run")
    top = (F.col(G) > F.lag(G).over(by_run)) & (F.col(G) > F.lead(G).over(by_run)) & (F.col(G) >= height)
    return d.withColumns({"top": F.coalesce(top, F.lit(False)), "points": F.count("*").over(Window.partitionBy(PID))})


def peaks(df: DataFrame, height: float = 140.0, prominence: float = 30.0, chunk: int = CHUNK) -> DataFrame:
    """Peaks (pid, idx, g, prominence) of at least that height and prominence. A plateau is one peak, at its middle.

    The prominence is the height over the higher of the two lowest points between the peak and the next higher reading of
    each side. Plateaus are joined to one point first. Points go in chunks of ``chunk`` that follow each other, each to some
    task, which finds the walls of all its tops at once. A top whose wall is in another chunk passes by the chunks whose
    maximum isn't higher, taking their minimum, and asks the first one that is; so a long series is the work of many tasks.
    Without readings there are no peaks; a series of one chunk asks nothing.
    """
    points = _plateaus(df, height)
    number = F.floor((F.col("run") - 1) / chunk).cast("int")
    packed = points.withColumns({"chunk": number, "chunks": F.ceil(F.col("points") / chunk).cast("int"), G: F.col(G).cast("double")})
    packed = packed.groupBy(PID, "chunk", "chunks").agg(F.array_sort(F.collect_list(F.struct("run", G, "a", "b", "top"))).alias("points"))
    kind = df.schema[PID].dataType.simpleString()
    found = packed.mapInArrow(_walled, f"{PID} {kind}, chunk int, a {points.schema['a'].dataType.simpleString()}, b {points.schema['b'].dataType.simpleString()}, {G} double, `left` double, `right` double, open_left boolean, open_right boolean")
    # What is too low by the wall of one side can't rise by another chunk.
    found = found.where((F.col("open_left") | (F.col(G) - F.col("left") >= prominence)) & (F.col("open_right") | (F.col(G) - F.col("right") >= prominence)))
    many = packed.where("chunks > 1").select(PID, "chunk", F.transform("points", lambda p: p[G]).alias("values"))
    summaries = many.groupBy(PID).agg(F.array_sort(F.collect_list(F.struct("chunk", F.array_max("values").alias("hi"), F.array_min("values").alias("lo")))).alias("all"))
    sides = [found.where(f"open_{s}").select(PID, "chunk", "a", G, F.lit(s).alias("side"), F.col(s).alias("low")) for s in ("left", "right")]
    asked = sides[0].unionByName(sides[1]).join(summaries, PID)
    left = F.col("side") == "left"
    beyond = F.filter("all", lambda x: F.when(left, x["chunk"] < F.col("chunk")).otherwise(x["chunk"] > F.col("chunk")))
    asked = asked.withColumn("beyond", beyond)
    higher = F.transform(F.filter("beyond", lambda x: x["hi"] > F.col(G)), lambda x: x["chunk"])
    asked = asked.withColumn("wall", F.when(left, F.array_max(higher)).otherwise(F.array_min(higher)))
    passed = F.filter("beyond", lambda x: F.col("wall").isNull() | F.when(left, x["chunk"] > F.col("wall")).otherwise(x["chunk"] < F.col("wall")))
    asked = asked.select(PID, "a", G, "side", "wall", F.least("low", F.array_min(F.transform(passed, lambda x: x["lo"]))).alias("low"))
    met = asked.where("wall is not null").join(many.withColumnRenamed("chunk", "wall"), [PID, "wall"]).select(PID, "a", G, "side", "low", "values")
    answers = met.mapInArrow(_inside, f"{PID} {kind}, a {points.schema['a'].dataType.simpleString()}, side string, low double").unionByName(asked.where("wall is null").select(PID, "a", "side", "low"))
    lows = answers.groupBy(PID, "a").agg(*(F.min(F.when(F.col("side") == s, F.col("low"))).alias(f"far_{s}") for s in ("left", "right")))
    closed = ~(F.col("open_left") | F.col("open_right"))
    whole = found.where(closed).select(PID, "a", "b", G, "left", "right").unionByName(
        found.where(~closed).join(lows, [PID, "a"]).select(PID, "a", "b", G, F.coalesce("far_left", "left").alias("left"), F.coalesce("far_right", "right").alias("right"))
    )
    size = F.col(G) - F.greatest("left", "right")
    return whole.where(size >= prominence).select(PID, F.floor((F.col("a") + F.col("b")) / 2).cast("bigint").alias("idx"), F.col(G).cast(df.schema[G].dataType).alias(G), size.alias("prominence"))


def peak_hours(df: DataFrame, hour: Column, local_day: Column, height: float = 140.0, prominence: float = 30.0) -> DataFrame:
    """(pid, hour, n, rate, size): peaks by hour of day, by day with readings, and their mean prominence."""
    d = df.where(F.col(G).isNotNull()).withColumns({"idx": (F.row_number().over(by_time()) - 1).cast("bigint"), "hour": hour, "_day": local_day})
    days = d.groupBy(PID).agg(F.greatest(F.countDistinct("_day"), F.lit(1)).alias("days"))
    met = peaks(df, height, prominence).select(PID, "idx", "prominence").join(d.select(PID, "idx", "hour"), [PID, "idx"])
    each = met.groupBy(PID, "hour").agg(F.count("*").alias("n"), F.avg("prominence").alias("size"))
    return each.join(days, PID).select(PID, "hour", "n", (F.col("n") / F.col("days")).alias("rate"), "size")


def fill_edges(df: DataFrame, column: str) -> DataFrame:
    """Nulls before the first value and behind the last take that value; inner gaps stay as they are."""
    back = F.last(column, ignorenulls=True).over(by_time((Window.unboundedPreceding, 0)))
    ahead = F.first(column, ignorenulls=True).over(by_time((0, Window.unboundedFollowing)))
    value = F.when(back.isNull(), ahead).when(ahead.isNull(), back).otherwise(F.col(column))
    return df.withColumn(column, value)
