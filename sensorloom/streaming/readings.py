"""The same readings as a stream: grids by watermark, duplicates, sessions of low values, step flags with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first record of each participant and time, among those not later than the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pid", "ts"])


def grid(stream: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Means by tumbling window."""
    d = stream.withWatermark("ts", late).groupBy("pid", F.window("ts", width)).agg(F.avg("g").alias("g"), F.count("*").alias("n"))
    return d.select("pid", F.col("window.start").alias("ts"), "g", "n")


def low_sessions(stream: DataFrame, gap: str = "15 minutes", limit: float = 70.0, least: int = 3, late: str = "1 hour") -> DataFrame:
    """Sessions of low readings that no gap interrupts, with at least so many readings."""
    d = stream.where(F.col("g") < limit).withWatermark("ts", late)
    s = d.groupBy("pid", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("g").alias("nadir"))
    return s.where(F.col("n") >= least).select("pid", F.col("session_window.start").alias("ts"), "n", "nadir")


def step_flags(stream: DataFrame, limit: float = 25.0) -> DataFrame:
    """Readings that differ from the participant's one before by more than the limit. The state is that reading.

    Readings of a batch are put in order; one that comes behind a later batch is compared with what was last seen.
    """

    def flag(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = pd.concat(batches).sort_values(["ts", "rid"])
        before = d["g"].shift()
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((float(d["g"].iloc[-1]),))
        d = d.assign(delta=d["g"] - before)
        yield d.loc[d["delta"].abs() > limit, ["pid", "ts", "delta"]]

    return stream.groupBy("pid").applyInPandasWithState(flag, "pid bigint, ts timestamp, delta double", "g double", "append", GroupStateTimeout.NoTimeout)
