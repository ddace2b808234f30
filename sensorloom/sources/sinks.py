"""Writers: whole tables, hand-offs that are checked first, replicates that can be resumed, small metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sensorloom.operators.cohort import GuardError
from sensorloom.session import there


def whole_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, sep=sep) if fmt == "csv" else writer.format(fmt).save(path)


def computed_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none, what ``make`` gives is written there first. A folder that a job left before
    its end, which has no mark of success, is none."""
    if not there(spark, f"{path}/_SUCCESS"):
        whole_table(make(), path)
    return spark.read.parquet(path)


def publish_checked(df: DataFrame, path: str, ours: str, theirs: str, least: float = 0.999) -> float:
    """Write only if both columns correlate at least that much; returns the correlation."""
    r = df.agg(F.corr(ours, theirs)).head()[0]
    if r is None or r < least:
        raise GuardError(f"correlation {r} of {ours} and {theirs} is below {least}; nothing was written")
    whole_table(df, path)
    return r


def replicates_left(spark: SparkSession, path: str, wanted: Iterable[int]) -> list[int]:
    """Replicate numbers that the table at ``path`` lacks."""
    done = set()
    if there(spark, path):
        try:
            done = {r["rep"] for r in spark.read.parquet(path).select("rep").distinct().collect()}
        except AnalysisException as e:
            # A folder without any replicate yet; anything else is an error.
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
    return [r for r in wanted if r not in done]


def append_replicate(df: DataFrame, path: str, rep: int) -> None:
    """Add one replicate's rows as its own partition; a repeated attempt replaces it."""
    df.withColumn("rep", F.lit(rep)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rep").parquet(path)


def save_metadata(spark: SparkSession, path: str, **values: object) -> None:
    """Names and JSON texts as a small table."""
    import json

    rows = [(k, json.dumps(v)) for k, v in values.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def load_metadata(spark: SparkSession, path: str) -> dict[str, object]:
    import json

    return {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(path).collect()}
