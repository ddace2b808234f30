"""Readers of sensor exports: typed CSV and TSV, directories of JSON documents, per-subject files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.columns import instant, numeric, reading_value
from sensorloom.sources.subjects import subject_rows

def _frame() -> T.StructType:
    text = T.StringType()
    interval = T.StructType([T.StructField("start_date_time", text), T.StructField("end_date_time", text)])
    return T.StructType([T.StructField("time_interval", interval), T.StructField("date_time", text)])


def _document(kind: str, fields: Sequence[T.StructField]) -> T.StructType:
    item = T.StructType([T.StructField("effective_time_frame", _frame()), *fields])
    header = T.StructType([T.StructField("timezone", T.StringType())])
    return T.StructType([T.StructField("header", header), T.StructField("body", T.StructType([T.StructField(kind, T.ArrayType(item))])), T.StructField("_corrupt_record", T.StringType())])


def _value(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, T.StructType([T.StructField("value", kind)]))


#: Parts of the device documents that are read.
SCHEMAS = {
    "cgm": _document("cgm", [_value("blood_glucose", T.StringType())]),
    "stress": _document("stress", [_value("stress", T.StringType())]),
    "activity": _document("activity", [T.StructField("activity_name", T.StringType()), _value("base_movement_quantity", T.StringType())]),
}
#: Fixed value: stress where the document's value is none.
NO_STRESS = -99


def delimited(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header and declared types; only the named columns are parsed."""
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, enforceSchema=False)
    return df.select(*columns) if columns else df


def trimmed_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose column names carry blanks."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.strip() for c in df.columns])


def readings_csv(spark: SparkSession, path: str, keys: Sequence[int] | None = None) -> DataFrame:
    """(pid, ts, rid, g) from participant_id, start_datetime (ISO-8601) and glucose_value_mg_dL; what can't be parsed is null.

    ``rid`` orders records of one time by their place in the input. With ``keys`` the scan leaves out all other participants
    before it parses the rest of a line: the filter is pushed below the numbering.
    """
    raw = delimited(spark, path, "participant_id bigint, start_datetime string, glucose_value_mg_dL string")
    raw = raw if keys is None else raw.where(F.col("participant_id").isin(list(keys)))
    return raw.select(F.col("participant_id").alias("pid"), instant(F.col("start_datetime")).alias("ts"), F.monotonically_increasing_id().alias("rid"), numeric(F.col("glucose_value_mg_dL")).alias("g"))


def subject_id(pattern: str) -> Column:
    """Number in the file name of each row."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("bigint")


def documents(spark: SparkSession, path: str, kind: str, pattern: str = r"(\d+)_") -> DataFrame:
    """(pid, timezone, item) of a directory of JSON documents, one for each participant; corrupt or empty ones give none."""
    raw = spark.read.schema(SCHEMAS[kind]).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    good = raw.withColumn("pid", subject_id(pattern)).where(F.col("_corrupt_record").isNull())
    return good.select("pid", F.lower("header.timezone").alias("timezone"), F.explode(f"body.{kind}").alias("item"))


def _start() -> Column:
    frame = F.col("item.effective_time_frame")
    return F.coalesce(frame["time_interval"]["start_date_time"], frame["date_time"])


def cgm_documents(spark: SparkSession, path: str) -> DataFrame:
    """(pid, timezone, ts, g): words for the ends of the range become numbers."""
    d = documents(spark, path, "cgm")
    return d.select("pid", "timezone", instant(_start()).alias("ts"), reading_value(F.col("item.blood_glucose.value")).alias("g"))


def stress_documents(spark: SparkSession, path: str) -> DataFrame:
    d = documents(spark, path, "stress")
    value = F.coalesce(F.col("item.stress.value").try_cast("int"), F.lit(NO_STRESS))
    return d.select("pid", instant(_start()).alias("ts"), value.alias("stress"))


def activity_documents(spark: SparkSession, path: str) -> DataFrame:
    d = documents(spark, path, "activity")
    frame = F.col("item.effective_time_frame.time_interval")
    return d.select("pid", instant(frame["start_date_time"]).alias("start_ts"), instant(frame["end_date_time"]).alias("end_ts"), F.col("item.activity_name").alias("name"), numeric(F.col("item.base_movement_quantity.value")).alias("amount"))


def subject_files(spark: SparkSession, path: str, first: str, second: str, least: int = 50, pattern: str = r"(\d+)", keys: Sequence[int] | None = None) -> DataFrame:
    """(pid, ts, g) of per-subject CSVs: the first sensor's column where a subject has more than ``least`` values of it,
    else the second's. Each file is opened once and its columns are met by name (``subjects``); with
    ``keys`` only the files of those subjects are."""
    raw = subject_rows(spark, path, ["Timestamp", first, second], pattern, keys=keys)
    a, b = numeric(F.col(f"`{first}`")), numeric(F.col(f"`{second}`"))
    own = F.count(a).over(Window.partitionBy("pid")) > least
    return raw.select("pid", F.try_to_timestamp("Timestamp").alias("ts"), F.when(own, a).otherwise(b).alias("g")).where(F.col("g").isNotNull())
