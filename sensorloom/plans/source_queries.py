"""Queries that send the given tables through the writers and readers, in the shared folder, and sum up what comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.plans.registering import register
from sensorloom.plans.views import readings
from sensorloom.session import shared_dir, table
from sensorloom.sources import readers, sinks

QUERIES, SQL = {}, {}
query = register(QUERIES, SQL)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT user_id AS pid, count(*) AS n, count(DISTINCT ts) AS n_ts, round(avg(45 + value), 6) AS mean_g FROM events GROUP BY 1")
def csv_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written as CSV and read back by declared types."""
    return _per_participant(readers.readings_csv(spark, _csv(spark, sf_dir)))


@query("SELECT user_id AS pid, count(*) AS n, count(DISTINCT ts) AS n_ts, round(avg(45 + value), 6) AS mean_g FROM events WHERE user_id % 5 = 0 AND user_id < 500 GROUP BY 1")
def csv_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a list of participants, which the scan of the CSV takes as its filter."""
    return _per_participant(readers.readings_csv(spark, _csv(spark, sf_dir), list(range(0, 500, 5))))


def _per_participant(r: DataFrame) -> DataFrame:
    return r.groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("n_ts"), F.avg("g").alias("mean_g"))


def _csv(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "readings")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    out = readings(spark, sf_dir).select(F.col("pid").alias("participant_id"), iso.alias("start_datetime"), F.col("g").alias("glucose_value_mg_dL"))
    sinks.whole_table(out, path, "csv")
    return path


def _subjects(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each participant with a file of two sensors, or of the second alone and in another order."""
    path = _folder(spark, "subjects")
    r = readings(spark, sf_dir).select("pid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("g").cast("string").alias("Sensor A"), (F.col("g") - 45).cast("string").alias("Sensor B"))
    for part, columns in ((0, ["Timestamp", "Sensor A", "Sensor B"]), (1, ["Sensor B", "Timestamp"])):
        own = r.where(F.col("pid") % 2 == part).select("pid", *columns)
        # Names of files hang on the task alone, so tasks may publish their own files; the driver would do it one by one.
        out = own.repartition(4 * spark.sparkContext.defaultParallelism, "pid").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        out.partitionBy("pid").mode("append").csv(path, header=True)
    return path


_SUBJECTS = "SELECT user_id AS pid, count(*) AS n, round(avg(CASE WHEN user_id % 2 = 0 AND n > 50 THEN 45 + value ELSE value END), 6) AS mean_g FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"{_SUBJECTS} GROUP BY 1")
def subject_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-subject files whose columns differ, many small ones to a task."""
    r = readers.subject_files(spark, _subjects(spark, sf_dir), "Sensor A", "Sensor B", pattern=r"pid=(\d+)")
    return r.groupBy("pid").agg(F.count("*").alias("n"), F.avg("g").alias("mean_g"))


@query(f"{_SUBJECTS} WHERE user_id < 20 GROUP BY 1")
def subject_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of some subjects alone."""
    r = readers.subject_files(spark, _subjects(spark, sf_dir), "Sensor A", "Sensor B", pattern=r"pid=(\d+)", keys=list(range(20)))
    return r.groupBy("pid").agg(F.count("*").alias("n"), F.avg("g").alias("mean_g"))


@query("SELECT CASE c_nationkey % 3 WHEN 0 THEN 'UAB' WHEN 1 THEN 'UW' ELSE 'UCSD' END AS clinical_site, count(*) AS n FROM customer GROUP BY 1")
def tsv_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "participants")
    site = F.element_at(F.array(F.lit("UAB"), F.lit("UW"), F.lit("UCSD")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), site.alias("clinical_site"), F.lit("train").alias("recommended_split"))
    sinks.whole_table(people, path, "csv", sep="\t")
    return readers.delimited(spark, path, "person_id bigint, clinical_site string, recommended_split string", ["clinical_site"], "\t").groupBy("clinical_site").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def trimmed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "blanks")
    sinks.whole_table(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(" key "), F.col("o_orderpriority").alias("  priority")), path, "csv")
    return readers.trimmed_header(spark, path).groupBy("priority").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(avg(m), 6) AS mean_g, true AS published FROM (SELECT user_id, avg(45 + value) AS m FROM events GROUP BY 1)")
def checked_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to a mean have to agree before the table is written."""
    path = _folder(spark, "handoff")
    g = F.col("g")
    r = sinks.publish_checked(readings(spark, sf_dir).groupBy("pid").agg(F.avg(g).alias("ours"), (F.sum(g) / F.count(g)).alias("theirs")), path, "ours", "theirs")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.avg("ours").alias("mean_g"), F.lit(r >= 0.999).alias("published"))


@query("SELECT event_id % 4 AS rep, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def resumed_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates that are there aren't made again."""
    path = _folder(spark, "replicates")
    events = table(spark, sf_dir, "events")
    part = lambda rep: events.where(F.col("event_id") % 4 == rep).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    for wanted in (range(2), range(4)):
        for rep in sinks.replicates_left(spark, path, wanted):
            sinks.append_replicate(part(rep), path, rep)
    return spark.read.parquet(path).select(F.col("rep").cast("bigint").alias("rep"), "n", "mean_value")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intermediate that is computed once and loaded after that, with its metadata beside it."""
    path = _folder(spark, "counts")
    make = lambda: table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    sinks.save_metadata(spark, f"{path}-meta", columns=sinks.computed_once(spark, path, make).columns)
    return sinks.computed_once(spark, path, make).select(*sinks.load_metadata(spark, f"{path}-meta")["columns"])
