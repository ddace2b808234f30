"""Views of the given tables that drive the operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import table

READINGS = "SELECT user_id AS pid, ts, event_id AS rid, 45 + value AS g FROM events"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, ts, rid, g): the events as sensor readings."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("pid"), "ts", F.col("event_id").alias("rid"), (45 + F.col("value")).alias("g"))


def offset(pid: str = "pid") -> Column:
    return F.when(F.col(pid) % 3 == 0, -6).otherwise(-8)


OFFSET = "CASE WHEN pid % 3 = 0 THEN -6 ELSE -8 END"
HOUR = f"((extract(hour FROM ts) + {OFFSET} + 24) % 24)"


def label3(pid: str = "pid") -> Column:
    """Class code of a participant: 2 (few), 0, 1."""
    return F.when(F.col(pid) % 10 == 0, 2).when(F.col(pid) % 3 == 0, 0).otherwise(1)


LABEL3 = "CASE WHEN pid % 10 = 0 THEN 2 WHEN pid % 3 = 0 THEN 0 ELSE 1 END"

ANALYSIS = """
  SELECT c.c_custkey AS person_id, c.c_nationkey AS nation, c.c_acctbal AS bal, c.c_mktsegment AS segment,
         o.n_orders, o.mean_price, o.max_price, o.first_day
  FROM customer c LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice::DECIMAL(24, 6))::DOUBLE / nullif(count(o_totalprice), 0) AS mean_price, max(o_totalprice) AS max_price, min(o_orderdate)::DATE AS first_day
    FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey"""


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each person: customers with what their orders add up to (null without orders). Prices are summed as
    decimals, so that equal orders give equal means in any order of the rows: ranks depend on which means are tied."""
    mean = F.sum(F.col("o_totalprice").cast("decimal(24,6)")).cast("double") / F.nullif(F.count("o_totalprice"), F.lit(0))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.count("*").alias("n_orders"), mean.alias("mean_price"), F.max("o_totalprice").alias("max_price"), F.min("o_orderdate").cast("date").alias("first_day")
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    return people.join(orders, "person_id", "left")


NUDGE = 3e-10


def nudged(sql: str) -> str:
    return sql.replace("round(", f"round({NUDGE} + ")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show; the nudge keeps exact halves from going either way."""
    return df.select(*((F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
