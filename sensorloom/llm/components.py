"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import discard, written

#: Edges (16 bytes each) of a task; a table of fewer is one task, whose rounds need no shuffle.
TASK_EDGES = 200_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) of every node with a link to another: root is the smallest node of its component.

    Each round hangs neighbours below the smallest one they see, so the number of rounds grows with the logarithm of the
    longest path. A node with many neighbours is one window of narrow rows, which spills. Nulls and loops are no links.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    edges = written(edges, "stars")
    mark = _mark(edges)
    while mark[0]:
        old, edges = edges, edges.coalesce(1 + mark[0] // TASK_EDGES)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u > v").distinct(), "stars")
        discard(old)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
