"""Ranks and running counts over a whole column without a single-task sort.

Distinct values are counted, dealt over range partitions and numbered inside each; the sizes of the
parts, a row each, give every part its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.sources import files


def cumulative(rows: DataFrame, value, name: str = "v") -> DataFrame:
    """``name`` (distinct values of the column), c (rows with it), up (rows up to and with it), n (all
    rows), part (its range partition). Nulls are left out."""
    counts = files.reread(rows.groupBy(F.col(value).alias(name) if isinstance(value, str) else value.alias(name)).agg(F.count("*").alias("c")).filter(F.col(name).isNotNull()), "rank-counts")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.reread(counts.repartitionByRange(parts, name).withColumn("part", F.spark_partition_id()), "rank-parts")
    before = F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("part").agg(F.sum("c").alias("s")).select("part", before.alias("b"), F.sum("s").over(W.partitionBy(F.lit(0))).alias("n"))  # a row per part
    up = F.sum("c").over(W.partitionBy("part").orderBy(name).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("up", up).join(F.broadcast(starts), "part").select(name, "c", (F.col("up") + F.col("b")).alias("up"), "n", "part")


def later_min(table: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """A table of ``cumulative`` with the least ``value`` of this and all later rows."""
    held = files.reread(table, "rank-values")
    down = F.min(value).over(W.partitionBy("part").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    after = F.min("m").over(W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1))
    later = held.groupBy("part").agg(F.min(value).alias("m")).select("part", after.alias("_after"))  # a row per part
    return held.withColumn("_down", down).join(F.broadcast(later), "part").withColumn(name, F.least("_down", "_after")).drop("_down", "_after")
