"""Panel views over the star-schema tables: long facts, wide panel, nodes, vectors, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First word of a part's type and the panel part it stands for, in panel order.
PARTS = {"ECONOMY": "prod", "LARGE": "health", "MEDIUM": "market", "PROMO": "food", "SMALL": "transp", "STANDARD": "proch"}
SUFFIXES = list(PARTS.values())
FIRST_YEAR, MONTHS = 1996, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, month 'yyyy-MM', part, value: two years of facts, summed per cell."""
    part = F.element_at(F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv]), F.split("p_type", " ")[0])
    facts = table(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "1998-01-01"))
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), part.alias("part"))
    return (
        facts.join(kinds, "l_partkey")
        .groupBy(F.col("l_suppkey").alias("entity"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), "part")
        .agg(F.sum("l_extendedprice").alias("value"))
    )


def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity and month: val_<part>, val_all, month_idx 0..23."""
    sums = [F.sum(F.when(F.col("part") == s, F.col("value")).otherwise(0.0)).alias(f"val_{s}") for s in SUFFIXES]
    idx = (F.substring("month", 1, 4).cast("int") - FIRST_YEAR) * 12 + F.substring("month", 6, 2).cast("int") - 1
    wide = panel_long(spark, sf_dir).groupBy("entity", "month").agg(*sums, F.sum("value").alias("val_all"))
    return wide.withColumn("month_idx", idx)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, region_code, region_name, account."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("region_code"), F.col("r_name").alias("region_name"), F.col("s_acctbal").alias("account"))


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, lat, lon from two embedding components."""
    e = table(spark, sf_dir, "embeddings")
    lat, lon = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return e.select(F.col("vec_id").alias("entity"), (F.lit(55.0) + lat * 40).alias("lat"), (F.lit(60.0) + lon * 80).alias("lon"))


def labels_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, month_idx, type_id (largest part, smallest number on ties), seed_agreement."""
    vals = F.array(*[F.col(f"val_{s}") for s in SUFFIXES])
    wide = panel_wide(spark, sf_dir)
    return wide.select(
        "entity", "month_idx",
        (F.array_position(vals, F.array_max(vals)) - 1).cast("int").alias("type_id"),
        (F.array_max(vals) / F.col("val_all")).alias("seed_agreement"),
    )
