"""Files beside tables: text formats, snapshots, settings, runs, templates."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one only for a local session
    without that setting, as on a cluster executors do not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def reread(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a written table: cuts the lineage and outlives executors."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def through_csv(df: DataFrame, name: str) -> DataFrame:
    """Written as CSV with a header and read with the same schema."""
    path = work_folder(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, as JSON has no such numbers."""
    kinds = dict(df.dtypes)
    odd = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return df.select(*[F.when(~odd(F.col(c)), F.col(c)).alias(c) if kinds[c] in ("double", "float") else c for c in df.columns])


def through_json(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    finite(df).write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_snapshots(df: DataFrame, path: str, by: str = "month_idx") -> None:
    """One folder for each value of ``by``."""
    df.repartition(by).write.partitionBy(by).parquet(path)


def read_snapshots(spark: SparkSession, path: str, first: int, last: int, shape: str, by: str = "month_idx") -> DataFrame:
    """The snapshots from ``first`` to ``last`` (other folders are not opened). All must have the
    same number of distinct ``shape`` values."""
    rows = spark.read.parquet(path).filter(F.col(by).between(first, last))
    sizes = rows.groupBy(by).agg(F.count_distinct(shape).alias("n")).agg(F.min("n"), F.max("n")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"snapshots have from {sizes[0]} to {sizes[1]} {shape}")
    return rows


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``, nested settings one by one."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def flat(settings: dict, before: str = "") -> list[tuple[str, str]]:
    rows: list[tuple[str, str]] = []
    for k, v in settings.items():
        rows += flat(v, f"{before}{k}.") if isinstance(v, dict) else [(before + k, str(v))]
    return rows


def latest(runs: DataFrame, usable, *newest) -> DataFrame:
    """The first usable row in the order ``newest``."""
    return runs.filter(usable).orderBy(*newest).limit(1)


def rendered(template: str, values: dict[str, str]) -> str:
    """A filled-in template; a key without a value is an error."""
    return string.Template(template).substitute(values)
