"""Shared plumbing: work folders on the cluster's shared store and text defaults."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts: space and \t \n \v \f \r.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; on a cluster the
    setting must name a store that every executor can reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in a work folder and read it back: cuts the lineage, and
    the copy outlives any executor."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """``stem`` or a longer name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: A key with more than this many rows, and more than a ``HEAVY``-th of all, is dealt over tasks.
HEAVY = 10_000


def join_spread(rows: DataFrame, table: DataFrame, key: str, spread: Column, counts: DataFrame, n: str = "n") -> DataFrame:
    """Inner join of many ``rows`` with the one or few rows that ``table`` has for each ``key``.

    ``counts`` (key, ``n``) says how many of ``rows`` a key has. The rows of a hot key are dealt by
    ``spread`` over as many tasks as they need, and the table's row goes to each of these. There are
    at most ``HEAVY`` hot keys whatever the input (each has over 1/HEAVY of all rows), so their list
    is small enough to broadcast. The result is that of the plain join.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    if total <= HEAVY:
        return rows.join(table, key)
    bound = max(HEAVY, total // HEAVY)
    hot = F.broadcast(counts.filter(F.col(n) > bound).select(key, F.ceil(F.col(n) / F.lit(bound)).cast("int").alias("_tasks")))
    tasks = F.coalesce("_tasks", F.lit(1))
    left = rows.withColumn("_spread", spread).join(hot, key, "left").withColumn("_salt", F.pmod("_spread", tasks).cast("int"))
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return left.drop("_tasks", "_spread").join(right.drop("_tasks"), [key, "_salt"]).drop("_salt")


#: Rows that Spark sends to a Python worker at once: one value for all queries and stages.
BATCH = 2000


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH`` rows. Applications (queries, pipeline stages) call
    this; operators never change the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in ``column`` have about ``most_bytes`` at most; a longer text is
    a part of its own."""
    at, size = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(size, before + most_bytes, side="right"))), at + most_rows)
        yield batch.slice(at, stop - at)
        at = stop


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers outlive their tasks, and an
    executor's memory limit counts what they keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
