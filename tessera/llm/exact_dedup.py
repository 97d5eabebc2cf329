"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after every ASCII white-space character is
deleted. Grouping is always by (digest, full normalised content), never by digest alone,
so two texts that share a digest stay apart:

1. in each task, equal texts are combined before anything is shuffled;
2. what is left is merged by (digest, salt, content), the salt being the task's: a group of copies
   that holds a third of the corpus arrives at most once per task, dealt over ``salts`` reducers;
3. the winners of the salts are merged by (digest, content).

Then every row finds its winner by digest, rows of hot digests being dealt over several tasks.
Digests with more than one content (none with SHA-256 in practice) are looked up by digest and
content. Rows are named by what they hold (id, length, digest), never by a number that a second
scan could deal out differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._util import ASCII_SPACE, free_name, join_spread, stored, text_or_empty


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, ASCII_SPACE + "+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _prepared(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).alias("_len"),
        normalised(text).alias("_norm"),
    ).withColumn("_digest", digest(F.col("_norm")))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """(_digest, _contents, _norm where the digest is shared, keep_id, _keep_len, group_size): a
    row per text."""
    win = F.struct((-F.col("_len")).alias("short"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    by_salt = salted.groupBy("_digest", "_salt", "_norm").agg(F.min(win).alias("_win"), F.count("*").alias("_n"))
    merged = (
        by_salt.repartition("_digest")
        .groupBy("_digest", "_norm")
        .agg(F.min("_win").alias("_win"), F.sum("_n").alias("_n"))
    )
    contents = F.count("*").over(W.partitionBy("_digest"))
    return merged.select(
        "_digest",
        contents.alias("_contents"),
        "_norm",
        F.col("_win.doc_id").alias("keep_id"),
        (-F.col("_win.short")).alias("_keep_len"),
        F.col("_n").alias("group_size"),
    ).withColumn("_norm", F.when(F.col("_contents") > 1, F.col("_norm")))


def _judged(rows: DataFrame, salts: int) -> DataFrame:
    """A row per (doc_id, _len, _digest, _norm where the digest is shared): keep_id, group_size,
    ``_win`` (such a row stays) and ``_same``, how many rows these are."""
    best = stored(_winners(rows, salts), "exact-winners")

    def looked_up(names: list[str], winners: DataFrame) -> DataFrame:
        kinds = rows.groupBy("doc_id", "_len", *names).agg(F.count("*").alias("_same"))
        sizes = winners.groupBy("_digest").agg(F.max("group_size").alias("_n"))
        if len(names) == 1:
            return join_spread(kinds, winners.drop("_norm"), "_digest", F.xxhash64("doc_id", "_len"), sizes, "_n").withColumn("_norm", F.lit(None).cast("string"))
        return kinds.join(winners, names)

    found = looked_up(["_digest"], best.filter("_contents = 1").drop("_contents"))
    if not best.filter("_contents > 1").isEmpty():
        found = found.unionByName(looked_up(["_digest", "_norm"], best.filter("_contents > 1").drop("_contents")))
    return found.withColumn("_win", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_len") == F.col("_keep_len")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (binary).

    The row with the most code points in its original text stays, then the one with the
    smallest id (a null id counts as the largest); of rows alike in both, which then have equal
    results otherwise, exactly one stays. A null text counts as empty, and empty texts form
    one group. An empty table gives an empty result. Other columns are not read.
    """
    rows = _judged(_prepared(docs, id_col, text_col, digest), salts)
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))).alias("_nth")
    return rows.select("doc_id", "keep_id", "group_size", "_win", "_digest", nth).select(
        "doc_id", "keep_id", "group_size", (F.col("_win") & (F.col("_nth") == 1)).alias("kept"), F.col("_digest").alias("digest")
    )


def without(docs: DataFrame, keys: dict[str, Column], lost: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``keys`` (columns by name) stand in ``lost``; of rows whose
    keys stand in ``repeated`` one stays, that with the smallest JSON of all columns."""
    names, mine = docs.columns, {}
    for k, c in keys.items():
        mine[k] = free_name(docs, "_key_" + k)
        docs = docs.withColumn(mine[k], c)

    def same(other: DataFrame) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(mine[k]).eqNullSafe(other[k])
        return out

    left = docs.join(lost, same(lost), "left_anti")
    if repeated.isEmpty():
        return left.select(*names)
    row = F.struct(*names)
    one = left.join(repeated, same(repeated), "left_semi").groupBy(*mine.values()).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return left.join(repeated, same(repeated), "left_anti").select(*names).unionByName(one.select("_row.*"))


def drop_exact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = 16) -> DataFrame:
    """``docs`` without the rows whose text another row keeps, as in ``exact_groups``; all columns
    stay. Of rows alike in id, text and length the one with the smallest JSON of all its columns
    stays. Should two contents ever share a SHA-256 digest, the call fails."""
    judged = _judged(_prepared(docs, id_col, text_col, sha256), salts).filter("group_size > 1 and (not _win or _same > 1)")
    told = stored(judged.select("doc_id", "_len", "_digest", "_norm", "_win"), "exact-decisions")
    text = text_or_empty(text_col)
    keys = {"doc_id": F.col(id_col).cast("long"), "_len": F.length(text), "_digest": sha256(normalised(text))}
    if not told.filter("_norm is not null").isEmpty():
        raise ValueError("two contents have the same SHA-256 digest")
    told = told.drop("_norm")
    return without(docs, keys, told.filter("not _win").drop("_win"), told.filter("_win").drop("_win"))
