"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and an aggregation over edges; nothing is collected, and each round is
written to the shared work folder, so lineage stays short. Rounds grow with the logarithm of
the longest chain. The centre of a large star is a hot key and dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import join_spread, stored


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def _round(edges: DataFrame) -> DataFrame:
    """edges (a < b) -> edges (a < b) nearer to a star around each component's minimum."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    large = join_spread(both, low.drop("n"), "a", F.xxhash64("b"), low).filter("b > a").select(F.col("m").alias("a"), "b").distinct()
    low = large.groupBy("b").agg(F.min("a").alias("m"))
    return (
        large.join(low, "b")  # a node has few smaller neighbours after the large step
        .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e"))
        .select("e.*")
        .filter("a < b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (node, component): the smallest node reachable from each
    node that has a link. Loops, repeated and reversed pairs are fine; no pairs, no rows."""
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    seen = _fingerprint(e)
    while True:
        e = stored(_round(e), "edges")
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
