"""SimHash near-duplicate linking.

Fingerprints: each word shingle is hashed with XXH64; a bit is 1 where more than half of a
text's hashes have it. Wider fingerprints mix further 64-bit words out of the same hash.

Linking (``near_components``): blocks of a fingerprint are the join keys. With 64 bits cut into five blocks, two
fingerprints that differ in at most three bits agree on at least two blocks (pigeonhole), so
the ten pairs of blocks are exact keys of 25 or 26 bits. Rows that meet on a key are
compared in full by Hamming distance. Within a key's rows only a spanning forest of the
links is emitted, found by breadth-first search over the rows not reached yet, so a large
group of near copies costs and emits about as much as it has members. A key with more than
``cap`` distinct fingerprints is cut into sub-groups, and every pair of sub-groups becomes
a task of its own: bounded memory, no link lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import give_back, join_spread, slices, stored, text_or_empty
from tessera.llm.components import components

#: Hashes held before their bits are counted.
_FLUSH = 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """Word ``j`` of a wide hash; word 0 is the hash itself."""
    if j == 0:
        return h
    z = h + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _BitCounts:
    """How many hashes of each text have each bit."""

    def __init__(self, texts: int, words: int):
        self.ones = np.zeros((texts, words * 64), dtype=np.float64)
        self.total = np.zeros(texts, dtype=np.int64)
        self.hashes: list[int] = []
        self.runs: list[tuple[int, int]] = []
        self.words = words

    def add(self, text: int, hashes: list[int]) -> None:
        self.hashes += hashes
        self.runs.append((text, len(hashes)))
        if len(self.hashes) >= _FLUSH:
            self.flush()

    def flush(self) -> None:
        if not self.hashes:
            return
        h = np.array(self.hashes, dtype=np.uint64)
        texts, counts = (np.array(x, dtype=np.int64) for x in zip(*self.runs, strict=True))
        local = np.repeat(np.arange(len(texts)) << 8, counts)
        for j in range(self.words):
            octets = _mixed(h, j).view(np.uint8).reshape(-1, 8)
            for p in range(8):
                seen = np.bincount(local + octets[:, p], minlength=len(texts) << 8).reshape(len(texts), 256)
                at = j * 64 + p * 8
                np.add.at(self.ones[:, at : at + 8], texts, seen.astype(np.float32) @ _BITS)
        np.add.at(self.total, texts, counts)
        self.hashes, self.runs = [], []

    def fingerprints(self) -> np.ndarray:
        self.flush()
        bits = self.ones * 2 > self.total[:, None]
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def fingerprint_array(texts: list[bytes | None], shingle: int, words: int) -> np.ndarray:
    """(texts, words) unsigned 64-bit. A text with fewer words than a shingle is one shingle;
    without any word its fingerprint is zero. Only A-Z are lower-cased."""
    counts, h = _BitCounts(len(texts), words), xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        w = (text or b"").lower().split()
        if not w:
            continue
        last = max(1, len(w) - shingle + 1)
        for at in range(0, last, _FLUSH):
            stop = min(last, at + _FLUSH)
            columns = [w[at + k : stop + k] for k in range(min(shingle, len(w)))]
            counts.add(i, [h(b" ".join(x), 42) for x in zip(*columns, strict=True)])
    return counts.fingerprints()


def fingerprints(docs: DataFrame, id_col: Column, text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """(id long, fp) per row of ``docs``; fp is a long, or a binary of ``words`` little-endian
    64-bit words where there are several. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                fp = fingerprint_array(part.column(1).cast(pa.binary()).to_pylist(), shingle, words)
                if words == 1:
                    packed = pa.array(fp[:, 0].view(np.int64))
                else:
                    wide = pa.binary(8 * words)
                    packed = pa.FixedSizeBinaryArray.from_buffers(wide, len(fp), [None, pa.py_buffer(np.ascontiguousarray(fp))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed], ["id", "fp"])
            give_back()

    kind = "long" if words == 1 else "binary"
    return docs.select(id_col.cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id long, fp {kind}")


def pigeonhole_keys(fp: Column, bits: int = 64, blocks: int = 5, distance: int = 3) -> Column:
    """Keys of a 64-bit fingerprint: all choices of ``blocks - distance`` of its blocks, hashed
    with the number of the choice (a clash of hashes only adds a candidate)."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])


def forest(ids: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (root, member) that connect what links within ``distance`` connect."""
    if len(ids) == 2:
        return [(int(ids[0]), int(ids[1]))] if np.bitwise_count(fps[0] ^ fps[1]).sum() <= distance else []
    out, rest = [], np.arange(len(ids))
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[queue.pop()]).sum(axis=1) <= distance
            hit, rest = rest[near], rest[~near]
            out += [(int(ids[root]), int(ids[x])) for x in hit]
            queue += list(hit)
    return out


def _forests(distance: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made(parts: list[tuple], last: bool) -> tuple[list[tuple[int, int]], list[tuple]]:
            key, tile, ids, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(ids)]])
            stop, links = len(bounds) - 1 if last else len(bounds) - 2, []
            size = np.diff(bounds[: stop + 1])
            two = bounds[:stop][size == 2]
            ok = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1) <= distance
            links += zip(ids[two[ok]].tolist(), ids[two[ok] + 1].tolist(), strict=True)
            for k in np.flatnonzero(size > 2):
                at = slice(bounds[k], bounds[k + 1])
                links += forest(ids[at], fps[at], distance)
            at = bounds[stop]
            return links, [] if last else [(key[at:], tile[at:], ids[at:], fps[at:])]

        for b in batches:
            if not b.num_rows:
                continue
            key, tile, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if words == 1:
                fps = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
            else:
                fps = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype="<u8").reshape(-1, words)
            held.append((key, tile, ids, fps))
            if (held[0][0][0], held[0][1][0]) != (key[-1], tile[-1]):
                links, held = made(held, False)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
        if held:
            links, held = made(held, True)
            give_back()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return run


def links(keyed: DataFrame, fps: DataFrame | None, distance: int, words: int = 1, cap: int = 50_000) -> DataFrame:
    """Rows (key, id[, fp]) of distinct fingerprints -> links (a, b) of ids that
    connect whatever links within ``distance`` over rows with a common key connect.

    ``fps`` (id, fp) is joined only to rows that share a key, where ``keyed`` has no fp.
    """
    dealt = keyed.repartition("key")
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = dealt.join(shared.hint("merge"), "key")
    parts = F.ceil(F.col("n") / F.lit(cap)).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * F.lit(65536) + F.greatest(own, j))
    rows = rows.withColumn("tile", F.explode(F.when(F.col("n") > cap, tiles).otherwise(F.array(F.lit(0))))).drop("n")
    if fps is not None:
        rows = rows.join(fps.hint("merge"), "id")
    return (
        rows.select("key", "tile", "id", "fp")
        .repartition("key", "tile")
        .sortWithinPartitions("key", "tile", "id")
        .mapInArrow(_forests(distance, words), "a long, b long")
    )


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, cap: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the
    smallest id reachable over links, itself included).

    Fingerprints (64 bits) link at ``distance`` or fewer differing bits. A null text counts as
    empty; texts without words have fingerprint zero and link like any other. Rows with a
    null id get a component, but never name one unless all its ids are null (then null).
    Repeated rows each get a row. An empty table gives an empty result; other columns are
    not read.
    """
    fp = stored(
        fingerprints(docs, F.col(id_col), text_col, shingle).withColumnRenamed("id", "doc_id"),
        "simhash",
    )
    distinct = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "simhash-distinct")
    keyed = distinct.select(
        F.explode(pigeonhole_keys(F.col("fp"), distance=distance, blocks=distance + 2)).alias("key"), F.col("fp").alias("id")
    ).select("key", "id", F.col("id").alias("fp"))
    comp = components(links(keyed, None, distance, cap=cap))
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, "simhash-components")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    sizes = named.groupBy("component").agg(F.count("*").alias("n"))
    of_fp = join_spread(named, least, "component", F.xxhash64("fp"), sizes).select("fp", "component_id")
    return join_spread(fp, of_fp, "fp", F.xxhash64("doc_id"), distinct).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

