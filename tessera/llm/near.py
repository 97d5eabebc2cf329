"""Near-copy removal at a Jaccard similarity of word shingles, by wide SimHash fingerprints.

At a similarity of 0.8 about 15 % of a fingerprint's bits differ, so no cut of the bits into a few
blocks leaves one intact. The pigeonhole is on the shingles that make the fingerprint instead: of a
text's ``s`` distinct shingles a partner can lack at most ``s - ceil(0.8 s)``, so of any that many
plus one it holds one. The rarest shingles are taken (one order for all texts), so a passage that
many documents share brings none of them together. Then:

1. texts that meet on such a block key are compared by Hamming distance of 256 bits, with a cut
   so loose (``CUT``) that a pair at the similarity is never beyond it in practice; what is linked
   makes clusters of candidates;
2. inside a cluster the Jaccard similarity of the shingle sets decides, exactly; groups are the
   connected components of these links.

A cluster of more than ``PART`` shingles is cut into parts. Each part gets the cluster's first text
too: members linked to it in their parts are one group already; the few that are not meet every
part. So memory is bounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import give_back, join_spread, slices, stored, text_or_empty
from tessera.llm.components import components
from tessera.llm.exact_dedup import without
from tessera.llm.simhash import _mixed, links

#: 64-bit words of a fingerprint; differing bits up to which two texts are candidates (at the
#: similarity 39 are expected with a deviation of 6; between unrelated texts 128, deviation 8).
WORDS, CUT = 4, 76
#: Shingles in a part of a cluster.
PART = 2_000_000
#: Cells of the table of hashed document counts that orders shingles by rarity.
CELLS = 18
_STEP = [np.uint64(x) for x in np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.int64) * 2 + 1]


def shingle_sets(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (unsigned 64-bit, ascending within a text, no repeats) of the texts' shingles, and each
    text's bounds. Words are runs without ASCII white space, A-Z lowered; a text with fewer words
    than a shingle is one shingle, one without words has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    ends = lists.offsets.to_numpy()
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in names), np.uint64, len(names))
    at = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([bool(w) for w in names], bool)[at] if len(at) else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(full)])[ends - ends[0]]
    words = of_word[at[full]]
    size = np.diff(bounds)
    many = np.where(size > 0, np.maximum(1, size - shingle + 1), 0)
    doc = np.repeat(np.arange(len(size)), many)
    start = np.repeat(bounds[:-1] - np.cumsum(many) + many, many) + np.arange(len(doc))
    left = bounds[1:][doc] - start
    h = np.minimum(left, shingle).astype(np.uint64)
    for k in range(shingle):
        inside = left > k
        h[inside] += words[start[inside] + k] * _STEP[k % len(_STEP)]
        h = _mixed(h, 1)
    parts = np.cumsum(many)[:-1]
    sets = [np.unique(x) for x in np.split(h, parts)] if len(size) else []
    return (np.concatenate(sets) if len(h) else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _majorities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, WORDS) fingerprints: bits that over half of a text's hashes have."""
    out, size = np.zeros((len(bounds) - 1, WORDS), np.uint64), np.diff(bounds)
    full = np.flatnonzero(size)
    for j in range(WORDS if len(full) else 0):
        ones, k = np.zeros((len(full), 64), np.int32), 0
        while k < len(full):  # about 100,000 hashes at a time
            lo = bounds[full[k]]
            stop = max(k + 1, int(np.searchsorted(bounds[full + 1], lo + 100_000, side="right")))
            bits = np.unpackbits(_mixed(h[lo : bounds[full[stop - 1] + 1]], j + 1).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k:stop] = np.add.reduceat(bits, bounds[full[k:stop]] - lo, axis=0, dtype=np.int32)
            k = stop
        out[full, j] = np.packbits(ones * 2 > size[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _rarity(texts: DataFrame, shingle: int) -> np.ndarray:
    """Per cell of shingle hashes the number of bits of its document count: a table of fixed size,
    over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELLS, np.int64)
        for b in batches:
            for part in slices(b, 0, 1 << 20):
                n += np.bincount((shingle_sets(part.column(0), shingle)[0] >> np.uint64(64 - CELLS)).astype(np.int64), minlength=len(n))
        give_back()
        full = np.flatnonzero(n)
        for k in range(0, len(full), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(full[k : k + (1 << 16)]), pa.array(n[full[k : k + (1 << 16)]])], ["cell", "n"])

    got = texts.select("t").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELLS, np.uint8)
    out[got["cell"].to_numpy()] = np.floor(np.log2(np.maximum(got["n"].to_numpy(), 1))).astype(np.uint8)
    return out


def block_keys(hashes: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The rarest hashes of a set, one more than a partner of that similarity can lack."""
    s = len(hashes)
    order = np.lexsort((hashes, rarity[(hashes >> np.uint64(64 - CELLS)).astype(np.int64)]))
    return hashes[order[: s + (-percent * s // 100) + 1]] if s else hashes


def set_forest(ids: np.ndarray, flat: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (root, member) that connect what a Jaccard similarity of ``percent`` connects. Overlaps
    are counted through an index of hashes, so unrelated sets cost nothing."""
    size, m = np.diff(bounds), len(ids)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    doc = np.repeat(np.arange(m), size)[order]
    first = np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
    out, waiting = [], np.ones(m, bool)
    for r in range(m):
        if not waiting[r]:
            continue
        waiting[r], queue = False, [r]
        while queue:
            x = queue.pop()
            c = code[bounds[x] : bounds[x + 1]]
            many = first[c + 1] - first[c]
            at = np.repeat(first[c] - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(doc[at], minlength=m)
            for y in np.flatnonzero(waiting & (both * 100 >= percent * (size[x] + size - both)) & ((both > 0) | (size + size[x] == 0))):
                waiting[y] = False
                out.append((int(ids[r]), int(ids[y])))
                queue.append(y)
    return out


def _forests(percent: int):
    """Rows (component, part, node, hub, set) by component and part -> (a, b) links, and (node, null)
    for members of a part that are not connected to the hub in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: list[tuple]) -> pa.RecordBatch:
            one = {node: raw for node, _, raw in rows}
            ids, sets = np.array(list(one), np.int64), [np.frombuffer(x, "<u8") for x in one.values()]
            made = set_forest(ids, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64), percent)
            hub, root = next((n for n, h, _ in rows if h), None), dict(zip(ids.tolist(), ids.tolist(), strict=True))
            root.update({b: a for a, b in made})
            apart = [n for n in one if hub is not None and root[n] != root[hub]]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in made] + apart, pa.int64()), pa.array([b for _, b in made] + [None] * len(apart), pa.int64())], ["a", "b"])

        held, now = [], None
        for b in batches:
            for component, part, node, hub, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (component, part) != now:
                    if len(held) > 1:
                        yield settled(held)
                    held, now = [], (component, part)
                held.append((node, hub, raw))
        if len(held) > 1:
            yield settled(held)
        give_back()

    return run


def _exact_links(members: DataFrame, percent: int) -> DataFrame:
    """(component, node, n, set) -> (a, b): links that connect what the similarity connects."""
    sizes = members.groupBy("component").agg(F.sum("n").alias("t"), F.count("*").alias("n"), F.min("node").alias("first"))
    sizes = sizes.select("component", "n", "first", F.greatest(F.ceil(F.col("t") / PART), F.lit(1)).cast("int").alias("parts"))
    rows = join_spread(members.drop("n"), sizes.drop("n"), "component", F.xxhash64("node"), sizes)
    own, every = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)

    def met(rows: DataFrame, everywhere, hub) -> DataFrame:
        placed = rows.withColumn("hub", hub).withColumn("part", F.explode(F.when(everywhere, every).otherwise(F.array(own))))
        dealt = placed.select("component", "part", "node", "hub", "set").repartition("component", "part")
        return stored(dealt.sortWithinPartitions("component", "part", "node").mapInArrow(_forests(percent), "a long, b long"), "near-links")

    is_first = F.col("node") == F.col("first")
    found = met(rows, is_first, is_first & (F.col("parts") > 1))
    apart = found.filter("b is null").select(F.col("a").alias("node"), F.lit(True).alias("apart"))
    if not apart.isEmpty():
        rest = rows.filter("parts > 1").join(apart, "node", "left")
        found = found.unionByName(met(rest, F.coalesce("apart", F.lit(False)), F.lit(False)))
    return found.filter("b is not null").select("a", "b")


def drop_near(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80, cap: int = 20_000) -> DataFrame:
    """``docs`` with one row of each group of near copies, that with the smallest id (null last, then
    the smallest digest of the text); all columns stay.

    Two texts are near copies if their sets of ``shingle``-word shingles have a Jaccard similarity of
    ``percent`` or more; a group is what such links connect. A null text counts as empty; texts
    without words are one group. Of rows with the same id and text the one with the smallest JSON
    of all its columns stays. An empty table gives an empty result.
    """

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2, 1 << 20):
                h, bounds = shingle_sets(part.column(2), shingle)
                fp = np.ascontiguousarray(_majorities(h, bounds).astype("<u8"))
                sets = [h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                keys = [block_keys(x, rarity, percent).view(np.int64) for x in sets]
                same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), len(fp), [None, pa.py_buffer(fp)]).cast(pa.binary())
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(same, pa.binary()), pa.array(np.diff(bounds)), packed, listed], ["doc_id", "raw", "same", "n", "fp", "keys"])
            give_back()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 3, 1 << 20):
                h, bounds = shingle_sets(part.column(3), shingle)
                raw = [h[x:y].astype("<u8").tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(raw, pa.binary())], ["component", "node", "n", "set"])
            give_back()

    text = text_or_empty(text_col)
    keys = {"doc_id": F.col(id_col).cast("long"), "raw": F.unhex(F.md5(text.cast("binary")))}
    texts = docs.select(*[c.alias(k) for k, c in keys.items()], text.alias("t"))
    rarity = _rarity(texts, shingle)
    outlines = stored(texts.mapInArrow(outline, "doc_id long, raw binary, same binary, n long, fp binary, keys array<long>"), "near-outlines")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")
    distinct = outlines.groupBy("same").agg(F.min(first).alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "near-distinct")  # numbered once, in the written table

    met = links(distinct.select(F.explode("keys").alias("key"), F.col("node").alias("id")), distinct.select(F.col("node").alias("id"), "fp"), CUT, WORDS, cap)
    cluster = stored(components(met), "near-clusters")
    named = distinct.join(cluster, "node").select("component", "node", "n", "first.doc_id", "first.raw")
    same_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw"))
    rows = texts.join(named.withColumnsRenamed({"doc_id": "_id", "raw": "_raw"}), same_row).select("component", "node", "n", "t")
    members = stored(rows.mapInArrow(sets_of, "component long, node long, n long, set binary"), "near-members")

    group = F.coalesce("component", "node")
    grouped = stored(distinct.select("node", "same", "first", "rows").join(components(_exact_links(members, percent)), "node", "left").withColumn("component", group), "near-groups")
    wins = grouped.groupBy("component").agg(F.min("first").alias("win"), F.count("*").alias("n"))
    of_set = join_spread(grouped.drop("first", "node"), wins.drop("n"), "component", F.xxhash64("same"), wins)
    won = F.col("doc_id").eqNullSafe(F.col("win.doc_id")) & (F.col("raw") == F.col("win.raw"))
    judged = join_spread(outlines.select("doc_id", "raw", "same"), of_set.select("same", "win"), "same", F.xxhash64("doc_id", "raw"), grouped, "rows").withColumn("won", won)
    told = stored(judged.groupBy("doc_id", "raw", "won").agg(F.count("*").alias("c")).filter("not won or c > 1"), "near-decisions")
    return without(docs, keys, told.filter("not won").select("doc_id", "raw"), told.filter("won").select("doc_id", "raw"))
