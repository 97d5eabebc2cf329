"""Token ids in a content-addressed store.

Each document's id stream is cut into chunks where a rolling hash of the last 16 ids says so
(content-defined: an edit moves only the cuts near it). A chunk is named by the SHA-256 of its
ids and stored once however many documents hold it. A document is a recipe, the list of its
chunks' names; recipes are written in ascending doc_id order, which fixes where each
document's ids stand in the whole stream. A Merkle manifest sits on top: a document's root is
the hash of its names, a run's root (``RUN`` documents of a part) that of its documents' roots, a
part's root that of its runs' roots, the store's root that of the parts' roots.

Reading first rebuilds the whole manifest from the recipes and compares it row by row with the
stored one, and looks for every chunk that a recipe names, once and only once; then it recomputes
every chunk's name and every document's root from what the files hold. Any difference, so any
lost or changed file or row, raises ``StoreError`` (on executors: fails the job).

Files below ``path``: ``chunks`` (digest, n, ids as zstd-compressed little-endian unsigned
16-bit numbers), ``recipes`` (start, doc_id, n_tokens, root, digests, part, nth), ``manifest``
(part, run, first, documents, ids, root; run -1 is a whole part, part -1 the whole store).

Encoding goes word by word: a worker encodes each distinct word once and keeps it, as long as it holds
few enough.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._util import join_spread, slices, stored, text_or_empty

END = 2
#: Documents under one run root of the manifest.
RUN = 1 << 16
LEAST, MOST, MASK = 256, 8192, np.uint64((1 << 10) - 1)
_GEAR = np.random.default_rng(1).integers(0, 2**63, 1 << 16, dtype=np.int64).astype(np.uint64)
#: Words and bytes kept by a worker before it starts afresh.
_KEPT, _KEPT_BYTES = 1_000_000, 64 << 20
#: For each tokenizer the words met and their ids.
_kept: dict[str, tuple[pa.StringArray, pa.BinaryArray]] = {}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: ASCII punctuation that follows one of these letters begins a pre-token.
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-/:-@\[-`{-~]"


def _cut_words(text: pa.Array) -> pa.Array:
    """Lists of pieces whose ids, joined, are the text's ids.

    The tokenizer lower-cases and drops white space, so spaces are cuts and ASCII letters can
    be lowered first; ASCII punctuation after a letter begins a pre-token. Lowering or cutting
    could make or break a special token, so texts with "<|" are cut at spaces alone and keep their case.
    """
    plain = pc.replace_substring(text, "\n", " ")
    cut = pc.replace_substring_regex(pc.ascii_lower(plain), f"({_LETTER})({_MARK})", r"\1 \2")
    return pc.split_pattern(pc.if_else(pc.match_substring(plain, "<|"), plain, cut), " ")


#: Words of these letters alone are one pre-token, whose last id, and no other, ends a word.
_PLAIN = f"^{_LETTER}+$"


class StoreError(ValueError):
    """The files of a store do not agree with each other."""


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[[i for piece, i in tokenizer(path).get_vocab().items() if piece.endswith("</w>")]] = True
    return out


def _binary(ends: np.ndarray, ids: np.ndarray) -> pa.BinaryArray:
    """Ids between bounds, as packed bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))])


def _learn(words: pa.StringArray, path: str) -> pa.BinaryArray:
    """Packed ids of words; plain words are encoded many at a time, as one text."""
    t, ends = tokenizer(path), _word_ends(path)
    is_plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
    plain, alone = np.flatnonzero(is_plain), [np.flatnonzero(~is_plain)]
    order, made = [], []
    for k in range(0, len(plain), 8192):
        part = plain[k : k + 8192]
        texts = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), words.take(pa.array(part)))
        ids = np.array(t.encode_batch_fast(pc.binary_join(texts, " ").to_pylist(), add_special_tokens=False)[0].ids, "<u2")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) == len(part) and stops[-1] == len(ids):
            order.append(part)
            made.append(_binary(np.append(0, stops), ids))
        else:
            alone.append(part)
    rest = np.concatenate(alone)
    for k in range(0, len(rest), 1024):
        part = rest[k : k + 1024]
        got = [e.ids for e in t.encode_batch_fast(words.take(pa.array(part)).to_pylist(), add_special_tokens=False)]
        order.append(part)
        made.append(_binary(np.cumsum([0, *map(len, got)]), np.array([i for x in got for i in x], "<u2")))
    if not order:
        return pa.array([], pa.binary())
    order = np.concatenate(order)
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    return pa.concat_arrays(made).take(pa.array(where))


def _codes(words: pa.StringArray, path: str) -> pa.BinaryArray:
    """Packed ids of distinct words, from those kept or newly encoded."""
    held, codes = _kept.get(path) or (pa.array([], pa.string()), pa.array([], pa.binary()))
    at = pc.index_in(words, value_set=held)
    new = words.filter(at.is_null())
    if len(new):
        at = at.to_numpy(zero_copy_only=False)
        at = pa.array(np.where(np.isnan(at), len(held) + np.cumsum(np.isnan(at)) - 1, at).astype(np.int64))
        held, codes = pa.concat_arrays([held, new]), pa.concat_arrays([codes, _learn(new, path)])
    out = codes.take(at)
    if len(held) > _KEPT or held.nbytes + codes.nbytes > _KEPT_BYTES:
        _kept.pop(path, None)
    else:
        _kept[path] = held, codes
    return out


def encode_array(text: pa.Array, path: str, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids (unsigned 16-bit) of all texts in a row, and each text's bounds."""
    lists = _cut_words(text)
    ends = lists.offsets.to_numpy()
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    codes = _codes(coded.dictionary, path)
    at, ends = coded.indices.to_numpy(zero_copy_only=False), ends - ends[0]
    if end is not None:
        at = np.insert(at, ends[1:], len(codes))
        codes = pa.concat_arrays([codes, pa.array([np.array([end], "<u2").tobytes()], pa.binary())])
        ends = ends + np.arange(len(ends))
    got = codes.take(pa.array(at))
    if not len(got):
        return np.zeros(0, "<u2"), np.zeros(len(ends), np.int64)
    bounds = np.frombuffer(got.buffers()[1], np.int32)[: len(got) + 1]
    return np.frombuffer(got.buffers()[2], "<u2")[: bounds[-1] // 2], bounds[ends].astype(np.int64) // 2


def cuts(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last 16 ids allows a cut."""
    h, width = _GEAR[ids], 1
    while width < 16:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return np.flatnonzero((h >> np.uint64(20)) & MASK == 0) + 1


def chunk_bounds(start: int, stop: int, allowed: np.ndarray) -> list[int]:
    """Bounds of the chunks of one document: LEAST to MOST ids each, but for the last."""
    out = [start]
    while stop - out[-1] > LEAST:
        k = np.searchsorted(allowed, out[-1] + LEAST)
        cut = int(allowed[k]) if k < len(allowed) else stop
        cut = min(cut, out[-1] + MOST, stop)
        out.append(cut)
        if cut == stop:
            break
    if out[-1] < stop:
        out.append(stop)
    return out


def _packer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for b in slices(whole, 1, 16 << 20, 4000):
                ids, bounds = encode_array(b.column(1), path)
                allowed, names, blobs, sizes = cuts(ids), [], [], []
                for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    at_ = chunk_bounds(start, stop, allowed)
                    parts = [ids[x:y].tobytes() for x, y in zip(at_[:-1], at_[1:], strict=True)]
                    name = [hashlib.sha256(p).digest() for p in parts]
                    names.append(name)
                    sizes.append([len(p) // 2 for p in parts])
                    blobs.append([None if n in seen or seen.add(n) else pack(p) for n, p in zip(name, parts, strict=True)])
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(bounds)), pa.array(names, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64())), pa.array(blobs, pa.list_(pa.binary()))],
                    ["doc_id", "n_tokens", "digests", "sizes", "blobs"],
                )

    return run


def _root(names: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(names)).digest()


def write_store(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the store. Needs a tokenizer of at most 65,536 ids.

    Every text gets the end id, so a null or empty text is one id. Rows with equal ids stand
    side by side in the order of their roots; null ids come first. An empty table gives empty
    files and an empty manifest but for the root of nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    packed = stored(
        rows.mapInArrow(_packer(tokenizer_path), "doc_id long, n_tokens long, digests array<binary>, sizes array<long>, blobs array<binary>"), "token-pack"
    )
    chunks = packed.select(F.explode(F.arrays_zip("digests", "sizes", "blobs")).alias("c")).select(
        F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n"), F.col("c.blobs").alias("ids")
    )
    chunks.filter("ids is not null").dropDuplicates(["digest"]).write.option("compression", "none").parquet(f"{path}/chunks")

    root = F.unhex(F.sha2(F.unhex(F.concat_ws("", F.transform("digests", lambda d: F.hex(d)))), 256))
    narrow = packed.select("doc_id", "n_tokens", "digests", root.alias("root"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(narrow.repartitionByRange(parts, "doc_id", "root").withColumn("part", F.spark_partition_id()), "token-recipes")
    totals = ordered.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("documents")).orderBy("part").collect()
    before, offset = 0, {}
    for r in totals:
        offset[r.part], before = before, before + r.ids
    base = F.split(F.lit(",".join(str(offset.get(k, 0)) for k in range(max(offset, default=0) + 1))), ",").cast("array<bigint>")
    by = W.partitionBy("part").orderBy("doc_id", "root")
    up_to, nth = F.sum("n_tokens").over(by.rowsBetween(W.unboundedPreceding, -1)), F.row_number().over(by).cast("long") - 1
    placed = ordered.withColumns({"start": F.get(base, F.col("part")) + F.coalesce(up_to, F.lit(0)), "nth": nth})
    recipes = placed.select("start", "doc_id", "n_tokens", "root", "digests", "part", "nth")
    recipes.repartitionByRange(parts, "start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    manifest_of(_recipes(docs.sparkSession, path)).coalesce(1).write.parquet(f"{path}/manifest")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """(part, run, first, documents, ids, root): what the recipes' manifest must be. A run has at most
    ``RUN`` documents, so a task holds few roots at a time."""

    def level(rows: DataFrame, keys: list, order: str, documents, ids) -> DataFrame:
        roots = F.transform(F.array_sort(F.collect_list(F.struct(order, "root"))), lambda s: F.hex(s["root"]))
        return rows.groupBy(*keys).agg(
            F.min("first").alias("first"), documents.alias("documents"), ids.alias("ids"), F.unhex(F.sha2(F.unhex(F.concat_ws("", roots)), 256)).alias("root")
        )

    narrow = recipes.select("part", F.floor(F.col("nth") / RUN).cast("long").alias("run"), "nth", F.col("start").alias("first"), "n_tokens", "root")
    added = F.sum("documents"), F.sum("ids")
    runs = level(narrow, ["part", "run"], "nth", F.count("*"), F.sum("n_tokens"))
    parts = level(runs, ["part"], "run", *added).withColumn("run", F.lit(-1).cast("long"))
    whole = level(parts, [], "part", *added).withColumns({"part": F.lit(-1), "run": F.lit(-1).cast("long")})
    names = ["part", "run", "first", "documents", "ids", "root"]
    return runs.select(names).unionByName(parts.select(names)).unionByName(whole.select(names))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Raise unless the manifest is that of the recipes and each chunk they name is there once.
    Returns (digest, n, there): how often the recipes name each chunk."""
    try:
        told = spark.read.schema("part int, run long, first long, documents long, ids long, root binary").parquet(f"{path}/manifest")
        names = told.columns
        made = manifest_of(_recipes(spark, path)).select(names)
        both = told.withColumn("k", F.lit(1)).unionByName(made.withColumn("k", F.lit(-1)))
        wrong = both.groupBy(*names).agg(F.sum("k").alias("k")).filter("k <> 0").limit(3).collect()
        named = _recipes(spark, path).select(F.explode("digests").alias("digest"), F.lit(1).alias("n"), F.lit(0).alias("there"))
        there = _chunks(spark, path).select("digest", F.lit(0).alias("n"), F.lit(1).alias("there"))
        uses = stored(named.unionByName(there).groupBy("digest").agg(F.sum("n").alias("n"), F.sum("there").alias("there")), "token-uses")
        bad = uses.filter("there > 1 or there < 1").limit(3).collect()
    except AnalysisException as e:
        raise StoreError(f"a table of the store is missing: {e}") from e
    if wrong:
        raise StoreError(f"recipes and manifest differ at (part, run) {sorted({(r.part, r.run) for r in wrong})}")
    if bad:
        raise StoreError(f"chunks are missing or stand twice, as {bad[0].digest.hex()}")
    return uses


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("start long, doc_id long, n_tokens long, root binary, digests array<binary>, part int, nth long").parquet(f"{path}/recipes")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, n long, ids binary").parquet(f"{path}/chunks")


@lru_cache(maxsize=1)
def _unpacker():
    """A worker's decompressor; one for each chunk costs more than the chunk."""
    return zstandard.ZstdDecompressor()


def _checked_ids(digest: bytes, blob: bytes) -> np.ndarray:
    raw = _unpacker().decompress(blob)
    if hashlib.sha256(raw).digest() != digest:
        raise StoreError(f"chunk {digest.hex()} does not hold the ids it is named by")
    return np.frombuffer(raw, "<u2")


def _zero_operators() -> list[list[int]]:
    """CRC-32 operators for 2**k zero bytes, as the images of the 32 bits."""
    one = [0xEDB88320] + [1 << k for k in range(31)]

    def squared(m: list[int]) -> list[int]:
        return [_apply(m, x) for x in m]

    byte = squared(squared(squared(one)))
    out = [byte]
    for _ in range(47):
        out.append(squared(out[-1]))
    return out


def _apply(m: list[int], x: int) -> int:
    out, k = 0, 0
    while x:
        if x & 1:
            out ^= m[k]
        x >>= 1
        k += 1
    return out


_ZEROS = _zero_operators()


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (CRC-32, bytes) of its parts."""
    crc = 0
    for part, size in parts:
        k = 0
        while size:
            if size & 1:
                crc = _apply(_ZEROS[k], crc)
            size >>= 1
            k += 1
        crc ^= part
    return crc


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, doc_id, n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers). The manifest is checked when this is called, chunks
    against their names and documents against their roots and lengths as rows are made; chunks
    themselves are not shuffled, and chunks of many documents are dealt over several tasks."""
    uses = verify(spark, path)

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_checked_ids(d, x) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], ["digest", "crc", "n"])

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("held").offsets.to_numpy()
            pos, digest, crc, n = (x.to_numpy(zero_copy_only=False) for x in b.column("held").values.slice(at[0], at[-1] - at[0]).flatten())
            order = np.lexsort((pos, np.repeat(np.arange(b.num_rows), np.diff(at))))
            digest, sizes, crc, at = digest[order].tolist(), n[order].tolist(), crc[order].tolist(), (at - at[0]).tolist()
            roots, lengths, crcs = b.column("root").to_pylist(), b.column("n_tokens").to_pylist(), []
            for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if _root(digest[x:y]) != roots[k] or sum(sizes[x:y]) != lengths[k]:
                    raise StoreError(f"document {b.column('doc_id')[k]} at {b.column('start')[k]} is not what its recipe says")
                crcs.append(crc32_joined([(c, 4 * i) for c, i in zip(crc[x:y], sizes[x:y], strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column("start"), b.column("doc_id"), b.column("n_tokens"), pa.array(crcs, pa.int64())], ["start", "doc_id", "n_tokens", "ids_crc32"])

    sums = _chunks(spark, path).select("digest", "ids").mapInArrow(of_chunks, "digest binary, crc long, n long")
    placed = _recipes(spark, path).select("start", "doc_id", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    joined = join_spread(placed, sums, "digest", F.xxhash64("start"), uses)
    held = F.collect_list(F.struct("pos", "digest", "crc", "n")).alias("held")
    return joined.groupBy("start", "doc_id", "n_tokens", "root").agg(held).mapInArrow(of_documents, "start long, doc_id long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents' ids themselves: start, doc_id, ids (array of int), checked likewise."""
    uses = verify(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [
                np.concatenate([_checked_ids(c["digest"], c["ids"]) for c in sorted(held, key=lambda c: c["pos"])]).astype(np.int32)
                for held in b.column("held").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("start"), b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["start", "doc_id", "ids"])

    placed = _recipes(spark, path).select("start", "doc_id", F.posexplode("digests").alias("pos", "digest"))
    joined = join_spread(placed, _chunks(spark, path).drop("n"), "digest", F.xxhash64("start"), uses)
    joined = joined.groupBy("start", "doc_id").agg(F.collect_list(F.struct("pos", "digest", "ids")).alias("held"))
    return joined.mapInArrow(run, "start long, doc_id long, ids array<int>")
