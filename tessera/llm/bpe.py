"""BPE encoding and decoding through a distinct-word table.

1. Spark splits texts into words: leading white space and what follows it. Encoding the words
   one by one and joining the ids gives the ids of the whole text, as no pre-token of a
   byte-level tokenizer runs from a word into the white space behind it. The white-space class
   is listed character by character, so no engine's Unicode tables decide.
2. The texts of a task are packed into chunks of about ``chunk_words`` words. A chunk holds
   each of its distinct words once, and every text as positions in that list: a word that
   fills a third of the corpus is one entry per chunk, not one per occurrence.
3. The distinct words are dealt by hash into buckets of the corpus-wide distinct-word table;
   a bucket's task encodes each of its words once and sends the ids back to the chunks, which
   put them in by position. Words and ids travel as compressed blocks, a block per chunk and
   bucket. Texts and words share one exchange: both of its readers reuse it. Buckets have numbers
   that Spark's hash deals out one to each partition.
4. Decoding joins ids to the tokenizer's id-to-piece table by position. Its size is that of the
   vocabulary, whatever the corpus, so it is a map-side join: each task takes the pieces of its ids
   from the whole table. ``round_trip`` decodes where the ids are put together, in the same Python
   worker: two workers a core would hold a chunk each.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._util import give_back, slices, text_or_empty

#: Words that an encoding task keeps before it starts afresh: bounded memory.
_KEPT = 2_000_000
#: Unicode White_Space, fixed values.
SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A cut before each ASCII space is a word boundary unless white space stands beside it.
_DOUBTFUL = f"\\x00|^[{SPACE}][{SPACE}]|[{SPACE}]$"


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(path: str) -> pa.BinaryArray:
    """The id-to-piece table of a byte-level tokenizer: bytes of each id, or none."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return pa.array(out, pa.binary())


@lru_cache(maxsize=1)
def _held_pieces(path: str) -> pa.BinaryArray:
    """``pieces``, kept by a worker: as long as the vocabulary."""
    return pieces(path)


_DECODED = pa.schema({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.string()})


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of unsigned 32-bit numbers, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _pack_bytes(x: pa.Array) -> bytes:
    """A binary array (offset 0, no nulls): lengths, then data."""
    at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    lengths, data = _pack(np.diff(at)), zstandard.compress(bytes(memoryview(x.buffers()[2] or b"")[at[0] : at[-1]]), 3)
    return len(lengths).to_bytes(4, "little") + lengths + data


def _unpack_bytes(data: pa.Buffer | bytes) -> pa.Array:
    data = memoryview(data)
    n = int.from_bytes(data[:4], "little")
    lengths = _unpack(data[4 : 4 + n])
    return _binary(np.concatenate([[0], np.cumsum(lengths)]), pa.py_buffer(zstandard.decompress(data[4 + n :])))


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])


def _runs(x: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and data of a binary or string array that begins at offset 0."""
    if not len(x):
        return np.zeros(1, np.int32), pa.py_buffer(b"")
    return np.frombuffer(x.buffers()[1], np.int32)[: len(x) + 1], x.buffers()[2] or pa.py_buffer(b"")


def _cut(b: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of a batch and the number of words in each text."""
    ends = b.column(1).offsets.to_numpy()
    words, counts = b.column(1).values.slice(ends[0], ends[-1] - ends[0]), np.diff(ends)
    coded = words.dictionary_encode()
    doubtful = pc.match_substring_regex(coded.dictionary, _DOUBTFUL).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(doubtful[coded.indices.to_numpy(zero_copy_only=False)])
    if not len(at):
        return coded, counts
    out, here, last = [], ends - ends[0], 0
    for r in np.unique(np.searchsorted(here, at, side="right") - 1):
        again = WORD.findall("".join(words.slice(here[r], counts[r]).to_pylist()))
        out += [words.slice(last, here[r] - last), pa.array(again, pa.string())]
        last, counts[r] = here[r + 1], len(again)
    return pa.concat_arrays([*out, words.slice(last)]).dictionary_encode(), counts


#: Texts of a chunk go to ``part`` = its number, its words of a bucket to the bucket's (negative) part.
PARTS = "part long, chunk long, ids array<long>, counts array<long>, packed binary, bucket_of binary, words binary"
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def bucket_parts(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket a negative number that hash partitioning sends to the partition of that
    number, so no two buckets meet in a task while others idle."""
    tried = spark.range(1, 64 * buckets, 1, 1).select((-F.col("id")).alias("part"))
    found = dict(tried.groupBy(F.pmod(F.hash("part"), F.lit(buckets)).alias("k")).agg(F.max("part")).collect())
    return [found.get(k, -64 * buckets - k) for k in range(buckets)]


def _parts(number: int, held: list[tuple], parts: list[int]) -> Iterator[pa.RecordBatch]:
    ids, words, counts = zip(*held, strict=True)
    coded = pa.chunked_array(words).unify_dictionaries()
    at = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
    distinct = coded.chunk(0).dictionary.cast(pa.binary())
    often = np.argsort(-np.bincount(at, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(often), np.int64)
    rank[often] = np.arange(len(often))
    distinct = distinct.take(pa.array(often))
    bucket = np.fromiter(map(zlib.crc32, distinct.to_pylist()), np.int64, len(distinct)) % len(parts)
    order = np.argsort(bucket, kind="stable")
    in_buckets, bounds = distinct.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(len(parts) + 1))

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, _KINDS, strict=True)], ["part", "chunk", "ids", "counts", "packed", "bucket_of", "words"])

    yield row(number, number, pa.concat_arrays(ids).to_pylist(), np.concatenate(counts).astype(np.int64), _pack(rank[at]), _pack(bucket), None)
    for k, part in enumerate(parts):
        if bounds[k + 1] > bounds[k]:
            block = _pack_bytes(in_buckets.slice(bounds[k], bounds[k + 1] - bounds[k]))
            yield row(part, number, None, None, None, None, block)


def _chunked(limit: int, parts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                ends = whole.column(1).offsets.to_numpy()
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit - size, side="right")) - 1)
                b = whole.slice(at, stop - at)
                words, counts = _cut(b)
                held.append((pa.concat_arrays([b.column(0)]), words, counts))
                size, at = size + len(words), stop
                if size >= limit or at < whole.num_rows:
                    yield from _parts(number, held, parts)
                    number, held, size = number + 1, [], 0
            whole = b = None
            give_back()
        if held:
            yield from _parts(number, held, parts)

    return run


def _pack_codes(codes: list[bytes]) -> bytes:
    """Ids per word, then all ids."""
    return _pack_two(np.fromiter(map(len, codes), np.int64, len(codes)) // 4, np.frombuffer(b"".join(codes), "<u4"))


def _pack_two(a: np.ndarray, b: np.ndarray) -> bytes:
    x = _pack(a)
    return len(x).to_bytes(4, "little") + x + _pack(b)


def _unpack_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    return _unpack(data[4 : 4 + n]), _unpack(data[4 + n :])


def _encoder(path: str, parts: list[int]):
    bucket = {part: k for k, part in enumerate(parts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, table, now = tokenizer(path), {}, None
        for b in batches:
            for part, chunk, block in zip(b.column("part").to_pylist(), b.column("chunk").to_pylist(), b.column("words"), strict=True):
                if part >= 0:
                    continue
                if part != now or len(table) > _KEPT:
                    table, now = {}, part
                words = _unpack_bytes(block.as_buffer()).cast(pa.string()).to_pylist()
                new = [w for w in words if w not in table]
                for w, e in zip(new, t.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    table[w] = np.array(e.ids, "<u4").tobytes()
                codes = _pack_codes([table[w] for w in words])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket[part]], pa.int32()), pa.array([codes], pa.binary())], ["chunk", "bucket", "codes"])
        t = table = None
        give_back()

    return run


def _rebuild(codes: pa.Table, chunk: pa.Table) -> pa.Table:
    if not chunk.num_rows or chunk["part"][0].as_py() < 0:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
    blocks = dict(zip(codes["bucket"].to_pylist(), codes["codes"].to_pylist(), strict=True))
    sizes, values = zip(*[_unpack_codes(blocks[k]) for k in sorted(blocks)], strict=True) if blocks else ([np.zeros(0, int)], [np.zeros(0, "<u4")])
    table = _binary(np.concatenate([[0], 4 * np.cumsum(np.concatenate(sizes).astype(np.int64))]), pa.py_buffer(np.concatenate(values)))
    order = np.argsort(_unpack(chunk["bucket_of"][0].as_py()), kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    counts = chunk["counts"][0].values.to_numpy()
    got = table.take(pa.array(where[_unpack(chunk["packed"][0].as_py())]))
    ends, data = _runs(got)
    ends = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return pa.Table.from_arrays([chunk["ids"][0].values, pa.array(np.diff(ends).astype(np.int64) // 4), _binary(ends, data)], ["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 1_500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit, as
    binary).

    Ids are those of the byte-level tokenizer file at ``path`` with add_special_tokens off; a
    special token written out in a text becomes its id. ``path`` must be readable on every
    executor. A null text counts as empty and gives no ids. Repeated rows and null ids each
    keep their row. A text is never cut: a chunk holds at least one. Texts and words of a chunk
    come from one exchange, in which a task that runs again makes the same chunks if ``docs`` is a
    scan of files or of a checkpoint. An empty table gives an
    empty result; other columns are not read.
    """
    return _encoded(docs, path, id_col, text_col, chunk_words, _rebuild, "doc_id long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 1_500_000) -> DataFrame:
    """The rows of ``decode(encode(docs, path), path)``."""

    def run(codes: pa.Table, chunk: pa.Table) -> pa.Table:
        out, table = [], _held_pieces(path)
        for b in _rebuild(codes, chunk).combine_chunks().to_batches():
            for part in slices(b, 2, 16 << 20, 1000):
                out.append(pa.RecordBatch.from_arrays([*part.columns, decode_array(part.column(2), table)], ["doc_id", "n_tokens", "ids", "decoded"]))
        give_back()
        return pa.Table.from_batches(out, _DECODED)

    return _encoded(docs, path, id_col, text_col, chunk_words, run, "doc_id long, n_tokens long, ids binary, decoded string")


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, chunk_words: int, rebuild: Callable, schema: str) -> DataFrame:
    text, spark = text_or_empty(text_col), docs.sparkSession
    numbers = bucket_parts(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = F.when(F.contains(text, F.lit("\x00")), F.array(text)).otherwise(F.split(F.replace(text, F.lit(" "), F.lit("\x00 ")), "\x00"))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    parts = split.mapInArrow(_chunked(chunk_words, numbers), PARTS).repartition("part")
    coded = parts.sortWithinPartitions("part").mapInArrow(_encoder(path, numbers), "chunk long, bucket int, codes binary")
    return coded.groupBy("chunk").cogroup(parts.groupBy("part")).applyInArrow(rebuild, schema)


def decode_array(codes: pa.Array, table: pa.BinaryArray) -> pa.Array:
    """Texts of an array of packed ids; bytes that are no UTF-8 become U+FFFD."""
    codes = pa.concat_arrays([codes.slice(0, 0), codes]) if codes.offset else codes
    ends, data = _runs(codes)
    at, text = _runs(table.take(pa.array(np.frombuffer(data, "<u4")[ends[0] // 4 : ends[-1] // 4])))
    raw = _binary(at[(ends - ends[0]) // 4], text)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the text of its ids as ``decoded``; null ids
    count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for b in batches:
            for part in slices(b, 2, 16 << 20, 1000):
                codes = pa.concat_arrays([pc.fill_null(part.column(2), b"")])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes, decode_array(codes, table)], ["doc_id", "n_tokens", "ids", "decoded"])
        table = None
        give_back()

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
