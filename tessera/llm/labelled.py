"""Labelled rows, sums over vectors of all rows to fit on, and applying a numpy scorer to a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import give_back, slices

#: Tasks that a sum over blocks is made in, at most: the driver gets one array from each.
TASKS = 64


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def labels_of(labels: DataFrame, label: str, usable: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y): rows with a usable id and a 0/1 label; ids with both labels are left out."""
    rows = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    return (
        rows.groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_y"))
        .filter("y = _y")
        .drop("_y")
    )


def sample(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows by the order of a hash of doc_id: the same on every run."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)


def texts_of(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, max_chars: int) -> DataFrame:
    """The picked ids' rows with their texts. ``picked`` is a bounded sample, so it is
    broadcast; texts of more than ``max_chars`` are not fitted on."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").filter(F.length("text") <= max_chars)


def block(x: np.ndarray) -> bytes:
    """Rows of vectors as one compressed value."""
    return zstandard.compress(np.ascontiguousarray(x, np.float32).tobytes(), 1)


def summed(blocks: DataFrame, width: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``f`` over all blocks (column ``x``, ``width`` values a row); none without blocks.
    Rows stay in their tasks; the sums of tasks are added in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0):
                v = f(np.frombuffer(zstandard.decompress(x.as_buffer()), np.float32).reshape(-1, width).astype(float))
                total = v if total is None else total + v
        give_back()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    got = sorted(bytes(r.v) for r in blocks.select("x").coalesce(TASKS).mapInArrow(run, "v binary").collect())
    return sum(np.frombuffer(v) for v in got) if got else None


def newton(at: Callable[[np.ndarray], tuple], w: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The minimum of a convex function, of which ``at`` gives value, slope and curvature."""
    now, slope, curve = at(w)
    for _ in range(rounds):
        step = np.linalg.solve(curve, slope)
        if slope @ step < 1e-9:
            return w - step
        size, found = 1.0, at(w - step)
        while found[0] >= now and size > 1e-3:
            size /= 2
            found = at(w - size * step)
        w, (now, slope, curve) = w - size * step, found
    return w


def scored(text: Column, score: Callable[[pa.Array], np.ndarray]) -> Column:
    """A double per text from a function of a string array without nulls."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [score(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([b], ["t"]), 0)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            give_back()

    return run(F.coalesce(text.cast("string"), F.lit("")))


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct white-space words, the position of each word in them, and the text bounds."""
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(text)
    ends = lists.offsets.to_numpy()
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), ends - ends[0]


def by_text(values: np.ndarray, bounds: np.ndarray, how: np.ufunc, empty: float = 0.0) -> np.ndarray:
    """``how`` reduced over each text's values; ``empty`` for a text without any."""
    out = np.full(len(bounds) - 1, empty)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = how.reduceat(values, bounds[full])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
