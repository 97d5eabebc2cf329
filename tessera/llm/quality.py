"""Text quality by Bradley-Terry pairwise ranking.

A document is a vector of shape statistics of its whole text (shares of character classes,
repetition, distinct words, lengths). Preference pairs put a document labelled good above one
labelled bad; the weights minimise the logistic loss of the weighted feature differences
(Newton steps, ridge). The cut is a quantile of the scores of the fitted rows, namely the
share of bad ones among them, and the published score is the logistic of the distance to it.

Every labelled row is fitted on, with its whole text. Rows are dealt to blocks of about ``ROWS``, and
a block's pairs are all of its good rows with all of its bad ones; rows of a rare label are dealt to
as many blocks as give each some ``LEAST``. Mean, scale and cut are those of all labelled rows. Scoring
is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import give_back, slices, stored
from tessera.llm.labelled import block, by_text, labels_of, newton, scored, sigmoid, summed, words_of

#: Character classes by UTF-8 byte: fixed values.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "|", "#$%&*@^~", "<>{}[]()=+/\\_\"'-"]
_CLASS = np.full(256, len(CLASSES) + 1, np.int64)
for _k, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = len(CLASSES)
_KINDS = len(CLASSES) + 2
FEATURES = 2 * _KINDS + 13
#: Rows of a block, rows of the rarer label in it, and the weight of the ridge beside the mean loss.
ROWS, LEAST, RIDGE = 2048, 64, 1 / 40_000
#: Bins in which the cut is sought.
BINS = 4096


def shape(text: pa.Array) -> np.ndarray:
    """(texts, FEATURES); an empty text is all zeros."""
    text = pa.concat_arrays([text.slice(0, 0), text]) if text.offset else text
    n = len(text)
    ends = np.frombuffer(text.buffers()[1], np.int32)[: n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if n else np.zeros(0, np.uint8)
    size = np.diff(ends)
    counts = np.bincount(np.repeat(np.arange(n) * _KINDS, size) + _CLASS[raw], minlength=n * _KINDS).reshape(n, _KINDS)
    share = counts / np.maximum(size, 1)[:, None]

    words, at, bounds = words_of(text)
    total = np.diff(bounds)
    some = np.maximum(total, 1)
    of = np.repeat(np.arange(n), total)
    pair = np.sort(of * max(len(words), 1) + at)
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    distinct = np.bincount(pair // max(len(words), 1), minlength=n) if len(pair) else np.zeros(n)
    again = np.zeros(len(at))
    again[1:] = (at[1:] == at[:-1]) & (of[1:] == of[:-1])
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(float)[at] if len(at) else np.zeros(0)
    mean = by_text(length, bounds, np.add) / some
    repeat = by_text(again, bounds, np.add) / some
    rare = distinct / some
    lines = counts[:, 4] + 1.0
    more = [repeat, np.sqrt(repeat), rare, distinct / np.sqrt(some), np.log1p(total), mean, mean**2, by_text(length, bounds, np.maximum) ** 0.5, np.log(lines), np.log1p(total / lines), (total < 20) * 1.0, (total > 0) * 1.0, np.minimum(share[:, 1] / np.maximum(share[:, 0] + share[:, 1], 1e-9), 1)]
    return np.hstack([share, np.sqrt(share), np.stack(more, axis=1)])


@dataclass
class QualityModel:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    cut: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def score(self, text: pa.Array) -> np.ndarray:
        return sigmoid(self.raw(shape(text)) - self.cut)


def moments(x: np.ndarray) -> np.ndarray:
    """Rows, good rows, sums and sums of squares of a block's own rows. Its last columns are the label
    and whether the row is the block's own or a copy for its pairs."""
    own = x[x[:, -1] == 1]
    return np.concatenate([[len(own), own[:, -2].sum()], own[:, :-2].sum(axis=0), (own[:, :-2] ** 2).sum(axis=0)])


def preferences(x: np.ndarray, w: np.ndarray, model: QualityModel) -> np.ndarray:
    """Of all pairs of a block: their number, loss, slope and curvature."""
    z = model.scaled(x[:, :-2])
    good, bad = z[x[:, -2] == 1], z[x[:, -2] == 0]
    out = np.zeros(2 + FEATURES + FEATURES**2)
    for k in range(0, len(good), ROWS):
        g = good[k : k + ROWS]
        apart = (g @ w)[:, None] - (bad @ w)[None, :]
        p = sigmoid(-apart)
        v = p * (1 - p)
        cross = g.T @ v @ bad
        curve = (g * v.sum(axis=1)[:, None]).T @ g + (bad * v.sum(axis=0)[:, None]).T @ bad - cross - cross.T
        out += np.concatenate([[p.size, np.logaddexp(0, -apart).sum()], bad.T @ p.sum(axis=0) - g.T @ p.sum(axis=1), curve.ravel()])
    return out


def bradley_terry(total: Callable[[Callable], np.ndarray | None], model: QualityModel) -> np.ndarray:
    """Weights that rank good above bad: mean logistic loss over the pairs, and a ridge."""

    def at(w: np.ndarray) -> tuple:
        r = total(lambda x: preferences(x, w, model))
        n = max(r[0], 1)
        curve = r[2 + FEATURES :].reshape(FEATURES, FEATURES) / n + RIDGE * np.eye(FEATURES)
        return r[1] / n + RIDGE / 2 * w @ w, r[2 : 2 + FEATURES] / n + RIDGE * w, curve

    return np.round(newton(at, np.zeros(FEATURES)), 6)


def quantile_of(scores: DataFrame, q: float, bins: int = BINS) -> float:
    """The exact quantile (linear between neighbours) of a column ``s`` without nulls: bins are
    counted, and only the one or two bins that hold it are looked into, value by value."""
    n, low, high = scores.agg(F.count("s"), F.min("s"), F.max("s")).first()
    place = q * (n - 1)
    ranks = [int(np.floor(place)), int(np.ceil(place))]
    width = (high - low) / bins
    if width <= 0:
        return float(low)
    numbered = scores.withColumn("b", F.least(F.floor((F.col("s") - low) / width), F.lit(bins - 1)))
    counts = sorted(numbered.groupBy("b").agg(F.count("*").alias("c")).collect())
    ends = np.cumsum([r.c for r in counts])
    wanted = sorted({int(np.searchsorted(ends, r, side="right")) for r in ranks})
    before = int(ends[wanted[0]] - counts[wanted[0]].c)
    held = sorted(numbered.filter(F.col("b").isin([counts[k].b for k in wanted])).groupBy("s").agg(F.count("*").alias("c")).collect())
    inside = np.cumsum([r.c for r in held])
    a, b = (held[int(np.searchsorted(inside, r - before, side="right"))].s for r in ranks)
    return float(a + (place - ranks[0]) * (b - a))


def scale_of(got: np.ndarray) -> QualityModel:
    mean = got[2 : 2 + FEATURES] / got[0]
    spread = np.sqrt(np.maximum(got[2 + FEATURES :] / got[0] - mean**2, 0))
    return QualityModel(mean=np.round(mean, 9), scale=np.round(np.maximum(spread, 1e-6), 9))


def fit_rows(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """``fit`` of rows at hand, in one block. Without both labels every score is 0.5."""
    if not 0 < y.sum() < len(y):
        return QualityModel()
    rows = np.column_stack([x, y, np.ones(len(y))])
    model = scale_of(moments(rows))
    model.weights = bradley_terry(lambda f: f(rows), model)
    model.cut = float(np.quantile(model.raw(x), 1 - y.mean()))
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model from the labelled rows for which ``usable`` (over the id) holds; null or
    conflicting labels and rows without an id are left out, null texts count as empty, repeated
    rows as several documents; other columns are not read. Without both labels every score is 0.5.

    Statistics of all usable rows are made first and joined with the labels, so neither texts nor
    labels are shuffled together or broadcast."""
    known = labels_of(labels, label, usable, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                x = [v.tobytes() for v in shape(part.column(1)).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], ["doc_id", "v"])
            give_back()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.filter(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = stored(rows.mapInArrow(run, "doc_id long, v binary").join(known, "doc_id"), "quality-rows")
    of = dict(rows.groupBy("y").count().collect())
    if len(of) < 2:
        return QualityModel()
    blocks = max(1, sum(of.values()) // ROWS)
    copies = {y: min(blocks, max(1, -(-LEAST * blocks // n))) for y, n in of.items()}
    nth = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == 1, copies[1]).otherwise(copies[0]) - 1))
    dealt = rows.withColumn("nth", nth).withColumn("b", F.pmod(F.xxhash64("doc_id") + F.col("nth"), F.lit(blocks)).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = np.frombuffer(b"".join(t["v"].to_pylist()), np.float32).reshape(-1, FEATURES)
            x = np.column_stack([x, t["y"].to_numpy(), t["nth"].to_numpy() == 0])
            return pa.RecordBatch.from_arrays([pa.array([block(x)], pa.binary())], ["x"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            ends = np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if held and b > a and held[-1].column(0)[0] != batch.column(0)[int(a)]:
                    yield whole(held)
                    held = []
                if b > a:
                    held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield whole(held)

    tasks = min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = dealt.select("b", "doc_id", "v", "y", "nth").repartition(tasks, "b").sortWithinPartitions("b", "doc_id", "nth", "v")
    packed = stored(sorted_rows.mapInArrow(pack, "x binary"), "quality-blocks")
    total = lambda f: summed(packed, FEATURES + 2, f)
    got = total(moments)
    model = scale_of(got)
    model.weights = bradley_terry(total, model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model.raw(x.astype(float)), 9))], ["s"])

    model.cut = quantile_of(rows.select("v").mapInArrow(judge, "s double"), float(1 - got[1] / got[0]))
    return model


def quality(text: Column, model: QualityModel) -> Column:
    """Score of a text, 0 to 1; a null text counts as empty."""
    return scored(text, model.score)
