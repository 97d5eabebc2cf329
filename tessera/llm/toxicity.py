"""Toxicity by non-negative positive-unlabelled learning.

The classifier is learnt from confirmed toxic documents (P) and documents without regard to labels
(U); no document is ever taken as a negative example. The class prior is a parameter of such
learning: given, or else estimated as the share of toxic rows among the usable labels, which is the
only use of labels other than toxic.

1. Words and word beginnings that are surely more frequent in P than in U (log ratio of document
   rates less ``CAUTION`` standard errors) are the vocabulary; the excess is a word's evidence.
2. A document is a vector of ``BUCKETS`` hashed words (the largest evidence in each bucket) and of a
   few numbers that sum them up (largest, count and density of strong ones, their sum), from its
   whole text.
3. A logistic classifier over all of these is trained on the other P and U documents with the
   non-negative risk: the least  pi R_P(+) + R_U(-) - pi R_P(-)  of which the part of the negatives,
   R_U(-) - pi R_P(-), is not below zero, pi being the class prior. If it would be, it counts for the
   share c < 1 at which it is (nearly) zero. With the logistic loss the risk is convex for any c:
   Newton steps.

Every document and every label is fitted on, with its whole text: half of each of P and U gives the
evidence, the other half trains. Counts and sums are made in the tasks; the driver gets words that
P holds often enough, and one array of fixed size from a task. Scoring is one pass over whole texts,
without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._util import give_back, slices, stored
from tessera.llm.labelled import block, by_text, labels_of, newton, scored, sigmoid, summed, words_of

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
CAUTION = 2.0
#: Evidence above which a word counts as strong.
STRONG = 0.7
LEAST_DOCS = 4
BUCKETS, SUMMARIES = 256, 6


def features(word: str) -> list[str]:
    """Of a white-space word: its runs of letters, lower-cased, and their beginnings."""
    out = []
    for w in LETTERS.findall(word.lower()):
        out.append(w)
        out += ["^" + w[:k] for k in PREFIXES if len(w) > k]
    return out


def _zeros() -> np.ndarray:
    return np.zeros(SUMMARIES + BUCKETS)


@dataclass
class ToxicityModel:
    evidence: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=_zeros)
    scale: np.ndarray = field(default_factory=lambda: _zeros() + 1)
    weights: np.ndarray = field(default_factory=_zeros)
    bias: float = -40.0

    def vectors(self, text: pa.Array) -> np.ndarray:
        """(texts, SUMMARIES + BUCKETS); an empty text is all zeros."""
        words, at, bounds = words_of(text)
        per_word, bucket = np.zeros(len(words)), np.zeros(len(words), np.int64)
        for k, w in enumerate(words.to_pylist()):
            best, name = max(((self.evidence.get(f, 0.0), f) for f in features(w)), default=(0.0, ""))
            if best > 0:
                per_word[k], bucket[k] = best, zlib.crc32(name.encode()) % BUCKETS
        e = per_word[at]
        strong = (e > STRONG).astype(float)
        n, count = np.diff(bounds), by_text(strong, bounds, np.add)
        top = by_text(e, bounds, np.maximum)
        total = by_text(e * strong, bounds, np.add)
        hashed, found = np.zeros((len(n), BUCKETS)), np.flatnonzero(e)
        np.maximum.at(hashed, (np.searchsorted(bounds, found, side="right") - 1, bucket[at[found]]), e[found])
        pooled = [top, np.minimum(count, 1), np.log1p(count), np.log1p(total), np.sqrt(count / np.maximum(n, 1)), np.log1p(n)]
        return np.hstack([np.stack(pooled, axis=1), hashed])

    def score(self, text: pa.Array) -> np.ndarray:
        return sigmoid((self.vectors(text) - self.mean) / self.scale @ self.weights + self.bias)


def document_counts(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        out.update({f for w in set(t.split()) for f in features(w)})
    return out


def numbered_counts(text: pa.Array, number: dict[str, int]) -> np.ndarray:
    """Texts with each of the numbered features."""
    words, at, bounds = words_of(text)
    held = [[number[f] for f in features(w) if f in number] for w in words.to_pylist()]
    size = np.array([len(x) for x in held], np.int64)
    flat, start = np.array([n for x in held for n in x], np.int64), np.cumsum(size) - size
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    doc, word = np.divmod(np.unique(of * max(len(words), 1) + at), max(len(words), 1))
    many = size[word]
    place = np.repeat(start[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    pair = np.unique(np.repeat(doc, many) * max(len(number), 1) + flat[place])
    return np.bincount(pair % max(len(number), 1), minlength=len(number))


def evidence(p: dict[str, int], positive: int, u: dict[str, int], unlabelled: int) -> dict[str, float]:
    """From documents with each feature and documents in all."""
    out = {}
    for f, n in p.items():
        ratio = np.log((n + 0.5) / (positive + 1)) - np.log((u.get(f, 0) + 0.5) / (unlabelled + 1))
        sure = ratio - CAUTION * np.sqrt(1 / (n + 0.5) + 1 / (u.get(f, 0) + 0.5))
        if sure > 0.1:
            out[f] = float(sure)
    return out


RIDGE = np.append(np.repeat([1e-4, 0.03], [SUMMARIES, BUCKETS]), 0.0)
WIDTH = SUMMARIES + BUCKETS + 1
#: The part of the negatives at which its share is not sought further.
NEARLY = 0.005


def moments(x: np.ndarray) -> np.ndarray:
    """Rows, rows of P, sums and sums of squares. The last column of a block is 1 for P, 0 for U."""
    return np.concatenate([[len(x), x[:, -1].sum()], x[:, :-1].sum(axis=0), (x[:, :-1] ** 2).sum(axis=0)])


def risks(x: np.ndarray, w: np.ndarray, c: float, model: ToxicityModel) -> np.ndarray:
    """Of a block: loss of U as negatives, of P as positives and as negatives; slope and curvature over
    U, and over P with the part of the negatives for ``c``."""
    z = np.hstack([(x[:, :-1] - model.mean) / model.scale, np.ones((len(x), 1))])
    p, u = z[x[:, -1] == 1], z[x[:, -1] == 0]
    gp, gu = p @ w, u @ w
    sp, su = sigmoid(gp), sigmoid(gu)
    slopes = [u.T @ su, p.T @ ((1 - c) * sp - 1)]
    curves = [((v * (s * (1 - s))[:, None]).T @ v)[np.triu_indices(WIDTH)] for v, s in ((u, su), (p, sp))]
    return np.concatenate([[np.logaddexp(0, gu).sum(), np.logaddexp(0, -gp).sum(), np.logaddexp(0, gp).sum()], *slopes, *curves])


def non_negative(total: Callable[[Callable], np.ndarray | None], model: ToxicityModel, positive: float, unlabelled: float, prior: float) -> np.ndarray:
    w, least = np.zeros(WIDTH), 0.0

    def at(w: np.ndarray) -> tuple:
        nonlocal least
        r = total(lambda x: risks(x, w, c, model))
        least = r[0] / unlabelled - prior * r[2] / positive
        cu, cp = np.split(r[3 + 2 * WIDTH :], 2)
        curve = np.zeros((WIDTH, WIDTH))
        curve[np.triu_indices(WIDTH)] = c * cu / unlabelled + prior * (1 - c) * cp / positive
        curve = curve + np.triu(curve, 1).T + np.diag(RIDGE + 1e-9)
        slope = c * r[3 : 3 + WIDTH] / unlabelled + prior * r[3 + WIDTH : 3 + 2 * WIDTH] / positive + RIDGE * w
        return prior * r[1] / positive + c * least + (RIDGE * w) @ w / 2, slope, curve

    c, low, high = 1.0, 0.0, 1.0
    w = newton(at, w)
    if least >= 0:
        return w
    kept, c = np.zeros(WIDTH), 0.1
    for _ in range(12):
        w = newton(at, w)
        if least >= 0:
            kept, low = w, c
            if least < NEARLY:
                break
        else:
            high = c
        c = np.sqrt(low * high) if low else high / 2
    return kept


def train(model: ToxicityModel, total: Callable[[Callable], np.ndarray | None], prior: float) -> ToxicityModel:
    """Scales and weights of ``model``; ``total`` sums a function over all blocks."""
    got = total(moments)
    if got is None or not 0 < got[1] < got[0]:
        return ToxicityModel()
    n, k = got[0], WIDTH - 1
    mean = got[2 : 2 + k] / n
    model.mean, model.scale = np.round(mean, 9), np.round(np.maximum(np.sqrt(np.maximum(got[2 + k :] / n - mean**2, 0)), 0.05), 9)
    w = np.round(non_negative(total, model, got[1], n - got[1], prior), 6)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def fit_texts(positive: list[str], unlabelled: list[str], prior: float) -> ToxicityModel:
    """``fit`` of texts at hand. Every other document of each list gives the evidence, the rest trains
    the classifier."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return ToxicityModel()
    p = {f: n for f, n in document_counts(positive[::2]).items() if n >= LEAST_DOCS}
    model = ToxicityModel(evidence=evidence(p, len(positive[::2]), document_counts(unlabelled[::2]), len(unlabelled[::2])))
    rows = [np.pad(model.vectors(pa.array(t[1::2], pa.string())), ((0, 0), (0, 1)), constant_values=y) for t, y in ((positive, 1.0), (unlabelled, 0.0))]
    return train(model, lambda f: f(np.vstack(rows)), prior)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    prior: float | None = None,
) -> ToxicityModel:
    """A model from the rows for which ``usable`` (over the id) holds.

    ``prior`` is the share of toxic documents; if it is not given, that of toxic rows among usable
    labels. Null or conflicting labels and rows without an id are left out, null texts count as
    empty, repeated rows as several documents. Without positive labels or documents every score is
    0 (the model's bias). Other columns are not read.

    The ids of toxic documents are dealt to the two halves in turn, other rows by a hash of the text;
    these ids, eight bytes each, are broadcast.
    """
    known = labels_of(labels, label, usable, id_col)
    share, toxic = known.agg(F.avg("y"), F.sum("y")).first()
    prior = prior if prior is not None else share
    if not prior or not toxic:
        return ToxicityModel()
    turn = W.partitionBy(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, toxic // 1000)))).orderBy("doc_id")
    p = known.filter("y = 1").select("doc_id", (F.row_number().over(turn) % 2 == 1).alias("p"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.filter(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.join(F.broadcast(p), "doc_id", "left").select("text", "p", (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("u"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Counter(), 0
        for b in batches:
            held.update(document_counts(b.column(0).to_pylist()))
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), n], pa.int64())], ["f", "n"])

    often = rows.filter("p").select("text").mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("f").isNull() | (F.col("n") >= LEAST_DOCS)).toArrow()
    p_of = dict(zip(often["f"].to_pylist(), often["n"].to_pylist(), strict=True))
    positive = p_of.pop(None, 0)
    names = sorted(p_of)
    number = {f: k for k, f in enumerate(names)}

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(number), np.int64), 0
        for b in batches:
            for part in slices(b, 0):
                total += numbered_counts(part.column(0), number)
                n += part.num_rows
            give_back()
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(total[full], n))], ["f", "n"])

    again = rows.filter("u").select("text").mapInArrow(recount, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    u_of = dict(zip(again["f"].to_pylist(), again["n"].to_pylist(), strict=True))
    unlabelled = u_of.pop(-1, 0)
    if not positive or not unlabelled:
        return ToxicityModel()
    model = ToxicityModel(evidence=evidence(p_of, positive, {names[k]: n for k, n in u_of.items()}, unlabelled))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                x = model.vectors(part.column(0))
                p, u = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                x = np.vstack([np.pad(x[own], ((0, 0), (0, 1)), constant_values=y) for own, y in ((p, 1.0), (u, 0.0))])
                yield pa.RecordBatch.from_arrays([pa.array([block(x)], pa.binary())], ["x"])
            give_back()

    rest = rows.select("text", F.coalesce(~F.col("p"), F.lit(False)).alias("p"), (~F.col("u")).alias("u")).filter("p or u")
    blocks = stored(rest.mapInArrow(vectors, "x binary"), "toxicity-vectors")
    return train(model, lambda f: summed(blocks, WIDTH, f), prior)


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Score of a text, 0 to 1; a null text counts as empty."""
    return scored(text, model.score)
