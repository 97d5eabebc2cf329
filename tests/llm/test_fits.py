"""Models are fitted on every labelled row and whole text; sums of tasks against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

WORDS = [chr(97 + a) * 3 + chr(97 + b) for a in range(20) for b in range(20)]


def drawn(rng, n):
    return " ".join(rng.choice(WORDS, n))


def test_quality_is_fitted_on_all_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS", 32)
    monkeypatch.setattr(quality, "LEAST", 8)
    rng = np.random.default_rng(1)
    texts = [drawn(rng, 60) if i % 10 else " ".join(["same"] * 50) for i in range(300)]
    texts[7] = drawn(rng, 60_000)  # over 200,000 characters
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(300)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    x = quality.shape(pa.array(texts))
    assert model.mean == pytest.approx(x.mean(axis=0), rel=1e-4, abs=1e-6)
    assert model.scale == pytest.approx(np.maximum(x.std(axis=0), 1e-6), rel=1e-2, abs=1e-5)
    assert model.cut == pytest.approx(np.quantile(model.raw(x), 0.1), abs=1e-3)
    assert ((model.score(pa.array(texts)) >= 0.5) == [i % 10 > 0 for i in range(300)]).mean() > 0.99
    assert np.array_equal(quality.fit(docs.repartition(3), labels, F.lit(True)).weights, model.weights)


def test_pairs_of_a_block_are_all_pairs():
    rng = np.random.default_rng(2)
    x, w, model = rng.normal(size=(30, quality.FEATURES)), rng.normal(size=quality.FEATURES) / 5, quality.QualityModel()
    y = np.arange(30) % 3 > 0
    d = (x[y][:, None] - x[~y][None]).reshape(-1, quality.FEATURES)
    p = 1 / (1 + np.exp(d @ w))
    n, loss, *rest = quality.preferences(np.column_stack([x, y, np.ones(30)]), w, model)
    assert n == 200 and loss == pytest.approx(np.log1p(np.exp(-(d @ w))).sum())
    assert rest[: quality.FEATURES] == pytest.approx(-(d.T @ p)) and rest[quality.FEATURES :] == pytest.approx(((d * (p * (1 - p))[:, None]).T @ d).ravel())


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_quantile_is_exact(spark, q):
    s = np.round(np.random.default_rng(3).normal(size=500), 1)
    table = spark.createDataFrame([(float(v),) for v in s], "s double").repartition(3)
    assert quality.quantile_of(table, q, bins=16) == pytest.approx(np.quantile(s, q))
