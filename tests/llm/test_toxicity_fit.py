"""The toxicity model is fitted on every usable row and whole text."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity

WORDS = [chr(97 + a) * 3 + chr(97 + b) for a in range(20) for b in range(20)]


def drawn(rng, n):
    return " ".join(rng.choice(WORDS, n))


def test_toxicity_is_fitted_on_all_rows_and_long_texts(spark):
    rng = np.random.default_rng(4)
    toxic = [drawn(rng, 14_000) + " vileword" for _ in range(40)]  # over 50,000 characters
    plain = [drawn(rng, 40) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(toxic + plain)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 440)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert "vileword" in model.evidence and model.bias > -40


def test_counts_of_numbered_features():
    rng = np.random.default_rng(5)
    texts = [drawn(rng, int(n)) + " Abcdefg,abcdexx" for n in rng.integers(0, 50, 40)] + ["", "  "]
    number = {f: k for k, f in enumerate(["abcdefg", "^abcd", "^abcde", "aaaa", "none", WORDS[33]])}
    want = Counter(toxicity.document_counts(texts))
    assert toxicity.numbered_counts(pa.array(texts), number).tolist() == [want[f] for f in number]


def test_slopes_of_the_risk():
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=(50, toxicity.WIDTH - 1)), np.arange(50) % 3 == 0])
    w, c, model, step = rng.normal(size=toxicity.WIDTH) / 20, 0.3, toxicity.ToxicityModel(), 1e-5

    def loss(w):
        r = toxicity.risks(x, w, c, model)
        return c * r[0] + r[1] - c * r[2]

    r = toxicity.risks(x, w, c, model)
    slope = c * r[3 : 3 + toxicity.WIDTH] + r[3 + toxicity.WIDTH : 3 + 2 * toxicity.WIDTH]
    for k in (0, 7, toxicity.WIDTH - 1):
        e = np.eye(toxicity.WIDTH)[k] * step
        assert (loss(w + e) - loss(w - e)) / (2 * step) == pytest.approx(slope[k], rel=1e-4, abs=1e-4)
