"""Tests of pairs whose p values are not stored, against the step-up over all of them."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.operators import graph as gr
from tessera.operators import stepup as su


@pytest.fixture
def series(spark, monkeypatch):
    for name, size in (("WIDE", 9), ("BLOCK", 9), ("CELLS", 30)):
        monkeypatch.setattr(gr, name, size)
    x = np.random.default_rng(5).normal(size=(40, 12))
    x[:9] += 1.2 * x[0]  # some pairs pass
    x[7] = 3.0  # constant: no correlation
    rows = [(e, t, float(v)) for e, row in enumerate(x) for t, v in enumerate(row)]
    return spark.createDataFrame(rows, "entity long, month_idx int, v double")


def both(series):
    pairs = gr.correlations(series, "v").withColumn("p", gr.t_pvalue(F.col("r"), 10))
    return pairs, gr.bh(pairs)


def test_audit_without_a_table_of_pairs(series, monkeypatch):
    pairs, want = both(series)
    q = {(r.i, r.j): r for r in want.collect()}
    near = {tuple(r) for r in gr.undirected(gr.nearest(pairs, "r", 3)).collect()}
    monkeypatch.setattr(gr, "bh", None)
    monkeypatch.setattr(gr, "SINGLY", 1)  # every pass of the search
    got = {(r.i, r.j): r for r in gr.tested(series, "v", 10, 0.05, 3).collect()}
    assert got.keys() == q.keys() and 0 < sum(r.bh_pass for r in got.values()) < len(got)
    for k, r in got.items():
        assert r.p == pytest.approx(q[k].p, abs=1e-12) and r.bh_pass == (q[k].q <= 0.05) and r.in_safety == (k in near)


def test_edges_without_a_table_of_pairs(series, monkeypatch):
    want = {tuple(r) for r in gr.similarity_edges(both(series)[1]).collect()}
    monkeypatch.setattr(gr, "bh", None)
    assert {tuple(r) for r in gr.tested_edges(series, "v", 10).collect()} == want


@pytest.mark.parametrize("level", [1e-4, 0.05, 0.3, 0.9])
def test_limit_equals_the_step_up(spark, series, level):
    q = [(r.p, r.q) for r in both(series)[1].collect()]
    limit = gr.bh_limit(gr.standardised(series, "v"), 10, level)
    assert {p for p, x in q if x <= level} == {p for p, _ in q if p <= limit}


@pytest.mark.parametrize("held", [50, 10**6])
def test_step_up_by_ranges(series, monkeypatch, held):
    for name, size in (("TILE", 9), ("HELD", held), ("BATCH", 40)):
        monkeypatch.setattr(su, name, size)
    want = {(r.i, r.j): r.q for r in both(series)[1].collect()}
    got = {(r.i, r.j): r.q for r in su.step_up(series, "v", 10).collect()}
    assert len(got) == 780 and got == pytest.approx(want, abs=1e-12)


def test_range_of_more_ties_than_are_held():
    z = np.tile([[1.0, -1.0, 1.0, -1.0]], (30, 1))
    u, c = su.range_values(z, 9, 0.5, np.inf, 435, 100)
    assert u.tolist() == [1.0] and c.tolist() == [435]
    assert su.least_later(np.array([0.5, 0.2]), np.array([3, 7]), 5, 15, 21) == pytest.approx(gr.p_values(np.array([0.5, 0.2]), 21) * 15 / [8, 15])
    with pytest.raises(ValueError):
        su.range_values(z, 9, 0.5, np.inf, 434, 1000)
