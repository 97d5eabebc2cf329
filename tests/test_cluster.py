from itertools import permutations

import numpy as np

from tessera.operators import cluster as cu
from tessera.operators import dynamics as dy
from tessera.operators import graph as gr
from tessera.operators import ranks


def test_louvain_finds_planted_groups():
    rng, n = np.random.default_rng(3), 30
    group = np.arange(n) % 3
    i, j = np.triu_indices(n, 1)
    keep = rng.random(len(i)) < np.where(group[i] == group[j], 0.9, 0.05)
    for seed in range(5):
        lab = cu.louvain(i[keep], j[keep], np.ones(keep.sum()), n, seed)
        assert len({(a, b) for a, b in zip(lab, group, strict=True)}) == len(set(lab)) == 3


def months(spark, *rows):
    cells = [(e, t, k) for t, row in enumerate(rows) for e, k in enumerate(row)]
    return dy.lineage(spark.createDataFrame(cells, "entity long, month_idx int, type_id int")).orderBy("type_id").collect()


def test_lineage(spark):
    same = [0] * 5 + [1] * 4
    assert [(r.birth_month, r.death_month, r.lifetime) for r in months(spark, same, [1 - k for k in same])] == [(0, None, 2), (0, None, 2)]
    parted = months(spark, [0] * 24 + [1] * 12, [0] * 15 + [2] * 9 + [1] * 12)
    assert [(r.birth_month, r.parent_id) for r in parted] == [(0, None), (0, None), (1, 0)]
    joined = months(spark, [0] * 16 + [1] * 8 + [2] * 14, [0] * 24 + [1] * 14)
    assert [(r.merged_into, r.death_month) for r in joined] == [(None, None), (0, 0), (None, None)]


def test_running_counts_over_parts(spark):
    values = np.random.default_rng(4).integers(0, 40, 300).tolist()
    got = ranks.cumulative(spark.createDataFrame([(float(x),) for x in values], "x double"), "x").collect()
    assert {(r.v, r.c, r.up, r.n) for r in got} == {(float(v), values.count(v), sum(x <= v for x in values), 300) for v in set(values)}


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 6), (5, 3), (1, 1)):
        c = rng.random((n, m))
        got = sum(c[a, b] for a, b in cu.assignment(c))
        t = c if n <= m else c.T
        assert np.isclose(got, min(sum(t[k, p[k]] for k in range(len(t))) for p in permutations(range(t.shape[1]), len(t))))


def test_louvain_on_correlations_not_stored(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 12)) + 0.8 * rng.normal(size=(4, 12))[np.arange(40) % 4]
    x[5] = 1.0  # constant: no edge
    series = spark.createDataFrame([(e, t, float(v)) for e, row in enumerate(x) for t, v in enumerate(row)], "entity long, month_idx int, v double")
    rows = lambda df: {(r.seed, r.entity): r.label for r in df.collect()}
    want = rows(cu.by_seed(gr.correlations(series, "v", 0.2).withColumnRenamed("r", "w"), 6))
    monkeypatch.setattr(gr, "in_blocks", None)  # no table of edges
    assert rows(cu.by_seed_correlated(series, "v", 0.2, 6)) == want and len(want) == 6 * 39
