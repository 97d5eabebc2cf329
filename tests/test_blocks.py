"""Pairs are folded where they are made; each fold against brute force over several blocks."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.operators import cluster as cu
from tessera.operators import graph as gr
from tessera.operators import leads as ld
from tessera.operators import measures as ms
from tessera.operators import panel as pn
from tessera.sources.adapters import SUFFIXES


@pytest.fixture
def series(spark, monkeypatch):
    monkeypatch.setattr(gr, "BLOCK", 9)
    x = np.random.default_rng(5).normal(size=(40, 12))
    x[7] = 3.0  # constant: no correlation
    rows = [(e, t, float(v)) for e, row in enumerate(x) for t, v in enumerate(row)]
    return spark.createDataFrame(rows, "entity long, month_idx int, v double")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(e, e % 3) for e in range(40)], "entity long, label int")


def cells(df):
    return {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()}


def test_block_sums_where_pairs_are_made(series, labels):
    edges = gr.correlations(series, "v").filter("r > 0.2").withColumnRenamed("r", "w")
    want, got = cells(gr.block_sums(edges, labels)), cells(gr.correlated_block_sums(series, "v", labels, 0.2))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_indices_from_block_sums(series, labels):
    edges = gr.correlations(series, "v").filter("r > 0.2").withColumnRenamed("r", "w")
    got = gr.block_indices(gr.correlated_block_sums(series, "v", labels, 0.2), labels).first().asDict()
    assert got == pytest.approx(gr.graph_indices(edges, labels).first().asDict())


def test_nearest_where_pairs_are_made(series):
    order = lambda df: sorted((r.i, r.rank, r.j) for r in df.collect())
    got = gr.nearest_correlated(series, "v", 3)
    assert order(got) == order(gr.nearest(gr.correlations(series, "v"), "r", 3))
    edges = gr.undirected(got)
    graph = gr.nearest_graph(got)
    assert graph.count() == edges.count() and graph.agg({"w": "min"}).first()[0] >= 0


def test_two_correlations_in_one_pass(series):
    odd = F.col("month_idx") % 2
    got = cells(gr.two_correlations(series, "v", {"a": odd == 1, "b": odd == 0}))
    for k, c in enumerate((odd == 1, odd == 0)):
        want = cells(gr.correlations(series.filter(c), "v"))
        assert want.keys() == got.keys()
        assert all((got[p][k] is None) == (want[p][0] is None) and got[p][k] == pytest.approx(want[p][0]) for p in want if want[p][0] is not None)


def test_breadth_where_pairs_are_made(series):
    lagged = series.withColumn("v", F.col("v") + F.col("month_idx") % 3)
    some = series.filter("entity < 30")
    want = ld.breadth(ld.oriented(ld.lag_scan(series, "v").filter("r > 0.4")), [ld.lag_scan(o, "v") for o in (lagged, some)])
    got = ld.lead_breadth(series, "v", [lagged, some], "v", 0.4)
    rows = lambda df: sorted((r.leader, r.follower, r.lag, r.breadth) for r in df.collect())
    assert rows(got) == rows(want) and {r[3] for r in rows(want)} == {0, 1, 2}


def test_category_mean_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(gr, "BLOCK", 9)
    parts = ["prod", "health"]
    x = np.random.default_rng(6).uniform(2, 9, (20, 24, 2))
    x[4, :, 0] = 5.0
    rows = [(e, t, *map(float, x[e, t])) for e in range(20) for t in range(24)]
    panel = spark.createDataFrame(rows, "entity long, month_idx int, val_prod double, val_health double")
    calls, plain = [], gr.correlations
    monkeypatch.setattr(gr, "correlations", lambda *a: calls.append(a) or plain(*a))  # no table of pairs for each part
    got = cells(ms.category_mean(panel, parts))
    assert not calls and len(got) == 190
    log = np.log(x).reshape(20, 2, 12, 2)
    g = np.diff((log - log.mean(axis=1, keepdims=True)).reshape(20, 24, 2), axis=1)
    e = g - g.mean(axis=0)
    for (i, j), (s,) in got.items():
        r = [np.corrcoef(e[i, :, k], e[j, :, k])[0, 1] if e[[i, j], :, k].std(axis=1).min() > 1e-9 else 0.0 for k in range(2)]
        assert s == pytest.approx(np.tanh(np.mean(np.arctanh(r))))


def test_silhouette_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(gr, "BLOCK", 9)
    x, label = np.random.default_rng(9).normal(size=(30, 4)), np.r_[np.arange(29) % 3, 7]  # 7: a group of one
    rows = spark.createDataFrame([(e, [float(v) for v in x[e]], int(label[e])) for e in range(30)], "vec_id long, embedding array<float>, label int")
    calls = []
    monkeypatch.setattr(ms, "block_pairs", lambda *a, **k: calls.append(a))  # no table of all pairs
    y, s = x.astype("float32").astype(float), []
    for i in range(30):
        d, others = np.sqrt(((y - y[i]) ** 2).sum(axis=1)), np.arange(30) != i
        own = others & (label == label[i])
        b = min(d[label == k].mean() for k in set(label) - {label[i]})
        s.append((b - d[own].mean()) / max(d[own].mean(), b) if own.any() else 0.0)
    assert ms.silhouette(rows, 4).first()[0] == pytest.approx(np.mean(s)) and not calls


def test_best_lag_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(gr, "BLOCK", 9)
    x = np.random.default_rng(4).normal(size=(20, 10))
    rows = spark.createDataFrame([(e, t, float(v)) for e, row in enumerate(x) for t, v in enumerate(row)], "entity long, month_idx int, resid double")
    frame = ms.lagged(rows)
    assert "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()  # no sort of all pairs and lags
    got = cells(frame)
    assert len(got) == 190
    for (i, j), (lag, r) in got.items():
        every = {k: np.corrcoef(x[i, max(0, k) : 10 + min(0, k)], x[j, max(0, -k) : 10 + min(0, -k)])[0, 1] for k in range(-3, 4)}
        best = max(every, key=lambda k: abs(every[k]))
        assert lag == best and r == pytest.approx(every[best])


def test_nearest_by_distance(spark, monkeypatch):
    monkeypatch.setattr(gr, "BLOCK", 9)
    at = np.random.default_rng(8).uniform(-60, 60, (40, 2)).round(1)
    at[30:] = at[:10]  # copies: ties go to the smaller number
    rows = spark.createDataFrame([(e, float(a), float(b)) for e, (a, b) in enumerate(at)], "entity long, lat double, lon double")
    calls = []
    monkeypatch.setattr(ms, "block_pairs", lambda *a, **k: calls.append(a))  # no table of all pairs
    got = {(r.i, r.rank): (r.j, r.km) for r in ms.nearest_by_distance(rows).collect()}
    assert not calls and len(got) == 120
    for i in range(40):
        km = ms.kilometres(at[i, 0], at[i, 1], at[:, 0], at[:, 1])
        order = [j for j in np.lexsort((np.arange(40), km)) if j != i][:3]
        assert [got[i, n + 1][0] for n in range(3)] == order


def test_correlated_or_linked(spark, series):
    links = {(3, 9): 0.5, (1, 99): 0.7, (98, 99): 0.9, (7, 12): 0.1}  # 98 and 99 have no series, 7 a constant one
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in links.items()], "i long, j long, w double")
    strong = cells(gr.correlations(series, "v").filter("r > 0.2"))
    got = cells(gr.correlated_or_linked(series, "v", 0.2, edges))
    assert got.keys() == strong.keys() | links.keys()
    assert all(r == (strong[p][0] if p in strong else None) and w == links.get(p) for p, (r, w) in got.items())


def test_monthly_weights_with_the_pairs(spark, series):
    x = np.random.default_rng(2).uniform(1, 9, (40, 3, len(SUFFIXES)))
    rows = [(e, t, *map(float, x[e, t]), float(x[e, t].sum())) for e in range(40) for t in range(3) if (e, t) != (5, 1)]
    panel = spark.createDataFrame(rows, "entity long, month_idx int, " + ", ".join(f"val_{s} double" for s in SUFFIXES) + ", val_all double")
    edges = gr.correlations(series, "v").filter("r > 0.2").select("i", "j")
    rows = lambda df: {(r.i, r.j, r.month_idx): r.w for r in df.collect()}
    want, got = rows(ms.monthly_weights(edges, panel)), rows(ms.correlated_monthly_weights(series, "v", 0.2, panel))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_blend_of_measures_made_together(spark, monkeypatch):
    monkeypatch.setattr(gr, "BLOCK", 9)
    x = np.random.default_rng(3).uniform(1, 9, (15, 24, len(SUFFIXES)))
    rows = [(e, t, *map(float, x[e, t]), float(x[e, t].sum())) for e in range(15) for t in range(24)]
    panel = spark.createDataFrame(rows, "entity long, month_idx int, " + ", ".join(f"val_{s} double" for s in SUFFIXES) + ", val_all double")
    frame = ms.blended(panel, 0.25)
    assert "BroadcastHashJoin [_v" not in frame._jdf.queryExecution().executedPlan().toString()  # values are as many as pairs
    a, b = cells(ms.aitchison(panel)), cells(gr.correlations(pn.growth(panel), "resid"))
    rank = lambda m: dict(zip(sorted(m, key=m.get), np.arange(len(m)) / (len(m) - 1), strict=True))
    ra, rb = rank(a), rank(b)
    assert cells(frame) == {p: (pytest.approx(0.25 * ra[p] + 0.75 * rb[p]),) for p in a}


def test_seeds_share_copies_of_the_edges(spark, monkeypatch):
    monkeypatch.setattr(gr, "BLOCK", 9)
    rng = np.random.default_rng(1)
    i, j = np.triu_indices(30, 1)
    keep = rng.random(len(i)) < 0.3
    i, j, w = i[keep], j[keep], rng.uniform(0.2, 1, keep.sum())
    edges = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), w.tolist(), strict=True)), "i long, j long, w double")
    runs = cu.by_seed(edges, 6)
    label = {(r.seed, r.entity): r.label for r in runs.collect()}
    assert len(label) == 6 * 30
    for s in range(6):
        assert [label[s, e] for e in range(30)] == cu.louvain(i, j, w, 30, s).tolist()
    want = {(a, b): np.mean([label[s, a] == label[s, b] for s in range(6)]) for a in range(30) for b in range(a + 1, 30)}
    pairs = cu.co_association(runs)
    got = {(r.i, r.j): r.w for r in pairs.collect()}
    assert got == pytest.approx({p: x for p, x in want.items() if x})
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # no join of entities


def test_monthly_weights_copy_a_row_eight_times_less(spark, monkeypatch):
    months, sizes, plain = 3, [], gr.in_blocks
    monkeypatch.setattr(gr, "CELLS", 4)  # a row to a strip
    monkeypatch.setattr(gr, "in_blocks", lambda *a, **k: sizes.append(k.get("size") or gr.BLOCK) or plain(*a, **k))
    panel = spark.createDataFrame([(e, t, *[float(e + t + k + 1) for k in range(len(SUFFIXES))], 9.0) for e in range(3) for t in range(months)], "entity long, month_idx int, " + ", ".join(f"val_{s} double" for s in SUFFIXES) + ", val_all double")
    series = spark.createDataFrame([(e, t, float(t * (1 - 2 * (e == 2)))) for e in range(3) for t in range(months)], "entity long, month_idx int, v double")
    assert ms.correlated_monthly_weights(series, "v", 0.2, panel).count() == months  # 0 and 1 only
    assert sizes == [8 * gr.BLOCK]
