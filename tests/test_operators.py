import math

import pytest

from tessera.operators import dynamics as dy
from tessera.operators import graph as gr
from tessera.operators import panel as pn


def labels(spark, rows):
    return spark.createDataFrame([(e, t, x) for e, xs in rows.items() for t, x in enumerate(xs)], "entity long, month_idx int, type_id int")


def triangles(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (1, 3)], "i long, j long").selectExpr("i", "j", "1.0D AS w")
    return edges, spark.createDataFrame([(n, n // 3) for n in range(6)], "entity long, label int")


def test_graph_indices_of_two_triangles(spark):
    got = gr.graph_indices(*triangles(spark)).first()
    assert got.avi == pytest.approx(6 / 7) and got.avu == pytest.approx(1) and got.anui == pytest.approx(6 / 13)
    assert got.q == pytest.approx(5 / 14) and got.mq_turbo == pytest.approx(12 / 7)


def test_graph_indices_of_bipartite_groups(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "i long, j long, w double")
    lab = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "entity long, label int")
    got = gr.graph_indices(edges, lab).first()
    assert got.avi == 0 and got.anui == 0


def test_smoothing(spark):
    got = {(r.entity, r.month_idx): r.type_id_smooth for r in dy.smoothed(labels(spark, {1: [0, 1, 0, 0], 2: [1, 1, 1, 1], 3: [2, 2, 2, 2], 4: [0, 0, 1, 1]})).collect()}
    assert [got[1, t] for t in range(4)] == [0, 0, 0, 0]
    assert [got[4, t] for t in range(4)] == [0, 0, 1, 1]


def test_bh_values(spark):
    rows = spark.createDataFrame([(0.001,), (0.01,), (0.04,), (0.5,)], "p double")
    got = [r.q for r in gr.bh(rows).orderBy("p").collect()]
    assert got == pytest.approx([0.004, 0.02, 0.04 * 4 / 3, 0.5])


def test_zscore(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    got = sorted(r.z for r in rows.select(pn.zscore("x").alias("z")).collect())
    assert got == pytest.approx([-1 / math.sqrt(2 / 3), 0, 1 / math.sqrt(2 / 3)])
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.z for r in same.select(pn.zscore("x").alias("z")).collect()] == [0, 0]


@pytest.mark.parametrize(("r", "df", "p"), [(0.5771, 21, 0.0039375), (0.5, 2, 0.5), (0.9, 3, 0.0373861), (0.9, 4, 0.0145)])
def test_p_values(spark, r, df, p):
    from pyspark.sql import functions as F

    got = spark.range(1).select(gr.t_pvalue(F.lit(r), df).alias("p")).first().p
    assert got == pytest.approx(p, rel=2e-2)


def test_targets_are_null_where_unseen(spark):
    got = {r.month_idx: r.y for r in dy.targets(labels(spark, {1: [0, 0, 0, 1, 1]}), 3).collect()}
    assert got == {0: 1, 1: 1, 2: None, 3: None, 4: None}


def test_transitions_have_zero_cells(spark):
    got = {(r.month_idx, r.type_from, r.type_to): r.n_movers for r in dy.transitions(labels(spark, {1: [0, 1], 2: [0, 0]})).collect()}
    assert got == {(0, 0, 0): 1, (0, 0, 1): 1, (0, 1, 0): 0, (0, 1, 1): 0}


def test_empty_panel(spark):
    assert dy.transitions(labels(spark, {})).count() == 0
