from itertools import product

import numpy as np
import pytest

from tessera.operators import contest as co
from tessera.operators import converge as cv
from tessera.operators import leads as ld
from tessera.operators import studies as st

LEGS = [("a", "x", 3.0), ("a", "y", 1.0), ("a", "w", 0.0), ("b", "x", 1.0), ("b", "y", 2.0), ("b", "w", 1.5), ("flat", "x", 1.0), ("flat", "y", 1.0), ("flat", "w", 1.0)]
LEG_TYPE, WEIGHTS = "leg string, candidate string, v double", {"a": 0.5, "b": 0.3, "flat": 0.2}


@pytest.mark.parametrize("n", [5, 8, 11])
def test_signed_rank_p_equals_enumeration(n):
    for stat in (0, 3, n, n * (n + 1) // 4):
        sums = [min(s, n * (n + 1) // 2 - s) for s in (sum(k for k, on in enumerate(bits, 1) if on) for bits in product((0, 1), repeat=n))]
        below = sum(s <= stat for s in sums) / 2**n
        assert co.signed_rank_p(stat, n, n, 0.0) == pytest.approx(min(1.0, below), abs=0.02 if 4 * stat >= n * (n + 1) - 4 else 1e-12)


def test_wilcoxon_short_and_equal_series(spark):
    rows = [(m, k, v) for m, f in (("p", lambda k: k), ("q", lambda k: k), ("r", lambda k: 2.0 * k + 1)) for k in range(8) for v in [float(f(k))]] + [("s", k, 0.0) for k in range(4)]
    got = {(r.a, r.b): r for r in co.wilcoxon(spark.createDataFrame(rows, "method string, rep int, v double")).collect()}
    assert got["p", "q"].p == 1.0 and got["p", "q"].stat == 0
    assert got["p", "r"].p == pytest.approx(2 / 2**8) and got["p", "r"].p_adj == pytest.approx(1.5 * 2 / 2**8)
    assert got["p", "s"].p is None and got["p", "s"].stat is None and got["p", "s"].n_common == 4


def test_sharp_weights_give_the_composite_order(spark):
    z = co.leg_scores(spark.createDataFrame(LEGS, LEG_TYPE))
    order = [r.candidate for r in co.composite(z, WEIGHTS).orderBy("score", ascending=False).collect()]
    got = {r.candidate: r for r in co.dirichlet_sensitivity(z, WEIGHTS, 1e7, 50).collect()}
    assert got[order[0]].p_top1 == 1.0 and got[order[1]].p_top2 == 1.0 and got[order[2]].p_top2 == 0.0


def test_bootstrap_of_one_replica_has_no_spread(spark):
    points = spark.createDataFrame(LEGS, LEG_TYPE)
    rep = spark.createDataFrame([(leg, c, 0, v) for leg, c, v in LEGS if leg == "b"], "leg string, candidate string, rep int, v double")
    got = {r.candidate: r for r in co.paired_bootstrap(points, rep, WEIGHTS, 20).collect()}
    score = {r.candidate: r.score for r in co.composite(co.leg_scores(points), WEIGHTS).collect()}
    assert all(r.se_diff == pytest.approx(0, abs=1e-12) and r.ci_lo == pytest.approx(score[c]) for c, r in got.items())
    assert got["x"].p_beats == 1.0


def test_margin_and_cluster_count(spark):
    s = spark.createDataFrame([("x", 1.0, 0.5), ("y", 0.9, 0.1), ("w", 0.0, 0.1)], "candidate string, score double, se double")
    assert co.margin_rule(s, ["y", "x"]).first().asDict() == pytest.approx({"winner": "y", "runner_up": "x", "margin": 0.1, "se": 0.5, "verdict": "tie_tiebreak"})
    assert co.margin_rule(s, ["y", "x"], 0.1).first().verdict == "win"
    t = spark.createDataFrame([(2, 0.7, 0.1), (3, 0.8, 0.9), (4, 0.8, 0.2)], "k int, ari_med double, sdbw double")
    assert tuple(co.cluster_count(t).first()) == (3, True) and tuple(co.cluster_count(t, 0.75).first()) == (4, False)


def test_planted_lead_is_found(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=30)
    rows = [(e, t, float(x[t])) for e, x in ((5, base[4:28]), (2, base[2:26]), (9, rng.normal(size=24)), (7, np.ones(24))) for t in range(24)]
    scan = ld.lag_scan(spark.createDataFrame(rows, "entity long, month_idx int, e double"), "e")
    got = {(r.i, r.j): r for r in scan.collect()}
    # 5 shows two months earlier what 2 shows: j leads i
    assert got[2, 5].lag == 2 and got[2, 5].r == pytest.approx(1.0)
    assert not any(7 in k for k in got)
    edge = ld.oriented(scan.filter("r > 0.99"))
    assert [(r.leader, r.follower, r.lag) for r in edge.collect()] == [(5, 2, 2)]
    assert ld.breadth(edge, [scan, scan]).first().breadth == 2


def test_log_t_of_narrowing_and_widening_series(spark):
    h = [("near", t, float(np.exp(-0.3 * t))) for t in range(24)] + [("far", t, float(np.exp(0.3 * t) + 0.01 * (t % 3))) for t in range(24)] + [("short", 0, 1.0)]
    got = {r.g: r for r in cv.log_t(spark.createDataFrame(h, "g string, month_idx int, h double"), "g").collect()}
    assert got["near"].converges and not got["far"].converges and got["short"].converges is None


def test_switches_match_once(spark):
    true, found = [0, 0, 1, 1, 1, 0, 0, 0], [0, 1, 1, 1, 2, 2, 2, 0]
    rows = [(e, t, a, b) for e in (1, 2) for t, (a, b) in enumerate(zip(true, found if e == 1 else [0] * 8, strict=True))]
    r = st.switch_f1(spark.createDataFrame(rows, "entity long, month_idx int, a int, b int"), "a", "b").first()
    assert (r.hits, r.n_true, r.n_found) == (2, 4, 3) and r.f1 == pytest.approx(4 / 7)
    assert st.switch_f1(spark.createDataFrame([(1, 0, 1, 1), (1, 1, 1, 2)], "entity long, month_idx int, a int, b int"), "a", "b").first().f1 is None


def test_quantiles(spark):
    v = np.random.default_rng(1).integers(0, 20, 57) / 4
    grid = [0.0, 0.1, 0.37, 0.5, 1.0]
    got = st.quantiles(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", grid).orderBy("k").collect()
    assert [r.q for r in got] == pytest.approx(np.quantile(v, grid).tolist())
