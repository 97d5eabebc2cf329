"""Registered queries: lead and lag, convergence, contests of candidates, positions, agreement."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import contest as co
from tessera.operators import converge as cv
from tessera.operators import dynamics as dy
from tessera.operators import graph as gr
from tessera.operators import leads as ld
from tessera.operators import measures as ms
from tessera.operators import panel as pn
from tessera.operators import studies as st
from tessera.plans.catalog import _HAV, _LW, ORACLE_SQL, R, _label
from tessera.plans.tables import query
from tessera.sources import adapters as ad
from tessera.sources import files
from tessera.sources.adapters import SUFFIXES, table

# lead and lag

_SCAN = """, lags AS (SELECT a.entity AS i, b.entity AS j, k AS lag, corr(a.resid, b.resid) AS r FROM gw a JOIN gw b ON a.entity < b.entity
  JOIN (SELECT unnest([-1, 1, -2, 2, -3, 3, -4, 4]) AS k) ON b.month_idx = a.month_idx - k GROUP BY 1, 2, 3),
sc AS (SELECT i, j, lag, r FROM lags WHERE NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY r DESC, abs(lag), lag) = 1),
ed AS (SELECT CASE WHEN lag > 0 THEN j ELSE i END AS leader, CASE WHEN lag > 0 THEN i ELSE j END AS follower, abs(lag) AS lag, r FROM sc WHERE r > 0.4)"""


def _scan(s, d) -> DataFrame:
    return ld.lag_scan(pn.growth(ad.panel_wide(s, d)), "resid")


def _leads(s, d) -> DataFrame:
    return ld.oriented(ld.lag_scan(pn.growth(ad.panel_wide(s, d)), "resid", above=0.4))


def _part_growth(s, d, part: str) -> DataFrame:
    """entity, month_idx, e: change of one part's log value."""
    log = F.log(F.greatest(F.col(f"val_{part}"), F.lit(1.0)))
    by = W.partitionBy("entity").orderBy("month_idx")
    return pn.core(ad.panel_wide(s, d)).select("entity", "month_idx", (log - F.lag(log).over(by)).alias("e")).filter("e is not null")


@query(f"{_SCAN} SELECT i, j, CAST(lag AS INT) AS lag, {R('r')} FROM sc")
def ll1_lag_scan(s, d):
    return _scan(s, d)


_PG = "pg AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{x}' AS part, entity, month_idx, ln(greatest(val_{x}, 1.0)) - lag(ln(greatest(val_{x}, 1.0))) OVER (PARTITION BY entity ORDER BY month_idx) AS e FROM co" for x in SUFFIXES[:2]) + ") WHERE e IS NOT NULL)"


@query(f"""{_SCAN}, {_PG}, pl8 AS (SELECT part, a.entity AS i, b.entity AS j, k AS lag, corr(a.e, b.e) AS r FROM pg a JOIN pg b USING (part)
  JOIN (SELECT unnest([-1, 1, -2, 2, -3, 3, -4, 4]) AS k) ON b.month_idx = a.month_idx - k WHERE a.entity < b.entity GROUP BY 1, 2, 3, 4),
pb AS (SELECT part, i, j, lag FROM pl8 WHERE NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY part, i, j ORDER BY r DESC, abs(lag), lag) = 1)
SELECT leader, follower, CAST(e.lag AS INT) AS lag, round(r, 6) AS r, count(p.part) AS breadth FROM ed e LEFT JOIN pb p ON p.i = least(leader, follower) AND p.j = greatest(leader, follower)
  AND (p.lag > 0) = (leader > follower) AND abs(abs(p.lag) - e.lag) <= 1 GROUP BY 1, 2, 3, 4""")
def ll6_lead_edges(s, d):
    return ld.lead_breadth(pn.growth(ad.panel_wide(s, d)), "resid", [_part_growth(s, d, x) for x in SUFFIXES[:2]], "e", 0.4)


@query(f"{_SCAN} SELECT entity, count(o.leader) FILTER (WHERE o.leader = entity) AS out_degree, count(o.leader) FILTER (WHERE o.follower = entity) AS in_degree FROM nd LEFT JOIN ed o ON entity IN (o.leader, o.follower) GROUP BY 1")
def ll7_degrees(s, d):
    return ld.degrees(_leads(s, d), ad.nodes(s, d))


@query(f"""{_SCAN}, lbl AS (SELECT entity, region_code % 5 AS label FROM nd), ex AS (SELECT sum(n * n) / pow(sum(n), 2) AS e FROM (SELECT count(*) AS n FROM lbl GROUP BY label)),
wi AS (SELECT avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS w FROM ed JOIN lbl a ON a.entity = leader JOIN lbl b ON b.entity = follower)
SELECT round(w, 6) AS within_share, round(e, 6) AS expected_share, round(w / greatest(e, 1e-12), 6) AS enrichment FROM wi, ex""")
def ll7_label_enrichment(s, d):
    return ld.enrichment(_leads(s, d), _label(s, d))


@query(f"{_SCAN} SELECT count(*) AS edges, round(avg(CASE WHEN {_HAV} < 1500 THEN 1.0 ELSE 0.0 END), 6) AS near_share FROM ed JOIN xy a ON a.entity = leader JOIN xy b ON b.entity = follower")
def ll7_near_share(s, d):
    return ld.near_share(_leads(s, d), ad.coords(s, d), 1500.0)


# convergence

_LOGT = """, hh AS (SELECT {g} AS grp, month_idx + 1 AS t, greatest(avg(pow(x - 1, 2)), 1e-12) AS h FROM (SELECT *, val_all / avg(val_all) OVER (PARTITION BY {g}, month_idx) AS x FROM {t}) GROUP BY 1, 2),
yy AS (SELECT grp, t, ln(t) AS x, ln(first_value(h) OVER (PARTITION BY grp ORDER BY t) / h) - 2 * ln(ln(t)) AS y FROM hh),
yw AS (SELECT * FROM yy WHERE t > 8), fit AS (SELECT grp, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM yw GROUP BY 1),
uu AS (SELECT grp, t - 8 AS k, y - a - b * x AS u FROM yw JOIN fit USING (grp)),
ac AS (SELECT p.grp, q.k - p.k AS l, sum(p.u * q.u) FILTER (WHERE q.k < 16 OR q.k = p.k) AS g, sum(p.u * q.u) AS full_g FROM uu p JOIN uu q ON p.grp = q.grp AND q.k >= p.k GROUP BY 1, 2),
hd AS (SELECT grp, max(full_g) FILTER (WHERE l = 1) / (max(full_g) FILTER (WHERE l = 0) - last_u) AS rho FROM ac JOIN (SELECT grp, max(u * u) FILTER (WHERE k = 16) AS last_u FROM uu GROUP BY 1) USING (grp) GROUP BY grp, last_u),
wd AS (SELECT grp, 1.3221 * pow(4 * rho * rho / pow(1 - rho, 4) * 16, 0.2) AS w FROM hd),
lr AS (SELECT grp, sum(CASE WHEN l = 0 THEN full_g ELSE 2 * g * 3 / pow(z, 2) * (sin(z) / z - cos(z)) END) / 15 AS lrv FROM (SELECT grp, l, g, full_g, 1.2 * pi() * l / greatest(w, 1e-8) AS z FROM ac JOIN wd USING (grp) WHERE l <= 14) GROUP BY 1),
lt AS (SELECT grp, lrv, b, sqrt(greatest(lrv, 0.0) / sxx) AS se, b / sqrt(greatest(lrv, 0.0) / sxx) AS t FROM lr JOIN fit USING (grp))"""
_LT_SIZES = "(SELECT co.*, region_name FROM co JOIN nd USING (entity))"


def _by_region(s, d) -> DataFrame:
    p = pn.core(ad.panel_wide(s, d)).join(ad.nodes(s, d).select("entity", "region_name"), "entity")
    ratio = F.col("val_all") / F.avg("val_all").over(W.partitionBy("region_name", "month_idx")) - 1
    return p.withColumn("_d", ratio * ratio).groupBy("region_name", "month_idx").agg(F.avg("_d").alias("h"))


@query(_LOGT.format(g="region_name", t=_LT_SIZES) + f" SELECT grp AS region_name, {R('lrv')} FROM lt")
def cv2_long_run_variance(s, d):
    return cv.log_t(_by_region(s, d), "region_name").select("region_name", "lrv")


@query(_LOGT.format(g="region_name", t=_LT_SIZES) + " SELECT grp AS region_name, round(b, 6) AS beta, round(se, 6) AS se, round(t, 4) AS t, t > -1.65 AS converges FROM lt")
def cv3_log_t(s, d):
    return cv.log_t(_by_region(s, d), "region_name").select("region_name", "beta", "se", F.round("t", 4).alias("t"), "converges")


@query(_LOGT.format(g="0", t="co") + """, sg AS (SELECT regr_slope(ln(h), CAST(t AS DOUBLE)) < 0 AS sigma FROM hh),
be AS (SELECT regr_slope(d, x0) < 0 AS beta FROM (SELECT min_by(log_all, month_idx) AS x0, max_by(log_all, month_idx) - min_by(log_all, month_idx) AS d FROM se GROUP BY entity)),
vt AS (SELECT t > -1.65 AS logt, sigma, beta FROM lt, sg, be)
SELECT *, CAST(logt AS INT) + CAST(sigma AS INT) + CAST(beta AS INT) AS n_votes, CASE WHEN CAST(logt AS INT) + CAST(sigma AS INT) + CAST(beta AS INT) >= 2 THEN 'convergence' ELSE 'divergence' END AS verdict FROM vt""")
def cv7_vote(s, d):
    p = pn.core(ad.panel_wide(s, d))
    h = files.reread(dy.cross_sectional_h(p, "val_all"), "dispersion")
    tests = cv.log_t(h.withColumn("g", F.lit(0)), "g").select(F.col("converges").alias("logt"))
    sigma = h.agg((F.regr_slope(F.log(F.greatest("h", F.lit(cv.FLOOR))), F.col("month_idx").cast("double")) < 0).alias("sigma"))
    beta = dy.beta(pn.seasonal(p), "log_all").select((F.col("beta") < 0).alias("beta"))
    return cv.vote(tests.crossJoin(sigma).crossJoin(beta), ["logt", "sigma", "beta"])


# contests

WEIGHTS = {"AFRICA": 0.30, "AMERICA": 0.25, "ASIA": 0.20, "EUROPE": 0.15, "MIDDLE EAST": 0.10}
_LEGS = ", lv AS (SELECT region_name AS leg, part AS candidate, avg(value) AS v FROM pl JOIN nd USING (entity) GROUP BY 1, 2), lz AS (SELECT leg, candidate, CASE WHEN stddev_pop(v) OVER (PARTITION BY leg) > 0 THEN (v - avg(v) OVER (PARTITION BY leg)) / stddev_pop(v) OVER (PARTITION BY leg) ELSE 0.0 END AS z FROM lv), lw AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items()) + ") AS t(leg, w))"


def _legs(s, d) -> DataFrame:
    return ad.panel_long(s, d).join(ad.nodes(s, d).select("entity", F.col("region_name").alias("leg")), "entity").groupBy("leg", F.col("part").alias("candidate")).agg(F.avg("value").alias("v"))


@query(f"""{_LEGS}, ss AS (SELECT candidate, sum(w * z) AS score, stddev_samp(z) / sqrt(count(*)) AS se FROM lz JOIN lw USING (leg) GROUP BY 1),
tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate) AS n FROM ss), two AS (SELECT a.candidate AS a, b.candidate AS b, a.score - b.score AS margin, a.se AS se FROM tp a, tp b WHERE a.n = 1 AND b.n = 2),
od AS (SELECT *, margin >= se AS wins, margin >= se OR list_position({SUFFIXES!r}, a) < list_position({SUFFIXES!r}, b) AS f FROM two)
SELECT CASE WHEN f THEN a ELSE b END AS winner, CASE WHEN f THEN b ELSE a END AS runner_up, {R('margin')}, {R('se')}, CASE WHEN wins THEN 'win' ELSE 'tie_tiebreak' END AS verdict FROM od""")
def bm3_margin_rule(s, d):
    z = files.reread(co.leg_scores(_legs(s, d)), "legs")
    spread = z.filter(F.col("leg").isin(list(WEIGHTS))).groupBy("candidate").agg((F.stddev_samp("z") / F.sqrt(F.count("*"))).alias("se"))
    return co.margin_rule(co.composite(z, WEIGHTS).join(spread, "candidate"), SUFFIXES)


@query(f"""{_LEGS}, fl AS (SELECT candidate AS full_c FROM lz JOIN lw USING (leg) GROUP BY 1 ORDER BY round(sum(w * z), 9) DESC, 1 LIMIT 1),
dr AS (SELECT x.leg AS dropped, candidate, round(sum(w * z) / sum(w), 9) AS score FROM (SELECT DISTINCT leg FROM lz) x, lz JOIN lw USING (leg) WHERE lz.leg <> x.leg GROUP BY 1, 2),
wn AS (SELECT dropped, candidate AS winner, candidate <> full_c AS changed FROM dr, fl QUALIFY row_number() OVER (PARTITION BY dropped ORDER BY score DESC, candidate) = 1)
SELECT *, sum(CAST(changed AS INT)) OVER () > 1 AS photo_finish FROM wn""")
def bm5_leave_one_leg_out(s, d):
    return co.leave_one_leg_out(files.reread(co.leg_scores(_legs(s, d)), "legs"), WEIGHTS)


@query()
def bm4_dirichlet(s, d):
    return co.dirichlet_sensitivity(files.reread(co.leg_scores(_legs(s, d)), "legs"), WEIGHTS)


@query()
def bm2_paired_bootstrap(s, d):
    rep = ad.panel_long(s, d).join(ad.nodes(s, d).select("entity", F.col("region_name").alias("leg")), "entity").filter("leg in ('ASIA', 'EUROPE')")
    grid = rep.select("leg", F.col("month").alias("rep")).distinct().crossJoin(F.broadcast(s.createDataFrame([(x,) for x in SUFFIXES], "candidate string")))  # months and parts
    means = rep.groupBy("leg", F.col("part").alias("candidate"), F.col("month").alias("rep")).agg(F.avg("value").alias("v"))
    return co.paired_bootstrap(_legs(s, d), grid.join(means, ["leg", "rep", "candidate"], "left").fillna(0.0, ["v"]), WEIGHTS)


_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("SELECT name, name IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') AND ok AS scoring, CASE WHEN name = '5-LOW' THEN 'anti_example' WHEN NOT ok THEN 'failed admissibility' END AS reason FROM (SELECT o_orderpriority AS name, avg(o_totalprice) >= (SELECT avg(o_totalprice) FROM orders) AS ok FROM orders GROUP BY 1)")
def bm7_admissible(s, d):
    o = table(s, d, "orders")
    whole = F.broadcast(o.agg(F.avg("o_totalprice").alias("t")))
    gate = o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("m")).crossJoin(whole)
    return co.admissible(gate.select("name", F.when(F.col("m") >= F.col("t"), "pass").otherwise("fail").alias("verdict")), _NAMES, ["5-LOW"])


_METHODS = {"nmi": "avg(c_acctbal)", "boot": "stddev_pop(c_acctbal)", "iqr": "max(c_acctbal) - min(c_acctbal)", "sw": "avg(o_totalprice)", "ch": "max(o_totalprice)", "sdbw": "min(o_totalprice)", "mq": "stddev_pop(o_totalprice)", "seconds": "CAST(count(*) AS DOUBLE)"}
METHOD_WEIGHTS = {"nmi": 0.30, "stability": 0.25, "validity": 0.20, "interpretability": 0.15, "speed": 0.10}
SUB_WEIGHTS = {"sw": 0.06, "ch": 0.05, "sdbw": 0.05, "mq": 0.04}
_z = lambda x: f"CASE WHEN stddev_pop({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () ELSE 0.0 END"


@query(f""", me AS (SELECT c_mktsegment AS method, {', '.join(f'{v} AS {k}' for k, v in _METHODS.items())} FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
lg AS (SELECT method, nmi, 0.5 * {_z('boot')} - 0.5 * {_z('iqr')} AS stability, -ln(seconds) AS speed, (0.06 * {_z('sw')} + 0.05 * {_z('ch')} - 0.05 * {_z('sdbw')} + 0.04 * {_z('mq')}) / 0.20 AS validity FROM me),
sm AS (SELECT method, 0.30 * {_z('nmi')} + 0.25 * {_z('stability')} + 0.20 * {_z('validity')} + 0.10 * {_z('speed')} AS sc FROM lg)
SELECT method, round(sc, 6) AS with_zero, round(sc / 0.85, 6) AS renormalised FROM sm""")
def bm9_method_composite(s, d):
    m = table(s, d, "customer").join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("method"))
    return co.method_scores(m.agg(*[F.expr(v).alias(k) for k, v in _METHODS.items()]), METHOD_WEIGHTS, SUB_WEIGHTS)


def _monthly_shares(s, d) -> DataFrame:
    return pn.closed(ad.panel_wide(s, d)).groupBy("month_idx").agg(*[F.avg(f"share_{x}").alias(x) for x in SUFFIXES]).unpivot(["month_idx"], SUFFIXES, "method", "v").withColumnRenamed("month_idx", "rep")


_SR = ", mm AS (SELECT month_idx AS rep, " + ", ".join(f"avg(share_{x}) AS {x}" for x in SUFFIXES) + " FROM sh GROUP BY 1), ml AS (SELECT rep, method, v FROM mm UNPIVOT (v FOR method IN (" + ", ".join(SUFFIXES) + "))), pd AS (SELECT x.method AS a, y.method AS b, round(x.v - y.v, 12) AS d FROM ml x JOIN ml y USING (rep) WHERE x.method < y.method), rr AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS r FROM pd WHERE d <> 0)"


@query(f"{_SR} SELECT a, b, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS stat, count(*) AS n FROM rr GROUP BY 1, 2")
def bm10_signed_ranks(s, d):
    return co.signed_ranks(_monthly_shares(s, d)).select("a", "b", "stat", "n")


@query()
def bm10_wilcoxon(s, d):
    return co.wilcoxon(_monthly_shares(s, d))


@query(", tb AS (SELECT l_linenumber AS k, avg(l_tax) * 22.5 AS ari, avg(l_discount) AS sd FROM lineitem GROUP BY 1) SELECT coalesce((SELECT k FROM tb WHERE ari >= 0.9 ORDER BY sd, k LIMIT 1), (SELECT k FROM tb ORDER BY ari DESC, k LIMIT 1)) AS k, NOT EXISTS (SELECT 1 FROM tb WHERE ari >= 0.9) AS veto_failed")
def cl12_cluster_count(s, d):
    return co.cluster_count(table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg((F.avg("l_tax") * 22.5).alias("ari_med"), F.avg("l_discount").alias("sdbw")))


# positions, metrics, agreement

_CLM = ", cm AS (SELECT entity, month_idx, type_id, part, x FROM (SELECT entity, month_idx, type_id, " + ", ".join(f"clr_{x}" for x in SUFFIXES) + " FROM cl JOIN lb USING (entity, month_idx)) UNPIVOT (x FOR part IN (" + ", ".join(f"clr_{x}" for x in SUFFIXES) + ")))"


@query(f"""{_CLM}, loo AS (SELECT a.entity, a.month_idx, a.type_id, a.part, a.x, coalesce(median(b.x), a.x) AS m FROM cm a LEFT JOIN cm b ON a.month_idx = b.month_idx AND a.type_id = b.type_id AND a.part = b.part AND a.entity <> b.entity GROUP BY 1, 2, 3, 4, 5),
own AS (SELECT entity, month_idx, type_id, round(sqrt(sum(pow(x - m, 2))), 9) AS dist_own FROM loo GROUP BY 1, 2, 3),
ce AS (SELECT month_idx, type_id, part, median(x) AS c FROM cm GROUP BY 1, 2, 3),
ot AS (SELECT entity, month_idx, min(dd) AS other FROM (SELECT a.entity, a.month_idx, ce.type_id, sqrt(sum(pow(x - c, 2))) AS dd FROM cm a JOIN ce ON ce.month_idx = a.month_idx AND ce.part = a.part AND ce.type_id <> a.type_id GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT entity, month_idx, round(dist_own, 6) AS dist_own, round(dist_own - other, 6) AS margin, round((rank() OVER w + (count(*) OVER (PARTITION BY month_idx, type_id, dist_own) - 1) / 2 - 1) / greatest(count(*) OVER (PARTITION BY month_idx, type_id) - 1, 1), 6) AS rank_own FROM own LEFT JOIN ot USING (entity, month_idx) WINDOW w AS (PARTITION BY month_idx, type_id ORDER BY dist_own)""")
def dr3_position(s, d):
    rows = pn.clr(pn.closed(ad.panel_wide(s, d))).select("entity", "month_idx", *[f"clr_{x}" for x in SUFFIXES])
    return st.position(rows.join(ad.labels_monthly(s, d).select("entity", "month_idx", "type_id"), ["entity", "month_idx"]), [f"clr_{x}" for x in SUFFIXES])


_YP = f", yp AS (SELECT entity, month_idx, CAST(lead(type_id) {_LW} <> type_id AS INT) AS y, round(1 - seed_agreement, 9) AS p FROM lb), ym AS (SELECT * FROM yp WHERE y IS NOT NULL)"


def _scored(s, d) -> DataFrame:
    lab = ad.labels_monthly(s, d)
    p = lab.select("entity", "month_idx", F.round(1 - F.col("seed_agreement"), 9).alias("p"))
    return files.reread(dy.targets(lab, 1).join(p, ["entity", "month_idx"]).filter("y is not null"), "scored")


@query(f"""{_YP}, th AS (SELECT p, sum(y) AS pos, count(*) AS c FROM ym GROUP BY 1), cu AS (SELECT pos, sum(pos) OVER w AS tp, sum(c) OVER w AS n FROM th WINDOW w AS (ORDER BY p DESC)),
tp AS (SELECT avg(y) AS top FROM (SELECT y, row_number() OVER (ORDER BY p DESC, entity, month_idx) AS n, count(*) OVER () AS m FROM ym) WHERE n <= greatest(1, ceil(m / 10.0)))
SELECT round(sum(pos * tp / n) / (SELECT sum(y) FROM ym), 6) AS average_precision, round((SELECT top FROM tp) / (SELECT avg(y) FROM ym), 6) AS lift FROM cu""")
def dr9_precision_lift(s, d):
    return st.precision_lift(_scored(s, d), "y", "p")


@query(f"""{_YP}, qs AS (SELECT unnest(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM ym), bn AS (SELECT y, p, (SELECT count(*) FROM qs WHERE round(q, 12) <= p) AS bin FROM ym)
SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS frac_pos FROM bn GROUP BY 1""")
def dr10_calibration_curve(s, d):
    return st.calibration_curve(_scored(s, d), "y", "p")


_MEASURES = {"a": "avg", "b": "stddev_pop", "c": "median"}
_PAIRS = list(combinations(_MEASURES, 2))
_TA = f", sl AS (SELECT type_id, part, v FROM (SELECT type_id, {', '.join(f'share_{x}' for x in SUFFIXES)} FROM sh JOIN lb USING (entity, month_idx)) UNPIVOT (v FOR part IN ({', '.join(f'share_{x}' for x in SUFFIXES)}))), f3 AS (SELECT type_id, part, {', '.join(f'round({f}(v), 9) AS {c}' for c, f in _MEASURES.items())} FROM sl GROUP BY 1, 2), rk AS (SELECT *, {', '.join(f'rank() OVER (PARTITION BY type_id ORDER BY {c}) + (count(*) OVER (PARTITION BY type_id, {c}) - 1) / 2 AS r{c}, row_number() OVER (PARTITION BY type_id ORDER BY {c} DESC, part) AS t{c}' for c in _MEASURES)} FROM f3), pa AS (" + " UNION ALL ".join(
    f"SELECT type_id, '{x}_{y}' AS pair, corr(r{x}, r{y}) AS rho, (SELECT sum(sign(p.{x} - q.{x}) * sign(p.{y} - q.{y})) / sqrt(sum(abs(sign(p.{x} - q.{x}))) * sum(abs(sign(p.{y} - q.{y})))) FROM f3 p JOIN f3 q ON p.type_id = q.type_id AND p.part < q.part WHERE p.type_id = rk.type_id) AS tau, " + ", ".join(f"count(*) FILTER (WHERE t{x} <= {k} AND t{y} <= {k}) / count(*) FILTER (WHERE t{x} <= {k} OR t{y} <= {k}) AS j{k}" for k in (3, 5)) + " FROM rk GROUP BY type_id" for x, y in _PAIRS) + ")"


def _described(s, d) -> DataFrame:
    rows = pn.closed(ad.panel_wide(s, d)).join(ad.labels_monthly(s, d).select("entity", "month_idx", "type_id"), ["entity", "month_idx"])
    long = rows.unpivot(["type_id"], [f"share_{x}" for x in SUFFIXES], "part", "v")
    return files.reread(long.groupBy("type_id", "part").agg(*[F.round(F.expr(f"{f}(v)"), 9).alias(c) for c, f in _MEASURES.items()]), "described")


@query(f"{_TA} SELECT type_id, pair, round(rho, 6) AS spearman, round(tau, 6) AS kendall, round(j3, 6) AS jaccard_top3, round(j5, 6) AS jaccard_top5 FROM pa")
def in4_agreement(s, d):
    return st.agreement(_described(s, d), list(_MEASURES))


@query(f"{_TA}, sv AS (SELECT type_id, round(avg(0.5 * rho + 0.5 * j5), 9) AS score FROM pa GROUP BY 1) SELECT type_id, round(score, 6) AS score, CASE WHEN score <= 0.4 THEN 'disputed' WHEN score <= 0.6 THEN 'core agreed' ELSE 'consistent' END AS verdict FROM sv")
def in4_verdict(s, d):
    return st.agreement_verdict(st.agreement(_described(s, d), list(_MEASURES)))


@query(", ty AS (SELECT type_id, exp(median(ln(val_all))) AS wage, avg(share_prod) AS food FROM sh JOIN lb USING (entity, month_idx) GROUP BY 1), ra AS (SELECT *, rank() OVER (ORDER BY wage) AS rw, rank() OVER (ORDER BY food) AS rf, lag(food) OVER (ORDER BY wage) AS before FROM ty) SELECT count(*) AS n_types, CASE WHEN count(*) > 2 THEN round(corr(rw, rf), 6) END AS spearman, coalesce(bool_and(food <= before), true) AS monotone FROM ra")
def in9_engel_check(s, d):
    rows = pn.closed(ad.panel_wide(s, d)).join(ad.labels_monthly(s, d).select("entity", "month_idx", "type_id"), ["entity", "month_idx"])
    return st.inverse_law(rows.groupBy("type_id").agg(F.exp(F.median(F.log("val_all"))).alias("wage"), F.avg("share_prod").alias("food")), "wage", "food")


_AMP = ", yr AS (SELECT entity, avg(CASE WHEN month_idx % 12 IN (6, 7) THEN val_all END) / avg(val_all) AS s FROM co GROUP BY entity, month_idx // 12), am AS (SELECT entity, avg(s) AS amp FROM yr GROUP BY 1), mk AS (SELECT entity, amp, region_code % 5 = 0 AS listed FROM am JOIN nd USING (entity))"


@query(f"{_AMP}, re AS (SELECT median(amp) AS m, quantile_cont(amp, 0.75) AS q FROM mk WHERE NOT listed) SELECT count(*) FILTER (WHERE listed) AS n_listed, round(median(amp) FILTER (WHERE listed), 6) AS median_listed, round(any_value(m), 6) AS median_rest, round(avg(CASE WHEN amp > q THEN 1.0 ELSE 0.0 END) FILTER (WHERE listed), 6) AS share_above_q75 FROM mk, re")
def in10_amplitude_check(s, d):
    listed = ad.nodes(s, d).filter("region_code % 5 = 0").select("entity")
    return st.listed_against_rest(pn.amplitude(ad.panel_wide(s, d)).select("entity", F.col("summer_amp").alias("amp")), listed, "amp")


_LABELS = ["type_id", "region_code", "season"]
_NMI = "WITH c AS (" + ORACLE_SQL["ic12_agreement"].split(", c AS (", 1)[1].replace("lb JOIN nd USING (entity)", "lj")
_NMIS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN nmi <= 0 THEN 0.0 ELSE nmi END AS nmi FROM (" + _NMI.replace("type_id a", f"{a} a").replace("region_code b", f"{b} b") + ")" for a, b in combinations(_LABELS, 2))


@query(f", lj AS (SELECT *, month_idx % 12 // 3 AS season FROM lb JOIN nd USING (entity)), nm AS ({_NMIS}) SELECT a, b, nmi, round(median(nmi) OVER (), 6) AS median, min(nmi) OVER () AS least, max(nmi) OVER () AS most FROM nm")
def ic15_nmi_matrix(s, d):
    rows = ad.labels_monthly(s, d).join(ad.nodes(s, d), "entity").withColumn("season", F.floor(F.col("month_idx") % 12 / 3))
    return st.nmi_matrix(files.reread(rows.select(*_LABELS), "labellings"), _LABELS)


@query("SELECT 'boosted' AS ranking, CASE WHEN a > b THEN 'boosted' ELSE 'margin_rank' END AS publish, a > b AS beats_margin, c > a AS logistic_wins FROM (SELECT avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_discount) FILTER (WHERE l_returnflag = 'N') AS b, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem)")
def dr15_publish(s, d):
    name = F.create_map(*[F.lit(x) for kv in {"A": "boosted", "N": "margin_rank", "R": "logistic"}.items() for x in kv])
    scores = table(s, d, "lineitem").filter("l_returnflag in ('A', 'N', 'R')").groupBy(F.element_at(name, F.col("l_returnflag")).alias("model")).agg(F.avg("l_discount").alias("pr_auc"))
    return st.publish(scores)



@query()
def ic13_switch_f1(s, d):
    lab = dy.smoothed(ad.labels_monthly(s, d)).select("entity", "month_idx", F.col("type_id").alias("found"), F.col("type_id_smooth").alias("true"))
    return st.switch_f1(lab, "true", "found")
