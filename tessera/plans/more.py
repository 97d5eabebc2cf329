"""More registered queries: measures, layers, indices, drivers, events, benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import dynamics as dy
from tessera.operators import graph as gr
from tessera.operators import measures as ms
from tessera.operators import panel as pn
from tessera.plans.catalog import _HAV, _KNN, _LW, _PV, R, _pairs, _strong, add
from tessera.sources import adapters as ad
from tessera.sources.adapters import SUFFIXES, table

_RG = ", rg AS (SELECT entity, month_idx, g FROM (SELECT entity, month_idx, ln(val_all) - lag(ln(val_all)) OVER (PARTITION BY entity ORDER BY month_idx) AS g FROM co) WHERE g IS NOT NULL)"
_corr = lambda t, c: f"SELECT a.entity AS i, b.entity AS j, round(corr(a.{c}, b.{c}), 6) AS r FROM {t} a JOIN {t} b ON a.month_idx = b.month_idx AND a.entity < b.entity GROUP BY 1, 2"
add("x2_growth_pearson", lambda s, d: gr.correlations(ms.raw_growth(ad.panel_wide(s, d)), "g"), f"{_RG} {_corr('rg', 'g')}")
add("m1_calendar_pearson", lambda s, d: gr.correlations(ms.calendar_residual(ad.panel_wide(s, d)), "resid"), f"{_RG}, rc AS (SELECT entity, month_idx, g - avg(g) OVER (PARTITION BY month_idx % 12) AS resid FROM rg) {_corr('rc', 'resid')}")
_mean = lambda p: ", ".join(f"avg({p}_{x}) AS {x}" for x in SUFFIXES)
add("x3_share_cosine", lambda s, d: ms.share_cosine(ad.panel_wide(s, d)), f", mv AS (SELECT entity, {_mean('share')} FROM shc GROUP BY 1) SELECT a.entity AS i, b.entity AS j, round((" + " + ".join(f"a.{x} * b.{x}" for x in SUFFIXES) + ") / (sqrt(" + " + ".join(f"a.{x} * a.{x}" for x in SUFFIXES) + ") * sqrt(" + " + ".join(f"b.{x} * b.{x}" for x in SUFFIXES) + ")), 6) AS s FROM mv a JOIN mv b ON a.entity < b.entity")
add("m5_aitchison", lambda s, d: ms.aitchison(ad.panel_wide(s, d)), f", mv AS (SELECT entity, {_mean('clr')} FROM clc GROUP BY 1) SELECT a.entity AS i, b.entity AS j, round(-sqrt(" + " + ".join(f"pow(a.{x} - b.{x}, 2)" for x in SUFFIXES) + "), 6) AS s FROM mv a JOIN mv b ON a.entity < b.entity")
_LAG = ", lg AS (SELECT a.entity AS i, b.entity AS j, k AS lag, corr(a.resid, b.resid) AS r FROM gw a JOIN gw b ON a.entity < b.entity JOIN (SELECT unnest(generate_series(-3, 3)) AS k) ON b.month_idx = a.month_idx - k GROUP BY 1, 2, 3), bl AS (SELECT i, j, round(abs(r), 6) AS r FROM lg QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY abs(r) DESC, abs(lag), lag) = 1)"
add("m4_best_lag", lambda s, d: ms.lagged(pn.growth(ad.panel_wide(s, d))).select("i", "j", F.abs("r").alias("r")), f"{_LAG} SELECT * FROM bl")
add("m6_dtw", lambda s, d: ms.dtw_pairs(pn.seasonal(pn.core(ad.panel_wide(s, d))), "log_all"))
_DIST = f", ds AS (SELECT a.entity AS i, b.entity AS j, {_HAV} AS km FROM xy a JOIN xy b ON a.entity < b.entity), db AS (SELECT i, j, km FROM ds UNION ALL SELECT j, i, km FROM ds), nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY km, j) AS rank FROM db QUALIFY row_number() OVER (PARTITION BY i ORDER BY km, j) <= 3), ge AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(km) AS km FROM nn GROUP BY 1, 2)"
_xy = ad.coords
add("pn12_nearest_neighbours", lambda s, d: ms.nearest_by_distance(_xy(s, d)), f"{_DIST} SELECT i, j, {R('km')}, rank FROM nn")
add("gr5_geo_layer", lambda s, d: ms.geo_layer(_xy(s, d)), f"{_DIST} SELECT i, j, {R('km')}, round(exp(-km / 150), 6) AS w FROM ge")
add("st8_symmetrised", lambda s, d: ms.nearest_by_distance(_xy(s, d)).select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")).select("e.i", "e.j").distinct(), f"{_DIST} SELECT i, j FROM nn UNION SELECT j, i FROM nn")
add("m8_gravity", lambda s, d: ms.gravity(_xy(s, d), ad.panel_wide(s, d).groupBy("entity").agg(F.sum("val_all").alias("mass"))), f"{_DIST}, mm AS (SELECT entity, sum(val_all) AS mass FROM pw GROUP BY 1), gv AS (SELECT i, j, a.mass * b.mass / pow(greatest(km, 1.0), 1.5) AS g FROM ge JOIN mm a ON a.entity = i JOIN mm b ON b.entity = j) SELECT i, j, round(g / max(g) OVER (), 6) AS s FROM gv")
_DOT = lambda x, y: "(" + " + ".join(f"{x}.clr_{s} * {y}.clr_{s}" for s in SUFFIXES) + ")"
add("gr6_monthly_weights", lambda s, d: ms.correlated_monthly_weights(pn.growth(ad.panel_wide(s, d)), "resid", 0.4, ad.panel_wide(s, d)), f", ee AS (SELECT i, j FROM pr WHERE r > 0.4) SELECT i, j, a.month_idx, round(least(greatest({_DOT('a', 'b')} / (sqrt({_DOT('a', 'a')}) * sqrt({_DOT('b', 'b')})), 1e-6), 1.0), 6) AS w FROM ee JOIN cl a ON a.entity = i JOIN cl b ON b.entity = j AND b.month_idx = a.month_idx")
add("gr8_degrees", lambda s, d: gr.both_ways(_strong(s, d), "w").groupBy("i").agg(F.count("*").alias("degree"), F.sum("w").alias("strength")), "SELECT i, count(*) AS degree, round(sum(r), 6) AS strength FROM (SELECT i, j, r FROM pr WHERE r > 0.2 UNION ALL SELECT j, i, r FROM pr WHERE r > 0.2) GROUP BY 1")
add("gr8_components", lambda s, d: ms.connected(gr.tested_edges(pn.growth(ad.panel_wide(s, d)), "resid", 21)))
add("gr9_static_max", lambda s, d: gr.correlated_or_linked(pn.growth(ad.panel_wide(s, d)), "resid", 0.2, ms.geo_layer(_xy(s, d))).select("i", "j", F.greatest("r", "w").alias("w")), f"{_DIST} SELECT i, j, round(max(w), 6) AS w FROM (SELECT i, j, r AS w FROM pr WHERE r > 0.2 UNION ALL SELECT i, j, exp(-km / 150) FROM ge) GROUP BY 1, 2")
add("gr7_edge_audit", lambda s, d: gr.tested(pn.growth(ad.panel_wide(s, d)), "resid", 21, 0.05, 3), f", {_PV}, {_KNN} SELECT bh.i, bh.j, {R('r')}, {R('p')}, q <= 0.05 AS bh_pass, k3.i IS NOT NULL AS in_safety FROM bh LEFT JOIN k3 ON k3.i = bh.i AND k3.j = bh.j")
add("ms4_similarity_stats", lambda s, d: _pairs(s, d).agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd")), "SELECT round(avg(r), 6) AS m, round(stddev_pop(r), 6) AS sd FROM pr")
add("ll4_empirical_p", lambda s, d: (lambda p: p.withColumn("pe", (1 + F.count("*").over(W.orderBy(F.col("r").desc()).rangeBetween(W.unboundedPreceding, 0))) / (1 + F.count("*").over(W.partitionBy(F.lit(0))))))(_pairs(s, d)).select("i", "j", "pe"), "SELECT i, j, round((1 + count(*) OVER (ORDER BY r DESC RANGE UNBOUNDED PRECEDING)) / (1 + count(*) OVER ()), 6) AS pe FROM pr")

_VL = ", vl AS (SELECT vec_id AS entity, label, f - 1 AS f, CAST(embedding[f] AS DOUBLE) AS x FROM embeddings, (SELECT CAST(unnest(generate_series(1, 64)) AS INT) AS f)), vc AS (SELECT *, x - avg(x) OVER (PARTITION BY f) AS c FROM vl), mk AS (SELECT label, f, count(*) * pow(avg(c), 2) AS b FROM vc GROUP BY 1, 2)"
_long = lambda s, d: ms.vectors_long(table(s, d, "embeddings"), 64)
add("cl4_feature_matrix", lambda s, d: ms.standardised(_long(s, d)).select("entity", "f", "z"), f"{_VL} SELECT entity, f, round(c / stddev_pop(x) OVER (PARTITION BY f), 6) AS z FROM vc")
add("cl5_kmeans", lambda s, d: ms.kmeans(_long(s, d), 4))
add("in1_mirkin", lambda s, d: ms.mirkin(_long(s, d)), f"{_VL} SELECT label, f, {R('b')}, round(b / t, 6) AS rel FROM mk JOIN (SELECT f, sum(c * c) AS t FROM vc GROUP BY 1) USING (f)")
add("ic2_calinski", lambda s, d: ms.calinski(_long(s, d)), f"{_VL} SELECT round(b / (k - 1) / ((t - b) / (n - k)) / n, 6) AS ch_over_n FROM (SELECT sum(b) AS b FROM mk), (SELECT sum(c * c) AS t, count(DISTINCT entity) AS n, count(DISTINCT label) AS k FROM vc)")
add("ic1_silhouette", lambda s, d: ms.silhouette(table(s, d, "embeddings"), 64), f"{_VL}, dd AS (SELECT a.entity AS i, a.label AS own, b.label AS other, sqrt(sum(pow(a.x - b.x, 2))) AS d FROM vl a JOIN vl b ON a.f = b.f AND a.entity <> b.entity GROUP BY a.entity, b.entity, 2, 3), sl AS (SELECT i, min(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM (SELECT i, own, other, avg(d) AS d FROM dd GROUP BY 1, 2, 3) GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sl")
add("wn13_loo_median", lambda s, d: ms.leave_one_out_median(ad.nodes(s, d).select("entity", "region_code", "account"), "account", "region_code").select("entity", "loo"), "SELECT a.entity, round(median(b.account), 6) AS loo FROM nd a LEFT JOIN nd b ON b.region_code = a.region_code AND b.entity <> a.entity GROUP BY 1")

_EV = f", sm AS (SELECT entity, month_idx, CASE WHEN lag(type_id) {_LW} = lead(type_id) {_LW} THEN lag(type_id) {_LW} ELSE type_id END AS k, seed_agreement FROM lb), ev AS (SELECT entity, month_idx, lag(k) {_LW} AS type_from, k AS type_to, seed_agreement, lag(seed_agreement) {_LW} AS before FROM sm)"
add("dy12_events", lambda s, d: (lambda e: e.filter(F.col("type_from").isNotNull() & (F.col("type_from") != F.col("type_to"))))(dy.smoothed(ad.labels_monthly(s, d)).select("entity", "month_idx", F.lag("type_id_smooth").over(dy._by()).alias("type_from"), F.col("type_id_smooth").alias("type_to"))), f"{_EV} SELECT entity, month_idx, type_from, type_to FROM ev WHERE type_from IS NOT NULL AND type_from <> type_to")
add("dy13_screen", lambda s, d: dy.smoothed(ad.labels_monthly(s, d)).select("entity", "month_idx", F.lag("type_id_smooth").over(dy._by()).alias("type_from"), F.col("type_id_smooth").alias("type_to"), F.least("seed_agreement", F.lag("seed_agreement").over(dy._by())).alias("low")).filter("type_from is not null and type_from <> type_to").select("entity", "month_idx", F.when(F.col("low") >= 0.4, "").otherwise("seed_agreement").alias("reject_reason")), f"{_EV} SELECT entity, month_idx, CASE WHEN least(seed_agreement, before) >= 0.4 THEN '' ELSE 'seed_agreement' END AS reject_reason FROM ev WHERE type_from IS NOT NULL AND type_from <> type_to")
add("dr4_foreign_share", lambda s, d: (lambda n, l: n.join(l.select(F.col("entity").alias("i"), "month_idx", F.col("type_id").alias("own")), "i").join(l.select(F.col("entity").alias("j"), "month_idx", F.col("type_id").alias("near")), ["j", "month_idx"]).groupBy("i", "month_idx").agg(F.avg((F.col("own") != F.col("near")).cast("double")).alias("foreign_share")))(ms.nearest_by_distance(_xy(s, d)).select("i", "j"), ad.labels_monthly(s, d)), f"{_DIST} SELECT i, a.month_idx, round(avg(CASE WHEN a.type_id <> b.type_id THEN 1.0 ELSE 0.0 END), 6) AS foreign_share FROM nn JOIN lb a ON a.entity = i JOIN lb b ON b.entity = j AND b.month_idx = a.month_idx GROUP BY 1, 2")
add("dr6_folds", lambda s, d: (lambda m: m.select(F.col("month_idx").alias("v")).join(m.select(F.col("month_idx").alias("t")), F.col("t") <= F.col("v") - 4).filter("v >= 11"))(ad.panel_wide(s, d).select("month_idx").distinct()), ", mo AS (SELECT DISTINCT month_idx FROM pw) SELECT a.month_idx AS v, b.month_idx AS t FROM mo a JOIN mo b ON b.month_idx <= a.month_idx - 4 WHERE a.month_idx >= 11")
add("bm1_composite", lambda s, d: ad.panel_wide(s, d).groupBy("entity").agg(F.avg("val_prod").alias("a"), F.avg("val_market").alias("b")).select("entity", pn.zscore("a").alias("za"), pn.zscore("b").alias("zb")).withColumn("score", 0.6 * F.col("za") + 0.4 * F.col("zb")), ", lg AS (SELECT entity, avg(val_prod) AS a, avg(val_market) AS b FROM pw GROUP BY 1), zz AS (SELECT entity, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb FROM lg) SELECT entity, round(za, 6) AS za, round(zb, 6) AS zb, round(0.6 * za + 0.4 * zb, 6) AS score FROM zz")
# averages of cents over at most 24 months differ by more than 1e-6 or not at all: equal ones get one rank, in whatever order they were summed
add("bm6_borda", lambda s, d: ad.panel_wide(s, d).groupBy("entity").agg(F.round(F.avg("val_prod"), 6).alias("a"), F.round(F.avg("val_market"), 6).alias("b")).select("entity", (F.rank().over(W.orderBy("a")) + F.rank().over(W.orderBy("b")) - 2).alias("borda")), "SELECT entity, rank() OVER (ORDER BY a) + rank() OVER (ORDER BY b) - 2 AS borda FROM (SELECT entity, avg(val_prod) AS a, avg(val_market) AS b FROM pw GROUP BY 1)")
add("in9_engel", lambda s, d: pn.closed(ad.panel_wide(s, d)).join(ad.labels_monthly(s, d), ["entity", "month_idx"]).groupBy("type_id").agg(F.avg(F.log("val_all")).alias("level"), F.avg("share_prod").alias("basic")), "SELECT type_id, round(avg(ln(val_all)), 6) AS level, round(avg(share_prod), 6) AS basic FROM sh JOIN lb USING (entity, month_idx) GROUP BY 1")
