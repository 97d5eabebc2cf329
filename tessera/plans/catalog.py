"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import dynamics as dy
from tessera.operators import graph as gr
from tessera.operators import panel as pn
from tessera.operators import stepup as su
from tessera.sources import adapters as ad
from tessera.sources import files
from tessera.sources.adapters import SUFFIXES, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ad.PARTS.items()) + " END"
_SUMS = ", ".join(f"sum(CASE WHEN part = '{s}' THEN value ELSE 0 END) AS val_{s}" for s in SUFFIXES)
_SHARES = ", ".join(f"val_{s} / val_all AS share_{s}" for s in SUFFIXES[:-1]) + ", 1.0 - (" + " + ".join(f"val_{s} / val_all" for s in SUFFIXES[:-1]) + f") AS share_{SUFFIXES[-1]}"
_LOGS = "(" + " + ".join(f"ln(greatest(share_{s}, 1e-4))" for s in SUFFIXES) + ") / 6"
_CLR = ", ".join(f"ln(greatest(share_{s}, 1e-4)) - {_LOGS} AS clr_{s}" for s in SUFFIXES)
_ARGMAX = "list_position([" + ", ".join(f"val_{s}" for s in SUFFIXES) + "], greatest(" + ", ".join(f"val_{s}" for s in SUFFIXES) + ")) - 1"
_MAXVAL = "greatest(" + ", ".join(f"val_{s}" for s in SUFFIXES) + ")"
BASE = f"""
WITH RECURSIVE pl AS (SELECT l_suppkey AS entity, strftime(l_shipdate, '%Y-%m') AS month, {_CASE} AS part, sum(l_extendedprice) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1998-01-01' GROUP BY 1, 2, 3),
pw AS (SELECT entity, month, {_SUMS}, sum(value) AS val_all,
  (CAST(substr(month, 1, 4) AS INT) - 1996) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS month_idx FROM pl GROUP BY 1, 2),
co AS (SELECT * FROM pw WHERE entity IN (SELECT entity FROM pw GROUP BY 1 HAVING count(DISTINCT month_idx) = 24)),
sh AS (SELECT *, {_SHARES} FROM pw), shc AS (SELECT *, {_SHARES} FROM co), cl AS (SELECT *, {_CLR} FROM sh), clc AS (SELECT *, {_CLR} FROM shc),
se AS (SELECT *, ln(val_all) AS log_all, ln(val_all) - avg(ln(val_all)) OVER (PARTITION BY entity, month_idx % 12) AS sa_all,
  CASE WHEN lag(month_idx, 12) OVER (PARTITION BY entity ORDER BY month_idx) = month_idx - 12
       THEN ln(val_all) - lag(ln(val_all), 12) OVER (PARTITION BY entity ORDER BY month_idx) END AS yoy_all FROM co),
gw AS (SELECT entity, month_idx, g, g - avg(g) OVER (PARTITION BY month_idx) AS resid FROM
  (SELECT entity, month_idx, sa_all - lag(sa_all) OVER (PARTITION BY entity ORDER BY month_idx) AS g FROM se) WHERE g IS NOT NULL),
nd AS (SELECT s_suppkey AS entity, s_nationkey AS region_code, r_name AS region_name, s_acctbal AS account
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
xy AS (SELECT vec_id AS entity, 55.0 + CAST(embedding[1] AS DOUBLE) * 40 AS lat, 60.0 + CAST(embedding[2] AS DOUBLE) * 80 AS lon FROM embeddings),
lb AS (SELECT entity, month_idx, CAST({_ARGMAX} AS INT) AS type_id, {_MAXVAL} / val_all AS seed_agreement FROM pw),
pr AS (SELECT a.entity AS i, b.entity AS j, corr(a.resid, b.resid) AS r FROM gw a JOIN gw b ON a.month_idx = b.month_idx AND a.entity < b.entity GROUP BY 1, 2)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def add(name: str, fn: Query, tail: str | None = None) -> None:
    """Register; doubles are rounded on both sides, so the order of sums does not show."""
    QUERIES[name] = lambda s, d: rounded(fn(s, d))
    if tail:
        ORACLE_SQL[name] = f"{BASE} {tail}"


def R(x: str, alias: str = "") -> str:
    """A rounded SQL column."""
    return f"round({x}, 6) AS {alias or x.split('.')[-1]}"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return gr.correlations(pn.growth(ad.panel_wide(s, d)), "resid")


def _tested(s: SparkSession, d: str) -> DataFrame:
    return gr.bh(files.reread(_pairs(s, d).withColumn("p", gr.t_pvalue(F.col("r"), 21)), "pairs"))


def _label(s: SparkSession, d: str) -> DataFrame:
    return ad.nodes(s, d).select("entity", (F.col("region_code") % 5).alias("label"))


def _strong(s: SparkSession, d: str) -> DataFrame:
    return gr.correlations(pn.growth(ad.panel_wide(s, d)), "resid", 0.2).withColumnRenamed("r", "w")


def _strong_sums(s: SparkSession, d: str) -> DataFrame:
    return gr.correlated_block_sums(pn.growth(ad.panel_wide(s, d)), "resid", _label(s, d), 0.2)


_STRONG = "eg AS (SELECT i, j, r AS w FROM pr WHERE r > 0.2), lbl AS (SELECT entity, region_code % 5 AS label FROM nd), bo AS (SELECT i, j, w FROM eg UNION ALL SELECT j, i, w FROM eg), bs AS (SELECT a.label AS a, b.label AS b, sum(w) AS s FROM bo JOIN lbl a ON a.entity = i JOIN lbl b ON b.entity = j GROUP BY 1, 2)"
_cols = lambda p: ", ".join(R(f"{p}_{s}") for s in SUFFIXES)

# sources, projection, filters
add("src1_parquet_scan", lambda s, d: table(s, d, "nation"), "SELECT * FROM nation")
add("src2_pruned_scan", lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders")
add("prj5_unpivot", lambda s, d: ad.panel_wide(s, d).unpivot(["entity", "month_idx"], [f"val_{x}" for x in SUFFIXES], "part", "value"),
    "SELECT entity, month_idx, part, " + R("value") + " FROM (UNPIVOT (SELECT entity, month_idx, " + ", ".join(f"val_{x}" for x in SUFFIXES) + " FROM pw) ON " + ", ".join(f"val_{x}" for x in SUFFIXES) + " INTO NAME part VALUE value)")
add("flt1_range_null", lambda s, d: table(s, d, "supplier").filter((F.col("s_acctbal") > 0) & F.col("s_name").isNotNull()), "SELECT s_suppkey, s_name, s_nationkey, " + R("s_acctbal") + " FROM supplier WHERE s_acctbal > 0 AND s_name IS NOT NULL")
add("flt2_membership", lambda s, d: table(s, d, "nation").filter(F.col("n_regionkey").isin(1, 3)).join(table(s, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi"), "SELECT * FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
add("flt3_strings", lambda s, d: table(s, d, "part").filter(F.col("p_name").startswith("p") | F.col("p_brand").endswith("3") | F.col("p_type").contains("MALL")).select("p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_name, 'p') OR ends_with(p_brand, '3') OR contains(p_type, 'MALL')")
add("flt4_between", lambda s, d: table(s, d, "part").filter(F.col("p_size").between(5, 9)).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9")
add("flt5_dropna", lambda s, d: pn.seasonal(pn.core(ad.panel_wide(s, d))).dropna(subset=["yoy_all"]).select("entity", "month_idx", "yoy_all"), "SELECT entity, month_idx, " + R("yoy_all") + " FROM se WHERE yoy_all IS NOT NULL")
add("cnd1_first_match", lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, "big").when(F.col("p_size") > 20, "mid").otherwise("small").alias("k")), "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' ELSE 'small' END AS k FROM part")
add("cnd2_clip", lambda s, d: table(s, d, "part").select("p_partkey", F.greatest(F.least("p_size", F.lit(30)), F.lit(10)).alias("c")), "SELECT p_partkey, greatest(least(p_size, 30), 10) AS c FROM part")
add("cnd3_right_closed_bins", lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_size") <= 10, 0).when(F.col("p_size") <= 25, 1).otherwise(2).alias("bin")), "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 ELSE 2 END AS bin FROM part")
add("cnd4_quantile_bins", lambda s, d: table(s, d, "part").crossJoin(F.broadcast(table(s, d, "part").agg(F.percentile("p_retailprice", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("e")))).select("p_partkey", F.size(F.filter("e", lambda x: F.col("p_retailprice") > x)).alias("bin")),
    "SELECT p_partkey, CAST(p_retailprice > a AS INT) + CAST(p_retailprice > b AS INT) + CAST(p_retailprice > c AS INT) AS bin FROM part, (SELECT quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.5) b, quantile_cont(p_retailprice, 0.75) c FROM part)")

# joins
add("jn2_inner", lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("jn3_right", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "n"), "SELECT c_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) RIGHT JOIN customer ON o_custkey = c_custkey")
add("jn5_anti", lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
add("jn6_lookup", ad.nodes, "SELECT entity, region_code, region_name, " + R("account") + " FROM nd")
add("jn7_semi_next_month", lambda s, d: (lambda p: p.join(p.select("entity", (F.col("month_idx") - 1).alias("month_idx")), ["entity", "month_idx"], "left_semi"))(ad.labels_monthly(s, d)).select("entity", "month_idx"), "SELECT entity, month_idx FROM lb a WHERE EXISTS (SELECT 1 FROM lb b WHERE b.entity = a.entity AND b.month_idx = a.month_idx + 1)")
add("jn8_full_grid", lambda s, d: (lambda p: p.select("entity").distinct().crossJoin(p.select("month_idx").distinct()).join(p.select("entity", "month_idx", "val_all"), ["entity", "month_idx"], "left"))(ad.panel_wide(s, d)), "SELECT e.entity, m.month_idx, " + R("val_all") + " FROM (SELECT DISTINCT entity FROM pw) e CROSS JOIN (SELECT DISTINCT month_idx FROM pw) m LEFT JOIN pw ON pw.entity = e.entity AND pw.month_idx = m.month_idx")
add("jn12_fallback", lambda s, d: ad.panel_wide(s, d).filter(F.col("month_idx").isin(23, 22, 12)).groupBy("entity").agg(F.min_by("val_all", F.when(F.col("month_idx") == 22, 0).when(F.col("month_idx") == 23, 1).otherwise(2)).alias("v")), "SELECT entity, round(min_by(val_all, CASE month_idx WHEN 22 THEN 0 WHEN 23 THEN 1 ELSE 2 END), 6) AS v FROM pw WHERE month_idx IN (23, 22, 12) GROUP BY 1")

# aggregates
add("ag1_distinct", lambda s, d: pn.completeness(ad.panel_wide(s, d)).groupBy("kind").agg(F.count("*").alias("n")), "SELECT CASE WHEN n = 24 THEN 'core' WHEN lo > 0 AND n = hi - lo + 1 AND hi = 23 THEN 'left' WHEN hi < 23 AND n = hi - lo + 1 AND lo = 0 THEN 'right' WHEN lo = 0 AND hi = 23 THEN 'internal' ELSE 'mid' END AS kind, count(*) AS n FROM (SELECT entity, count(DISTINCT month_idx) n, min(month_idx) lo, max(month_idx) hi FROM pw GROUP BY 1) GROUP BY 1")
add("ag2_quantiles", lambda s, d: ad.panel_wide(s, d).groupBy("entity").agg(F.avg("val_all").alias("m"), F.median("val_all").alias("md"), (F.percentile("val_all", 0.75) - F.percentile("val_all", 0.25)).alias("iqr")), "SELECT entity, round(avg(val_all), 6) AS m, round(median(val_all), 6) AS md, round(quantile_cont(val_all, 0.75) - quantile_cont(val_all, 0.25), 6) AS iqr FROM pw GROUP BY 1")
add("ag4_deviations", lambda s, d: ad.panel_wide(s, d).groupBy("month_idx").agg(F.stddev_pop("val_all").alias("p"), F.stddev_samp("val_all").alias("s")), "SELECT month_idx, round(stddev_pop(val_all), 6) AS p, round(stddev_samp(val_all), 6) AS s FROM pw GROUP BY 1")
add("ag5_argmax_row", lambda s, d: ad.panel_wide(s, d).groupBy("entity").agg(F.max_by("month_idx", F.struct("val_all", "month_idx")).alias("best")), "SELECT entity, month_idx AS best FROM pw QUALIFY row_number() OVER (PARTITION BY entity ORDER BY val_all DESC, month_idx DESC) = 1")
add("ag6_first_last", lambda s, d: ad.labels_monthly(s, d).groupBy("entity").agg(F.min_by("type_id", "month_idx").alias("f"), F.max_by("type_id", "month_idx").alias("l")), "SELECT entity, min_by(type_id, month_idx) AS f, max_by(type_id, month_idx) AS l FROM lb GROUP BY 1")
add("ag7_base_shares", lambda s, d: ad.labels_monthly(s, d).groupBy("type_id").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))), "SELECT type_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lb GROUP BY 1")
add("ag9_pivot", lambda s, d: ad.labels_monthly(s, d).groupBy("entity").pivot("type_id", list(range(6))).agg(F.count(F.lit(1))).fillna(0).toDF("entity", *[f"t{k}" for k in range(6)]), "SELECT entity, " + ", ".join(f"count(*) FILTER (WHERE type_id = {k}) AS t{k}" for k in range(6)) + " FROM lb GROUP BY 1")
add("ag11_mode", lambda s, d: ad.labels_monthly(s, d).groupBy("entity").agg(F.mode("type_id", True).alias("m")), "SELECT entity, type_id AS m FROM (SELECT entity, type_id, count(*) n FROM lb GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, type_id) = 1")
add("ag14_lift", lambda s, d: (lambda x: x.groupBy("region_name", "type_id").agg(F.count("*").alias("n")).withColumn("lift", (F.col("n") / F.sum("n").over(W.partitionBy("region_name"))) / (F.sum("n").over(W.partitionBy("type_id")) / F.sum("n").over(W.partitionBy(F.lit(0))))))(ad.labels_monthly(s, d).join(ad.nodes(s, d), "entity")),
    "SELECT region_name, type_id, n, round((n / sum(n) OVER (PARTITION BY region_name)) / (sum(n) OVER (PARTITION BY type_id) / sum(n) OVER ()), 6) AS lift FROM (SELECT region_name, type_id, count(*) n FROM lb JOIN nd USING (entity) GROUP BY 1, 2)")
add("ag15_global_quantile", lambda s, d: ad.labels_monthly(s, d).agg(F.percentile("seed_agreement", 0.75).alias("q")), "SELECT round(quantile_cont(seed_agreement, 0.75), 6) AS q FROM lb")
add("ag20_gini", lambda s, d: dy.gini(ad.panel_wide(s, d), "val_all", "month_idx"), "SELECT month_idx, round(2 * sum(rn * val_all) / (count(*) * sum(val_all)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT month_idx, val_all, row_number() OVER (PARTITION BY month_idx ORDER BY val_all) rn FROM pw) GROUP BY 1")

# windows and panel
add("pn1_scd_resolve", lambda s, d: pn.resolve_validity(table(s, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", 9999).otherwise(F.year("o_orderdate")).alias("year_to"), ).groupBy("o_custkey", "year_to").agg(F.count("*").alias("n")), "o_custkey", "year_to"), "SELECT o_custkey, year_to, n FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN 9999 ELSE year(o_orderdate) END AS year_to, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (year_to = 9999) DESC, year_to DESC) = 1")
add("pn2_completeness", lambda s, d: pn.completeness(ad.panel_wide(s, d)), "SELECT entity, n AS n_months, CASE WHEN n = 24 THEN 'core' WHEN lo > 0 AND n = hi - lo + 1 AND hi = 23 THEN 'left' WHEN hi < 23 AND n = hi - lo + 1 AND lo = 0 THEN 'right' WHEN lo = 0 AND hi = 23 THEN 'internal' ELSE 'mid' END AS kind FROM (SELECT entity, count(DISTINCT month_idx) n, min(month_idx) lo, max(month_idx) hi FROM pw GROUP BY 1)")
add("pn3_shares", lambda s, d: pn.closed(ad.panel_wide(s, d)).select("entity", "month_idx", *[f"share_{x}" for x in SUFFIXES]), f"SELECT entity, month_idx, {', '.join(f'round(share_{x}, 6) + 0.0 AS share_{x}' for x in SUFFIXES)} FROM sh")
add("pn4_clr", lambda s, d: pn.clr(pn.closed(ad.panel_wide(s, d))).select("entity", "month_idx", *[f"clr_{x}" for x in SUFFIXES]), f"SELECT entity, month_idx, {_cols('clr')} FROM cl")
add("pn5_seasonal", lambda s, d: pn.seasonal(pn.core(ad.panel_wide(s, d))).select("entity", "month_idx", "log_all", "sa_all"), f"SELECT entity, month_idx, {R('log_all')}, {R('sa_all')} FROM se")
add("pn6_yoy", lambda s, d: pn.seasonal(pn.core(ad.panel_wide(s, d))).select("entity", "month_idx", "yoy_all"), f"SELECT entity, month_idx, {R('yoy_all')} FROM se")
add("pn7_node_features", lambda s, d: pn.node_features(ad.panel_wide(s, d)),
    "SELECT entity, round(avg(log_all), 6) AS level_mean, round(max_by(log_all, month_idx), 6) AS level_end, round(median(yoy_all), 6) AS yoy_median, round(quantile_cont(yoy_all, 0.75) - quantile_cont(yoy_all, 0.25), 6) AS yoy_iqr, "
    + ", ".join(f"round(avg(clr_{x}), 6) AS clr_{x}_mean, round(max_by(clr_{x}, month_idx) - min_by(clr_{x}, month_idx), 6) AS clr_{x}_delta" for x in SUFFIXES) + " FROM clc JOIN (SELECT entity, month_idx, log_all, yoy_all FROM se) USING (entity, month_idx) GROUP BY 1")
add("pn8_amplitude", lambda s, d: pn.amplitude(ad.panel_wide(s, d)),
    "SELECT entity, round(dec_amp, 6) AS dec_amp, round(summer_amp, 6) AS summer_amp, round(season_sd, 6) AS season_sd FROM (SELECT entity, avg(d) dec_amp, avg(m) summer_amp FROM (SELECT entity, month_idx // 12 y, avg(val_all) FILTER (WHERE month_idx % 12 = 11) / avg(val_all) FILTER (WHERE month_idx % 12 < 11) d, avg(val_all) FILTER (WHERE month_idx % 12 IN (6, 7)) / avg(val_all) m FROM co GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT entity, stddev_pop(m) / avg(m) season_sd FROM (SELECT entity, month_idx % 12 c, avg(val_all) m FROM co GROUP BY 1, 2) GROUP BY 1) USING (entity)")
add("pn10_impute_z", lambda s, d: pn.impute_scaled(ad.nodes(s, d).select("entity", "region_code", F.when(F.col("account") > 0, F.log10("account")).alias("v")), "v", "region_code").select("entity", "v_missing", "v", "z"),
    ", v0 AS (SELECT entity, region_code, CASE WHEN account > 0 THEN log10(account) END AS v0 FROM nd), v1 AS (SELECT entity, v0 IS NULL AS v_missing, coalesce(v0, median(v0) OVER (PARTITION BY region_code), median(v0) OVER ()) AS v FROM v0) SELECT entity, v_missing, round(v, 6) AS v, round((v - m) / sd, 6) AS z FROM v1, (SELECT avg(v0) AS m, stddev_samp(v0) AS sd FROM v0)")
add("pn15_month_grid", lambda s, d: pn.month_grid(s, "1996-01", "1997-12"), "SELECT strftime(g, '%Y-%m') AS month FROM generate_series(DATE '1996-01-01', DATE '1997-12-01', INTERVAL 1 MONTH) t(g)")
_HAV = "2 * 6371.0088 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"
add("pn16_haversine", lambda s, d: (lambda c: c.alias("a").join(c.alias("b"), (F.col("b.entity") == F.col("a.entity") + 1)).select(F.col("a.entity").alias("entity"), pn.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("km")))(ad.coords(s, d)), f"SELECT a.entity, round({_HAV}, 6) AS km FROM xy a JOIN xy b ON b.entity = a.entity + 1")
add("wn4_growth_residual", lambda s, d: pn.growth(ad.panel_wide(s, d)).select("entity", "month_idx", "g", "resid"), f"SELECT entity, month_idx, {R('g')}, {R('resid')} FROM gw")
_W6 = "OVER (PARTITION BY entity ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
add("wn6_rolling_slope", lambda s, d: pn.rolling(pn.seasonal(pn.core(ad.panel_wide(s, d))), "log_all").select("entity", "month_idx", "slope", "vol"), f"SELECT entity, month_idx, round(CASE WHEN count(log_all) {_W6} = 6 THEN regr_slope(log_all, CAST(month_idx AS DOUBLE)) {_W6} END, 6) AS slope, round(CASE WHEN count(log_all) {_W6} = 6 THEN stddev_pop(log_all) {_W6} END, 6) AS vol FROM se")
add("wn12_decile", lambda s, d: ad.panel_wide(s, d).withColumn("rk", F.rank().over(W.partitionBy("month_idx").orderBy("val_all")) + (F.count("*").over(W.partitionBy("month_idx", "val_all")) - 1) / 2).select("entity", "month_idx", F.ceil(F.col("rk") / F.count("*").over(W.partitionBy("month_idx")) * 10).alias("decile")), "SELECT entity, month_idx, CAST(ceil((rank() OVER (PARTITION BY month_idx ORDER BY val_all) + (count(*) OVER (PARTITION BY month_idx, val_all) - 1) / 2) / count(*) OVER (PARTITION BY month_idx) * 10) AS BIGINT) AS decile FROM pw")
add("so3_global_top_k", lambda s, d: ad.panel_wide(s, d).orderBy(F.desc("val_all"), "entity", "month_idx").limit(10).select("entity", "month_idx", "val_all"), f"SELECT entity, month_idx, {R('val_all')} FROM pw ORDER BY pw.val_all DESC, entity, month_idx LIMIT 10")
add("st1_union_all", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("st3_intersect", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey")), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")

# graphs and measures
add("gr1_correlation", _pairs, f"SELECT i, j, {R('r')} FROM pr")
_T = "(r * sqrt(21 / greatest(1 - r * r, 1e-15)))"
_TH = f"atan({_T} / sqrt(21))"


def _student_sql(df: int) -> str:
    term, terms = f"cos({_TH})", []
    for k in range(1, df - 1, 2):
        terms.append(term)
        term = f"{(k + 1) / (k + 2)!r} * pow(cos({_TH}), 2) * ({term})"
    return f"greatest(1 - abs((2 / pi()) * ({_TH} + sin({_TH}) * ({' + '.join(terms)}))), 0.0)"


_PV = "pv AS (SELECT i, j, r, " + _student_sql(21) + " AS p FROM pr), bh AS (SELECT i, j, r, p, least(min(p * m / k) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM pv))"
add("gr2_pvalues", lambda s, d: _pairs(s, d).withColumn("p", gr.t_pvalue(F.col("r"), 21)).select("i", "j", "p"), f", {_PV} SELECT i, j, {R('p')} FROM pv")
add("gr3_bh", lambda s, d: su.step_up(pn.growth(ad.panel_wide(s, d)), "resid", 21).withColumn("keep", F.col("q") <= 0.05), f", {_PV} SELECT i, j, {R('q')}, q <= 0.05 AS keep FROM bh")
_KNN = "d2 AS (SELECT i, j, r FROM pr UNION ALL SELECT j, i, r FROM pr), k10 AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY greatest(r, 0.0) DESC, j) n FROM d2) WHERE n <= 10), k3 AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY r DESC, j) n FROM d2) WHERE n <= 3)"
add("gr4_similarity_edges", lambda s, d: gr.similarity_edges(_tested(s, d)), f", {_PV}, {_KNN} (SELECT * FROM k10 INTERSECT SELECT i, j FROM bh WHERE q <= 0.05) UNION SELECT * FROM k3")
add("ms1_nearest", lambda s, d: gr.nearest(_pairs(s, d), "r", 5).select("i", "j", "rank"), f", {_KNN} SELECT i, j, n AS rank FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY r DESC, j) n FROM d2) WHERE n <= 5")
add("x1_level_pearson", lambda s, d: gr.correlations(pn.core(ad.panel_wide(s, d)), "val_all"), "SELECT a.entity AS i, b.entity AS j, round(corr(a.val_all, b.val_all), 6) AS r FROM co a JOIN co b ON a.month_idx = b.month_idx AND a.entity < b.entity GROUP BY 1, 2")
add("gr13_internal_ratio", lambda s, d: _strong_sums(s, d).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("s")).otherwise(0.0)) / F.sum("s")).alias("ratio")), f", {_STRONG} SELECT round(sum(CASE WHEN a = b THEN s ELSE 0 END) / sum(s), 6) AS ratio FROM bs")
add("ic4_block_sums", lambda s, d: _strong_sums(s, d), f", {_STRONG} SELECT a, b, {R('s')} FROM bs")
add("ic5_graph_indices", lambda s, d: gr.block_indices(_strong_sums(s, d), _label(s, d)).select("avi", "avu", "anui", "q"),
    f", {_STRONG}, pg AS (SELECT g.label AS a, coalesce(sum(s), 0) vol, coalesce(sum(CASE WHEN a = b THEN s END), 0) inn FROM (SELECT DISTINCT label FROM lbl) g LEFT JOIN bs ON bs.a = g.label GROUP BY 1), hd AS (SELECT avg(CASE WHEN vol > 0 THEN inn / vol ELSE 0 END) avi, sum(inn / t - pow(vol / t, 2)) q FROM pg, (SELECT sum(vol) t FROM pg)), av AS (SELECT sum(s / (x.vol - x.inn + y.vol - y.inn - s)) / (SELECT count(*) FROM pg) avu FROM bs JOIN pg x ON x.a = bs.a JOIN pg y ON y.a = bs.b WHERE bs.a <> bs.b) SELECT {R('avi')}, {R('avu')}, round(1 / (avu + 1 / avi), 6) AS anui, {R('q')} FROM hd, av")
add("ic12_agreement", lambda s, d: gr.agreement(ad.labels_monthly(s, d).join(ad.nodes(s, d), "entity"), "type_id", "region_code").select("ari", "nmi"),
    ", c AS (SELECT type_id a, region_code b, CAST(count(*) AS DOUBLE) n FROM lb JOIN nd USING (entity) GROUP BY 1, 2), t AS (SELECT sum(n) t, sum(n * (n - 1) / 2) s, sum(n * ln(n)) h FROM c), ra AS (SELECT sum(n * (n - 1) / 2) sa, sum(n * ln(n)) ha FROM (SELECT sum(n) n FROM c GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) sb, sum(n * ln(n)) hb FROM (SELECT sum(n) n FROM c GROUP BY b)) SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round((h / t + ln(t) - ha / t - hb / t) / ((ln(t) - ha / t + ln(t) - hb / t) / 2), 6) AS nmi FROM t, ra, rb")

# dynamics, targets, convergence, statistics
_LW = "OVER (PARTITION BY entity ORDER BY month_idx)"
add("dy5_smoothing", lambda s, d: dy.smoothed(ad.labels_monthly(s, d)).select("entity", "month_idx", "type_id_smooth"), f"SELECT entity, month_idx, CASE WHEN lag(type_id) {_LW} = lead(type_id) {_LW} THEN lag(type_id) {_LW} ELSE type_id END AS type_id_smooth FROM lb")
add("wn9_flicker", lambda s, d: dy.flicker_share(ad.labels_monthly(s, d)), f"SELECT round(avg(CASE WHEN a <> b AND b = c THEN 1.0 ELSE 0.0 END), 6) AS flicker FROM (SELECT lag(type_id) {_LW} a, type_id b, lead(type_id) {_LW} c FROM lb) WHERE a IS NOT NULL AND c IS NOT NULL")
_STEP = f"st AS (SELECT month_idx, type_id AS f, lead(type_id) {_LW} AS t FROM lb), sp AS (SELECT * FROM st WHERE t IS NOT NULL), ks AS (SELECT f AS k FROM sp UNION SELECT t FROM sp), tr AS (SELECT m.month_idx, a.k AS type_from, b.k AS type_to, count(sp.f) AS n_movers FROM (SELECT DISTINCT month_idx FROM sp) m CROSS JOIN ks a CROSS JOIN ks b LEFT JOIN sp ON sp.month_idx = m.month_idx AND sp.f = a.k AND sp.t = b.k GROUP BY 1, 2, 3)"
add("dy7_transitions", lambda s, d: dy.transitions(ad.labels_monthly(s, d)), f", {_STEP} SELECT *, CAST(sum(n_movers) OVER (PARTITION BY month_idx, type_from) AS BIGINT) AS n_base FROM tr")
add("dy8_mean_transition", lambda s, d: dy.mean_transition(ad.labels_monthly(s, d)), f", {_STEP} SELECT type_from, type_to, round(sum(n_movers) / sum(sum(n_movers)) OVER (PARTITION BY type_from), 6) AS p FROM tr GROUP BY 1, 2 QUALIFY sum(sum(n_movers)) OVER (PARTITION BY type_from) > 0")
add("dy10_order_test", lambda s, d: dy.order_test(ad.labels_monthly(s, d)), f", t3 AS (SELECT lag(type_id) {_LW} h, type_id i, lead(type_id) {_LW} j FROM lb), c3 AS (SELECT h, i, j, count(*) n FROM t3 WHERE h IS NOT NULL AND j IS NOT NULL GROUP BY 1, 2, 3) SELECT round(sum(2 * n * ln((n / hi) / (ij / ii))), 6) AS lr, CAST(count(DISTINCT i) * pow(count(DISTINCT i) - 1, 2) AS INT) AS df FROM (SELECT *, sum(n) OVER (PARTITION BY h, i) hi, sum(n) OVER (PARTITION BY i, j) ij, sum(n) OVER (PARTITION BY i) ii FROM c3)")
add("dy3_jaccard", lambda s, d: dy.jaccard(ad.labels_monthly(s, d)), f"SELECT month_idx, a, b, round(n / (sum(n) OVER (PARTITION BY month_idx, a) + sum(n) OVER (PARTITION BY month_idx, b) - n), 6) AS jaccard FROM (SELECT month_idx, a, b, count(*) n FROM (SELECT entity, month_idx, type_id a, lead(type_id) {_LW} b FROM lb) WHERE b IS NOT NULL GROUP BY 1, 2, 3)")
add("dr1_targets", lambda s, d: dy.targets(ad.labels_monthly(s, d)), f"SELECT entity, month_idx, CASE WHEN lead(type_id, 3) {_LW} IS NOT NULL THEN CAST(lead(type_id, 1) {_LW} <> type_id OR lead(type_id, 2) {_LW} <> type_id OR lead(type_id, 3) {_LW} <> type_id AS INT) END AS y FROM lb")
add("cv1_dispersion", lambda s, d: dy.cross_sectional_h(pn.core(ad.panel_wide(s, d)), "val_all"), "SELECT month_idx, round(avg(pow(x - 1, 2)), 6) AS h FROM (SELECT month_idx, val_all / avg(val_all) OVER (PARTITION BY month_idx) x FROM co) GROUP BY 1")
add("cv5_sigma", lambda s, d: dy.sigma_trend(pn.core(ad.panel_wide(s, d)), "val_all"), "SELECT round(regr_slope(ln(cv), CAST(month_idx AS DOUBLE)), 6) AS slope, round(min_by(cv, month_idx), 6) AS cv_first, round(max_by(cv, month_idx), 6) AS cv_last FROM (SELECT month_idx, stddev_pop(val_all) / avg(val_all) cv FROM co GROUP BY 1)")
add("cv6_beta", lambda s, d: dy.beta(pn.seasonal(pn.core(ad.panel_wide(s, d))), "log_all"), "SELECT round(regr_slope(d, x0), 6) AS beta, count(*) AS n FROM (SELECT entity, min_by(log_all, month_idx) x0, (max_by(log_all, month_idx) - min_by(log_all, month_idx)) / 23 d FROM se GROUP BY 1)")
add("in11_kruskal", lambda s, d: dy.kruskal(ad.nodes(s, d).select("account", "region_name"), "account", "region_name"),
    "SELECT round(h, 6) AS h, round((h - k + 1) / (n - k), 6) AS eta2 FROM (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h, n, k FROM (SELECT sum(r * r / m) s, count(*) k FROM (SELECT region_name, sum(rk) r, count(*) m FROM (SELECT region_name, rank() OVER (ORDER BY account) + (count(*) OVER (PARTITION BY account) - 1) / 2 AS rk FROM nd) GROUP BY 1)), (SELECT CAST(count(*) AS DOUBLE) n FROM nd), (SELECT sum(pow(t, 3) - t) ties FROM (SELECT count(*) t FROM nd GROUP BY account)))")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly log-ratio profile and demeaned seasonal growth of each entity."""
    panel = ad.panel_wide(spark, sf_dir)
    profile = pn.clr(pn.closed(panel)).select("entity", "month_idx", *[f"clr_{x}" for x in SUFFIXES])
    return rounded(profile.join(pn.growth(panel).select("entity", "month_idx", "resid"), ["entity", "month_idx"]))
