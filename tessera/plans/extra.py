"""Registered queries: small relational, window, set and scalar operators; clustering fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import cluster as cu
from tessera.operators import dynamics as dy
from tessera.operators import panel as pn
from tessera.plans.catalog import _LW, add
from tessera.sources import adapters as ad
from tessera.sources.adapters import SUFFIXES, table

_runs = lambda s, d: cu.by_seed_correlated(pn.growth(ad.panel_wide(s, d)), "resid", 0.2, 25)
add("cl10_louvain_seeds", _runs)
add("cl2_co_association", lambda s, d: cu.co_association(_runs(s, d)))
add("ag13_contingency", lambda s, d: ad.labels_monthly(s, d).join(ad.nodes(s, d), "entity").groupBy("type_id", "region_code").agg(F.count("*").alias("n")), "SELECT type_id, region_code, count(*) AS n FROM lb JOIN nd USING (entity) GROUP BY 1, 2")
add("ag8_crosstab", lambda s, d: (lambda x: x.select("type_id").distinct().crossJoin(F.broadcast(x.select("region_name").distinct())).join(x.groupBy("type_id", "region_name").agg(F.count("*").alias("n")), ["type_id", "region_name"], "left").fillna(0, ["n"]))(ad.labels_monthly(s, d).join(ad.nodes(s, d), "entity")), ", x AS (SELECT type_id, region_name FROM lb JOIN nd USING (entity)) SELECT a.type_id, b.region_name, count(x.type_id) AS n FROM (SELECT DISTINCT type_id FROM x) a CROSS JOIN (SELECT DISTINCT region_name FROM x) b LEFT JOIN x ON x.type_id = a.type_id AND x.region_name = b.region_name GROUP BY 1, 2")
add("ag3_counts", lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("big")), "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM orders GROUP BY 1")
add("ag16_top_categories", lambda s, d: ad.labels_monthly(s, d).groupBy("entity", "type_id").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("n"), "type_id"))).filter("rank <= 2"), "SELECT entity, type_id, n, row_number() OVER (PARTITION BY entity ORDER BY n DESC, type_id) AS rank FROM (SELECT entity, type_id, count(*) AS n FROM lb GROUP BY 1, 2) QUALIFY rank <= 2")
add("ag17_distinct_pair", lambda s, d: ad.labels_monthly(s, d).join(ad.nodes(s, d), "entity").groupBy("region_name", "type_id").agg(F.countDistinct("entity").alias("n")), "SELECT region_name, type_id, count(DISTINCT entity) AS n FROM lb JOIN nd USING (entity) GROUP BY 1, 2")
add("ag18_weighted_mean", lambda s, d: pn.closed(ad.panel_wide(s, d)).groupBy("month_idx").agg((F.sum(F.col("val_all") * F.col("share_prod")) / F.sum("val_all")).alias("p")), "SELECT month_idx, round(sum(val_all * share_prod) / sum(val_all), 6) AS p FROM sh GROUP BY 1")
add("ag19_booleans", lambda s, d: ad.labels_monthly(s, d).groupBy("entity").agg(F.bool_or(F.col("type_id") == 0).alias("any_0"), F.every(F.col("seed_agreement") > 0.2).alias("all_sure"), F.avg((F.col("type_id") == 1).cast("double")).alias("p1")), "SELECT entity, bool_or(type_id = 0) AS any_0, bool_and(seed_agreement > 0.2) AS all_sure, round(avg(CASE WHEN type_id = 1 THEN 1.0 ELSE 0.0 END), 6) AS p1 FROM lb GROUP BY 1")
add("wn2_differences", lambda s, d: ad.panel_wide(s, d).select("entity", "month_idx", *[(F.col("val_all") - F.lag("val_all", k).over(W.partitionBy("entity").orderBy("month_idx"))).alias(f"d{k}") for k in (1, 3, 12)]), "SELECT entity, month_idx, " + ", ".join(f"round(val_all - lag(val_all, {k}) {_LW}, 6) AS d{k}" for k in (1, 3, 12)) + " FROM pw")
add("wn7_rolling_deviation", lambda s, d: pn.rolling(ad.panel_wide(s, d), "val_all").select("entity", "month_idx", "vol"), "SELECT entity, month_idx, round(CASE WHEN count(*) OVER w = 6 THEN stddev_pop(val_all) OVER w END, 6) AS vol FROM pw WINDOW w AS (PARTITION BY entity ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
add("wn10_change_count", lambda s, d: ad.labels_monthly(s, d).withColumn("c", F.coalesce((F.col("type_id") != F.lag("type_id").over(dy._by())).cast("int"), F.lit(0))).select("entity", "month_idx", F.sum("c").over(dy._by().rowsBetween(W.unboundedPreceding, 0)).alias("changes")), f"SELECT entity, month_idx, CAST(sum(c) OVER (PARTITION BY entity ORDER BY month_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS changes FROM (SELECT entity, month_idx, coalesce(CAST(type_id <> lag(type_id) {_LW} AS INT), 0) AS c FROM lb)")
add("wn11_average_rank", lambda s, d: ad.panel_wide(s, d).select("entity", "month_idx", (F.rank().over(W.partitionBy("month_idx").orderBy("val_prod")) + (F.count("*").over(W.partitionBy("month_idx", "val_prod")) - 1) / 2).alias("rk")), "SELECT entity, month_idx, rank() OVER (PARTITION BY month_idx ORDER BY val_prod) + (count(*) OVER (PARTITION BY month_idx, val_prod) - 1) / 2 AS rk FROM pw")
add("wn15_prefix_sums", lambda s, d: ad.panel_wide(s, d).select("entity", "month_idx", F.sum("val_all").over(W.partitionBy("month_idx").orderBy("entity").rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.count("*").over(W.partitionBy("month_idx").orderBy("entity").rowsBetween(W.unboundedPreceding, 0)).alias("n")), "SELECT entity, month_idx, round(sum(val_all) OVER w, 6) AS s, count(*) OVER w AS n FROM pw WINDOW w AS (PARTITION BY month_idx ORDER BY entity ROWS UNBOUNDED PRECEDING)")
add("wn17_quarter_pairs", lambda s, d: ad.panel_wide(s, d).select("month_idx").distinct().select("month_idx", F.lead("month_idx").over(W.orderBy("month_idx")).alias("nxt")).filter(F.floor(F.col("month_idx") / 3) != F.floor(F.col("nxt") / 3)), "SELECT month_idx, nxt FROM (SELECT month_idx, lead(month_idx) OVER (ORDER BY month_idx) AS nxt FROM (SELECT DISTINCT month_idx FROM pw)) WHERE month_idx // 3 <> nxt // 3")
add("wn19_trend", lambda s, d: pn.closed(ad.panel_wide(s, d)).groupBy("entity").agg(F.regr_slope("share_prod", F.col("month_idx").cast("double")).alias("slope")), "SELECT entity, round(regr_slope(share_prod, CAST(month_idx AS DOUBLE)), 6) AS slope FROM sh GROUP BY 1")
add("so6_hash_sample", lambda s, d: ad.nodes(s, d).select("entity", F.md5(F.concat(F.col("entity").cast("string"), F.lit(":7"))).alias("h")).orderBy("h").limit(20), "SELECT entity, md5(concat(CAST(entity AS VARCHAR), ':7')) AS h FROM nd ORDER BY h LIMIT 20")
add("st5_first_per_key", lambda s, d: table(s, d, "orders").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("n = 1").select("o_custkey", "o_orderkey"), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
add("st4_except", lambda s, d: table(s, d, "customer").select("c_custkey").subtract(table(s, d, "orders").select("o_custkey")), "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
add("pn14_mean_shares", lambda s, d: pn.closed(ad.panel_wide(s, d)).groupBy("entity").agg(*[F.avg(f"share_{x}").alias(f"m_{x}") for x in SUFFIXES]).join(ad.nodes(s, d).select("entity", "region_name"), "entity", "right"), ", m AS (SELECT entity, " + ", ".join(f"round(avg(share_{x}), 6) AS m_{x}" for x in SUFFIXES) + " FROM sh GROUP BY 1) SELECT nd.entity, region_name, " + ", ".join(f"m_{x}" for x in SUFFIXES) + " FROM m RIGHT JOIN nd ON nd.entity = m.entity")
add("in4_spearman", lambda s, d: (lambda x: x.groupBy("month_idx").agg(F.corr("ra", "rb").alias("rho")))(ad.panel_wide(s, d).select("month_idx", *[(F.rank().over(W.partitionBy("month_idx").orderBy(v)) + (F.count("*").over(W.partitionBy("month_idx", v)) - 1) / 2).alias(a) for v, a in (("val_all", "ra"), ("val_prod", "rb"))])), ", rr AS (SELECT month_idx, rank() OVER (PARTITION BY month_idx ORDER BY val_all) + (count(*) OVER (PARTITION BY month_idx, val_all) - 1) / 2 AS ra, rank() OVER (PARTITION BY month_idx ORDER BY val_prod) + (count(*) OVER (PARTITION BY month_idx, val_prod) - 1) / 2 AS rb FROM pw) SELECT month_idx, round(corr(ra, rb), 6) AS rho FROM rr GROUP BY 1")
add("fn_strings", lambda s, d: table(s, d, "part").select("p_partkey", F.lpad(F.col("p_size").cast("string"), 8, "0").alias("z"), F.lower("p_type").alias("lo"), F.regexp_replace("p_name", "[^a-z ]", "").alias("clean"), F.sha2(F.col("p_name"), 256).alias("sha")), "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 8, '0') AS z, lower(p_type) AS lo, regexp_replace(p_name, '[^a-z ]', '', 'g') AS clean, sha256(p_name) AS sha FROM part")
add("fn_calendar", lambda s, d: ad.panel_wide(s, d).select("month_idx").distinct().select("month_idx", F.sin(2 * 3.141592653589793 * F.col("month_idx") / 12).alias("s"), F.cos(2 * 3.141592653589793 * F.col("month_idx") / 12).alias("c")), "SELECT DISTINCT month_idx, round(sin(2 * pi() * month_idx / 12), 6) + 0.0 AS s, round(cos(2 * pi() * month_idx / 12), 6) + 0.0 AS c FROM pw")
add("dr9_metrics", lambda s, d: (lambda x: x.agg(F.avg("y").alias("prevalence"), F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("brier"), ((F.sum(F.when(F.col("y") == 1, F.col("rk"))) - F.sum("y") * (F.sum("y") + 1) / 2) / (F.sum("y") * (F.count("*") - F.sum("y")))).alias("auc")))(dy.targets(ad.labels_monthly(s, d), 1).join(ad.labels_monthly(s, d).select("entity", "month_idx", (1 - F.col("seed_agreement")).alias("p")), ["entity", "month_idx"]).filter("y is not null").withColumn("rk", F.rank().over(W.orderBy("p")) + (F.count("*").over(W.partitionBy("p")) - 1) / 2)), f", yy AS (SELECT CAST(lead(type_id) {_LW} <> type_id AS INT) AS y, 1 - seed_agreement AS p FROM lb), rk AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM yy WHERE y IS NOT NULL) SELECT round(avg(y), 6) AS prevalence, round(avg(pow(y - p, 2)), 6) AS brier, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM rk")
