"""Registered queries: files, relational operators, panel context, layers, label maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import scalar as fn
from tessera.operators import dynamics as dy
from tessera.operators import graph as gr
from tessera.operators import measures as ms
from tessera.operators import panel as pn
from tessera.plans.catalog import _HAV, _LW, R, _label, _pairs, _strong, add
from tessera.plans.more import _DIST, _RG, _xy
from tessera.sources import adapters as ad
from tessera.sources import files
from tessera.sources.adapters import SUFFIXES, table


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def register(f):
        add(f.__name__, f, sql)
        return f

    return register


# files


@query("SELECT * FROM nation")
def src3_csv_scan(s: SparkSession, d: str) -> DataFrame:
    return files.through_csv(table(s, d, "nation"), "nation")


@query("SELECT entity, month_idx, type_id FROM lb WHERE month_idx BETWEEN 3 AND 8 AND entity IN (SELECT entity FROM co)")
def src5_snapshots(s, d):
    path = files.work_folder(s, "snapshots")
    files.write_snapshots(ad.labels_monthly(s, d).join(pn.core(ad.panel_wide(s, d)).select("entity").distinct(), "entity").select("entity", "month_idx", "type_id"), path)
    return files.read_snapshots(s, path, 3, 8, "entity")


@query("SELECT * FROM (VALUES ('graph.k', '3'), ('graph.q', '0.05'), ('seed', '7')) AS t(name, value)")
def src7_settings(s, d):
    both = files.merged({"graph": {"k": 10, "q": 0.05}, "seed": 0}, {"graph": {"k": 3}, "seed": 7})
    return s.createDataFrame(files.flat(both), "name string, value string")


@query("SELECT o_orderkey AS run FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def src9_latest_run(s, d):
    usable = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW")
    return files.latest(table(s, d, "orders"), usable, F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_orderkey").alias("run"))


@query("SELECT o_orderkey AS run FROM orders ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate DESC, o_orderkey DESC LIMIT 1")
def src11_newest_grid(s, d):
    full = F.col("o_orderpriority") == "1-URGENT"
    return files.latest(table(s, d, "orders"), F.lit(True), full.desc(), F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_orderkey").alias("run"))


@query(f"SELECT entity, month, {', '.join(R(f'share_{x}') for x in SUFFIXES[:5])} FROM sh")
def snk1_parquet_write(s, d):
    return files.reread(pn.closed(ad.panel_wide(s, d)).select("entity", "month", *[f"share_{x}" for x in SUFFIXES[:5]]), "panel")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def snk2_csv_write(s, d):
    sums = table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return files.through_csv(sums, "orders")


@query("SELECT entity, CASE WHEN account > 0 THEN round(account, 6) END AS x FROM nd")
def snk3_json_write(s, d):
    odd = F.when(F.col("account") > 0, F.col("account")).when(F.col("entity") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return files.through_json(ad.nodes(s, d).select("entity", odd.alias("x")), "nodes")


@query("SELECT i, j, round(r, 6) AS w FROM pr WHERE r > 0.2")
def snk4_sparse_write(s, d):
    return files.reread(_strong(s, d), "edges")


@query("SELECT r_name AS region_name, 'The ' || r_name || ' has ' || count(*) || ' nations' AS line FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def snk7_template(s, d):
    counts = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    rows = [(r.r_name, files.rendered("The $name has $n nations", {"name": r.r_name, "n": str(r.n)})) for r in counts.collect()]  # a row per region
    return s.createDataFrame(rows, "region_name string, line string")


@query("SELECT entity, count(*) AS n, round(sum(val_all), 2) AS total FROM pw GROUP BY 1")
def snk8_stage_checkpoint(s, d):
    return files.reread(ad.panel_wide(s, d), "stage").groupBy("entity").agg(F.count("*").alias("n"), F.round(F.sum("val_all"), 2).alias("total"))


# projection and joins


@query("SELECT c_name AS name, c_custkey AS id, c_mktsegment FROM customer")
def prj1_select_rename(s, d):
    return table(s, d, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name"}).drop("c_nationkey", "c_acctbal").select("name", "id", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, round(ln(l_extendedprice), 6) AS lg, round(l_extendedprice / l_quantity, 6) AS unit FROM lineitem")
def prj2_derived(s, d):
    price = F.col("l_extendedprice")
    charge = price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", charge.alias("charge"), F.log(price).alias("lg"), (price / F.col("l_quantity")).alias("unit"))


@query("SELECT CAST(p_partkey AS INT) AS id, CAST(p_size AS BIGINT) AS size, CAST(p_size AS VARCHAR) AS label FROM part")
def prj3_cast(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("int").alias("id"), F.col("p_size").cast("long").alias("size"), F.col("p_size").cast("string").alias("label"))


@query("SELECT r_regionkey, 'highway' AS kind, 1 AS rank FROM region")
def prj4_literal(s, d):
    return table(s, d, "region").select("r_regionkey", F.lit("highway").alias("kind"), F.lit(1).alias("rank"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 6) END AS balance, CASE WHEN s_acctbal < 0 THEN 'masked' ELSE s_name END AS name FROM supplier")
def cnd6_overwrite(s, d):
    bad = F.col("s_acctbal") < 0
    return table(s, d, "supplier").select("s_suppkey", F.when(~bad, F.col("s_acctbal")).alias("balance"), F.when(bad, "masked").otherwise(F.col("s_name")).alias("name"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def jn1_left_validated(s, d):
    return pn.left_one(table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), table(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k").drop("k")


@query(f"SELECT a.entity, arg_min(b.entity, {{'km': {_HAV}, 'id': b.entity}}) AS nearest, round(min({_HAV}), 6) AS km FROM xy a, xy b WHERE a.entity % 10 = 0 AND b.entity % 10 <> 0 GROUP BY 1")
def jn11_nearest_fallback(s, d):
    points, without = _xy(s, d), F.col("entity") % 10 == 0
    return pn.nearest_known(points.filter(without), points.filter(~without))


@query("SELECT o_orderpriority, " + ", ".join(f"round(arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = '{x}'), 6) AS last_{x.lower()}" for x in "FOP") + " FROM orders GROUP BY 1")
def ag10_pivot_last(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", list("FOP")).agg(F.max_by("o_totalprice", "o_orderkey")).withColumnsRenamed({x: f"last_{x.lower()}" for x in "FOP"})


@query("SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS place FROM orders")
def so1_total_sort(s, d):
    return pn.numbered(table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderdate", "o_orderkey"], "place")


_DELTA = ", dl AS (SELECT entity, unnest([" + ", ".join(f"'{x}'" for x in SUFFIXES) + "]) AS part, unnest([" + ", ".join(f"arg_max(clr_{x}, month_idx) - arg_min(clr_{x}, month_idx)" for x in SUFFIXES) + "]) AS x FROM clc GROUP BY entity)"


@query(f"{_DELTA} SELECT entity, string_agg(printf('%s=%+.3f', part, x), '; ' ORDER BY abs(x) DESC, part) AS top FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(x) DESC, part) AS n FROM dl) WHERE n <= 3 GROUP BY 1")
def so5_top_changes(s, d):
    parts = F.array(*[F.struct((-F.abs(f"clr_{x}_delta")).alias("o"), F.lit(x).alias("part"), F.col(f"clr_{x}_delta").alias("x")) for x in SUFFIXES])
    told = F.transform(F.slice(F.array_sort(parts), 1, 3), lambda t: F.format_string("%s=%+.3f", t["part"], t["x"]))
    return pn.node_features(ad.panel_wide(s, d)).select("entity", F.concat_ws("; ", told).alias("top"))


# layers and graphs

_LAYERS = f"{_DIST}, ly AS (SELECT i, j, 1 AS bit FROM pr WHERE r > 0.2 UNION ALL SELECT i, j, 2 FROM pr WHERE r > 0.4 UNION ALL SELECT i, j, 4 FROM ge)"


def _layers(s, d) -> DataFrame:
    pairs = gr.correlated_or_linked(pn.growth(ad.panel_wide(s, d)), "resid", 0.2, ms.geo_layer(_xy(s, d)))
    bits = F.when(F.col("r") > 0.4, 3).when(F.col("r") > 0.2, 1).otherwise(0) + F.when(F.col("w").isNotNull(), 4).otherwise(0)
    return pairs.select("i", "j", bits.alias("mask"))


@query(f"{_LAYERS} SELECT i, j, CAST(sum(bit) AS INT) AS mask, bool_or(bit = 1) AS is_similar, bool_or(bit = 4) AS is_geo FROM ly GROUP BY 1, 2")
def st7_layer_mask(s, d):
    return _layers(s, d).select("i", "j", "mask", (F.col("mask").bitwiseAND(1) > 0).alias("is_similar"), (F.col("mask").bitwiseAND(4) > 0).alias("is_geo"))


@query(f"{_LAYERS}, mk AS (SELECT sum(bit) AS m FROM ly GROUP BY i, j) SELECT round(count(*) FILTER (WHERE m IN (5, 7)) / count(*) FILTER (WHERE m <> 0), 6) AS jaccard, count(*) AS edges FROM mk")
def st6_edge_jaccard(s, d):
    sim, geo = F.col("mask").bitwiseAND(1) > 0, F.col("mask").bitwiseAND(4) > 0
    return _layers(s, d).agg((F.count_if(sim & geo) / F.count_if(sim | geo)).alias("jaccard"), F.count("*").alias("edges"))


_REACH = ", ed AS (SELECT i, j FROM pr WHERE r > 0.5 UNION SELECT j, i FROM pr WHERE r > 0.5), rc(i, j) AS (SELECT i, j FROM ed UNION SELECT rc.i, ed.j FROM rc JOIN ed ON rc.j = ed.i), cm AS (SELECT i AS node, min(j) AS component FROM rc GROUP BY 1)"


@query(f"{_REACH} SELECT node, component FROM cm")
def gr8_connected(s, d):
    return ms.connected(_pairs(s, d).filter("r > 0.5"))


@query(f"{_REACH}, nn AS (SELECT count(*) AS n FROM (SELECT DISTINCT entity FROM gw)), ec AS (SELECT count(*) AS m, avg(CASE WHEN a.region_name = b.region_name THEN 1.0 ELSE 0.0 END) AS w FROM pr JOIN nd a ON a.entity = i JOIN nd b ON b.entity = j WHERE r > 0.5) SELECT n AS nodes, m AS edges, round(2.0 * m / n, 6) AS mean_degree, n - (SELECT count(*) FROM cm) AS isolates, round((SELECT max(c) FROM (SELECT count(*) AS c FROM cm GROUP BY component)) / n, 6) AS giant, round(w, 6) AS within FROM nn, ec")
def gr10_topology(s, d):
    nodes = pn.core(ad.panel_wide(s, d)).select("entity").distinct()
    return gr.topology(nodes, _pairs(s, d).filter("r > 0.5").select("i", "j"), ms.connected(_pairs(s, d).filter("r > 0.5")), ad.nodes(s, d).select("entity", "region_name"))


@query("SELECT i, j, round(CASE WHEN max(r) OVER () > 0 THEN greatest(r, 0) ELSE r - min(r) OVER () END, 6) AS w FROM pr")
def gr11_nonnegative(s, d):
    return gr.nonnegative(_pairs(s, d).withColumnRenamed("r", "w"))


_KEY = "md5(i || '-' || j || '-7')"


@query(f", ed AS (SELECT i, j, r AS w FROM pr WHERE r > 0.4), ct AS (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS k, median(w) AS m FROM ed), kp AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (ORDER BY {_KEY}) AS n FROM ed), ct WHERE n > k), nw AS (SELECT i, j, m AS w FROM (SELECT i, j, row_number() OVER (ORDER BY {_KEY}) AS n FROM pr WHERE r <= 0.4), ct WHERE n <= k) SELECT i, j, round(w, 6) AS w FROM kp UNION ALL SELECT i, j, round(w, 6) FROM nw")
def gr12_perturbed(s, d):
    every = _pairs(s, d)
    return gr.perturbed(every.filter("r > 0.4").select("i", "j", F.col("r").alias("w")), every.filter("r <= 0.4").select("i", "j"), 0.1, 7)


_TOP3 = lambda t: f"SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY r DESC, j) AS n FROM (SELECT i, j, r FROM {t} UNION ALL SELECT j, i, r FROM {t})) WHERE n <= 3"


@query(f", e3 AS ({_TOP3('pr')}), mx AS (SELECT max(r) AS hi, min(r) AS lo FROM pr JOIN e3 USING (i, j)) SELECT i, j, round(CASE WHEN hi > 0 THEN greatest(r, 0) ELSE r - lo END, 6) AS w FROM pr JOIN e3 USING (i, j), mx")
def ms6_similarity_graph(s, d):
    return gr.nearest_graph(gr.nearest_correlated(pn.growth(ad.panel_wide(s, d)), "resid", 3))


_TRIO = f"{_RG}, x2 AS (SELECT a.entity AS i, b.entity AS j, corr(a.g, b.g) AS r FROM rg a JOIN rg b ON a.month_idx = b.month_idx AND a.entity < b.entity GROUP BY 1, 2), cr AS (SELECT entity, month_idx, g - avg(g) OVER (PARTITION BY month_idx % 12) AS c FROM rg), m1 AS (SELECT a.entity AS i, b.entity AS j, corr(a.c, b.c) AS r FROM cr a JOIN cr b ON a.month_idx = b.month_idx AND a.entity < b.entity GROUP BY 1, 2), es AS (SELECT 'M1' AS m, i, j FROM ({_TOP3('m1')}) UNION ALL SELECT 'M2', i, j FROM ({_TOP3('pr')}) UNION ALL SELECT 'X2', i, j FROM ({_TOP3('x2')}))"


@query(f"{_TRIO}, sz AS (SELECT m, count(*) AS n FROM es GROUP BY 1), bt AS (SELECT a.m AS a, b.m AS b, count(*) AS n FROM es a JOIN es b ON a.i = b.i AND a.j = b.j GROUP BY 1, 2) SELECT bt.a, bt.b, round(bt.n / (x.n + y.n - bt.n), 6) AS jaccard FROM bt JOIN sz x ON x.m = bt.a JOIN sz y ON y.m = bt.b")
def ms7_jaccard_table(s, d):
    panel = ad.panel_wide(s, d)
    made = {"M1": gr.correlations(ms.calendar_residual(panel), "resid"), "M2": _pairs(s, d), "X2": gr.correlations(ms.raw_growth(panel), "g")}
    return gr.edge_jaccard({m: gr.undirected(gr.nearest(r, "r", 3)) for m, r in made.items()})


@query("SELECT a.entity AS i, b.entity AS j, round(corr(a.resid, b.resid) FILTER (WHERE a.month_idx % 2 = 1), 6) AS r_odd, round(corr(a.resid, b.resid) FILTER (WHERE a.month_idx % 2 = 0), 6) AS r_even FROM gw a JOIN gw b ON a.month_idx = b.month_idx AND a.entity < b.entity GROUP BY 1, 2")
def ms3_odd_even(s, d):
    month = F.col("month_idx") % 2
    return gr.two_correlations(pn.growth(ad.panel_wide(s, d)), "resid", {"r_odd": month == 1, "r_even": month == 0})


@query("SELECT entity, " + ", ".join(f"round(max(CASE WHEN month_idx = {k} THEN log_all END), 6) AS m{k}" for k in range(24)) + " FROM se GROUP BY 1")
def ms5_aligned_series(s, d):
    return pn.aligned(pn.seasonal(pn.core(ad.panel_wide(s, d))), "log_all")


_M3 = ", " + ", ".join(
    f"c_{x} AS (SELECT entity, month_idx, g - avg(g) OVER (PARTITION BY month_idx) AS e FROM (SELECT entity, month_idx, sa - lag(sa) OVER (PARTITION BY entity ORDER BY month_idx) AS g FROM (SELECT entity, month_idx, ln(greatest(val_{x}, 1.0)) - avg(ln(greatest(val_{x}, 1.0))) OVER (PARTITION BY entity, month_idx % 12) AS sa FROM co)) WHERE g IS NOT NULL), "
    f"q_{x} AS (SELECT a.entity AS i, b.entity AS j, CASE WHEN least(stddev_pop(a.e), stddev_pop(b.e)) > 1e-9 THEN corr(a.e, b.e) ELSE 0 END AS r FROM c_{x} a JOIN c_{x} b ON a.month_idx = b.month_idx AND a.entity < b.entity GROUP BY 1, 2)"
    for x in SUFFIXES[:5]
)


@query(f"{_M3} SELECT i, j, round(tanh(avg(atanh(greatest(least(r, 0.999999), -0.999999)))), 6) AS s FROM (" + " UNION ALL ".join(f"SELECT * FROM q_{x}" for x in SUFFIXES[:5]) + ") GROUP BY 1, 2")
def m3_category_mean(s, d):
    return ms.category_mean(ad.panel_wide(s, d), SUFFIXES[:5])


_M5 = ", mc AS (SELECT entity, " + ", ".join(f"avg(clr_{x}) AS c_{x}" for x in SUFFIXES) + " FROM clc GROUP BY 1), m5 AS (SELECT a.entity AS i, b.entity AS j, -sqrt(" + " + ".join(f"pow(a.c_{x} - b.c_{x}, 2)" for x in SUFFIXES) + ") AS s FROM mc a JOIN mc b ON a.entity < b.entity)"
_PCT = lambda c: f"(rank() OVER (ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY round({c}, 9)) - 1) / 2.0 - 1) / (count(*) OVER () - 1)"


@query(f"{_M5} SELECT i, j, round(0.5 * {_PCT('s')} + 0.5 * {_PCT('r')}, 6) AS s FROM m5 JOIN pr USING (i, j)")
def m9_blend(s, d):
    return ms.blended(ad.panel_wide(s, d), 0.5)


# context


@query(", mi AS (SELECT entity, region_code, CASE WHEN entity % 7 <> 0 THEN lat END AS lat, CASE WHEN entity % 7 <> 0 THEN lon END AS lon FROM xy JOIN nd USING (entity)) SELECT entity, round(coalesce(lat, median(lat) OVER (PARTITION BY region_code), 55.75), 6) AS lat, round(coalesce(lon, median(lon) OVER (PARTITION BY region_code), 37.62), 6) AS lon, lat IS NULL AS filled FROM mi")
def pn9_coordinates(s, d):
    seen = F.col("entity") % 7 != 0
    points = _xy(s, d).select("entity", F.when(seen, F.col("lat")).alias("lat"), F.when(seen, F.col("lon")).alias("lon")).join(ad.nodes(s, d).select("entity", "region_code"), "entity")
    return pn.placed(points, "region_code", 55.75, 37.62).select("entity", "lat", "lon", "filled")


@query(", yt AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) - 150000 AS v FROM orders GROUP BY 1, 2), fv AS (SELECT k, arg_min(v, CASE y WHEN 1997 THEN 0 WHEN 1998 THEN 1 ELSE 2 END) AS v FROM yt WHERE y IN (1996, 1997, 1998) AND v > 0 GROUP BY 1), cx AS (SELECT c_custkey AS customer, c_nationkey AS g, v FROM customer LEFT JOIN fv ON k = c_custkey) SELECT customer, v IS NULL AS missing, round(coalesce(v, median(v) OVER (PARTITION BY g), median(v) OVER ()), 4) AS v FROM cx")
def pn11_year_context(s, d):
    totals = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") - 150000).alias("v"))
    people = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"))
    filled = pn.impute(people.join(pn.first_year(totals, [1997, 1998, 1996]), "k", "left"), "v", "g")
    return filled.select(F.col("k").alias("customer"), F.col("v_missing").alias("missing"), F.round("v", 4).alias("v"))


@query(", cf AS (SELECT 0.5 * (sin(radians(52)) + sin(radians(64))) AS n), cc AS (SELECT n, pow(cos(radians(52)), 2) + 2 * n * sin(radians(52)) AS c FROM cf), pj AS (SELECT entity, n, sqrt(greatest(c - 2 * n * sin(radians(lat)), 0)) / n AS rho, sqrt(c - 2 * n * sin(radians(56))) / n AS rho0, n * radians(lon - 105) AS th FROM xy, cc) SELECT entity, round(rho * sin(th), 6) AS x, round(rho0 - rho * cos(th), 6) AS y FROM pj")
def in14_albers(s, d):
    x, y = fn.albers(F.col("lon"), F.col("lat"), **fn.ALBERS)
    return _xy(s, d).select("entity", x.alias("x"), y.alias("y"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events")
def fn_json(s, d):
    e = table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"), F.json_object_keys("props").alias("k"))
    return e.select("event_id", F.element_at("m", F.get("k", F.lit(0))).alias("first"))


@query("SELECT entity, m['prod'] AS prod, cardinality(m) AS kinds FROM (SELECT entity, map_from_entries(list({'k': part, 'v': n})) AS m FROM (SELECT entity, part, count(*) AS n FROM pl GROUP BY 1, 2) GROUP BY 1)")
def fn_map(s, d):
    n = ad.panel_long(s, d).groupBy("entity", "part").agg(F.count("*").alias("n"))
    m = n.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"))
    return m.select("entity", F.element_at("m", F.lit("prod")).alias("prod"), F.size("m").cast("long").alias("kinds"))


_NAME = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), '\\b0+', '', 'g'))"


@query(f", ca AS (SELECT c_custkey AS a, {_NAME.format('c_name')} AS name FROM customer), sb AS (SELECT s_suppkey AS b, {_NAME.format('s_name')} AS name FROM supplier), mt AS (SELECT a, b, 1 AS how FROM ca JOIN sb USING (name) UNION ALL SELECT a, b, 2 FROM ca JOIN sb ON split_part(ca.name, ' ', 2) = split_part(sb.name, ' ', 2)) SELECT a, b, how FROM mt QUALIFY row_number() OVER (PARTITION BY a ORDER BY how, b) = 1")
def in12_name_match(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("a"), fn.plain_name(F.col("c_name")).alias("name"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("b"), fn.plain_name(F.col("s_name")).alias("name"))
    return pn.cascade(a, b, [lambda c: c, lambda c: F.get(F.split(c, " "), F.lit(1))])


# labels


@query(f", mo AS (SELECT month_idx, type_id AS now, lag(type_id) {_LW} AS ref FROM lb), n AS (SELECT month_idx, now, ref, count(*) AS c FROM mo WHERE ref IS NOT NULL GROUP BY 1, 2, 3) SELECT month_idx, now, ref, c AS shared FROM n QUALIFY row_number() OVER (PARTITION BY month_idx, now ORDER BY c DESC, ref) = 1")
def dy2_align(s, d):
    return dy.aligned_labels(ad.labels_monthly(s, d))


@query("SELECT label, type_id, count(*) AS n, count(DISTINCT entity) AS entities, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS of_label, round(count(*) / sum(count(*)) OVER (PARTITION BY type_id), 6) AS of_type FROM lb JOIN (SELECT entity, region_code % 5 AS label FROM nd) USING (entity) GROUP BY 1, 2")
def dy14_two_way(s, d):
    return dy.two_way(ad.labels_monthly(s, d).join(_label(s, d), "entity"), "label", "type_id")


_MOVE = f", mv AS (SELECT entity, month_idx, abs(clr_prod - lag(clr_prod) {_LW}) AS x FROM clc), tg AS (SELECT entity, month_idx, type_id <> lag(type_id) {_LW} AS changed FROM lb), bo2 AS (SELECT * FROM mv JOIN tg USING (entity, month_idx))"


@query(f"{_MOVE}, th AS (" + " UNION ALL ".join(f"SELECT {q} AS q, quantile_cont(x, {q}) AS t FROM bo2" for q in (0.5, 0.6, 0.7, 0.75, 0.8, 0.9)) + ") SELECT CAST(q AS DOUBLE) AS q, round(t, 6) AS threshold, count(*) FILTER (WHERE changed AND x >= t) AS admitted FROM th, bo2 GROUP BY q, t")
def dy15_sensitivity(s, d):
    p = pn.clr(pn.closed(pn.core(ad.panel_wide(s, d))))
    moved = p.select("entity", "month_idx", F.abs(F.col("clr_prod") - F.lag("clr_prod").over(dy._by())).alias("x"))
    changed = ad.labels_monthly(s, d).select("entity", "month_idx", (F.col("type_id") != F.lag("type_id").over(dy._by())).alias("changed"))
    return dy.sensitivity(moved.join(changed, ["entity", "month_idx"]), "x", "changed", [0.5, 0.6, 0.7, 0.75, 0.8, 0.9])


_CTX = f"{_DIST}, ng AS (SELECT nn.i AS entity, l.month_idx, l.type_id AS k, count(*) AS c FROM nn JOIN lb l ON l.entity = nn.j GROUP BY 1, 2, 3), dm AS (SELECT entity, month_idx, CASE WHEN max(c) >= 0.5 * sum(c) THEN arg_max(k, c * 100 - k) ELSE -1 END AS context FROM ng GROUP BY 1, 2), sx AS (SELECT entity, month_idx, type_id AS type_from, lead(type_id) {_LW} AS type_to FROM lb)"


@query(f"{_CTX} SELECT context, type_from, type_to, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY context, type_from), 6) AS p FROM sx JOIN dm USING (entity, month_idx) WHERE type_to IS NOT NULL GROUP BY 1, 2, 3")
def dy11_spatial_markov(s, d):
    return dy.spatial_markov(ad.labels_monthly(s, d), ms.nearest_by_distance(_xy(s, d)).select("i", "j"))


@query(None)
def dy9_stationary(s, d):
    return dy.stationary(dy.mean_transition(ad.labels_monthly(s, d)))


@query(None)
def dy4_lineage(s, d):
    return dy.lineage(ad.labels_monthly(s, d).select("entity", "month_idx", "type_id"))
