"""Positions inside a type, scoring metrics, agreement of descriptions, switches."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import graph as gr
from tessera.operators import measures as ms
from tessera.operators import panel as pn
from tessera.operators import ranks
from tessera.sources import files


def position(rows: DataFrame, columns: list[str]) -> DataFrame:
    """entity, month_idx, dist_own, margin, rank_own: distance to the median of the type's others in
    the month, what it is beyond the nearest other type's median (null without one), and its average
    rank in the type from 0 to 1. Distances are compared to nine places; one alone has distance 0."""
    long = files.reread(rows.unpivot(["entity", "month_idx", "type_id"], columns, "part", "x"), "positions")
    cell = F.concat_ws("/", "month_idx", "type_id", "part")
    loo = ms.leave_one_out_median(long.withColumn("_cell", cell), "x", "_cell")
    gap = F.col("x") - F.coalesce("loo", "x")
    own = loo.groupBy("entity", "month_idx", "type_id").agg(F.round(F.sqrt(F.sum(gap * gap)), 9).alias("dist_own"))
    centres = long.groupBy("month_idx", F.col("type_id").alias("_t"), "part").agg(F.median("x").alias("c"))
    far = long.join(centres, ["month_idx", "part"]).filter("_t <> type_id")  # a row per month, type and part
    to = far.groupBy("entity", "month_idx", "_t").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("o"))
    other = to.groupBy("entity", "month_idx").agg(F.min("o").alias("o"))
    by = W.partitionBy("month_idx", "type_id")
    rank = F.rank().over(by.orderBy("dist_own")) + (F.count("*").over(W.partitionBy("month_idx", "type_id", "dist_own")) - 1) / 2 - 1
    out = own.withColumn("rank_own", rank / F.greatest(F.count("*").over(by) - 1, F.lit(1)))
    return out.join(other, ["entity", "month_idx"], "left").select("entity", "month_idx", "dist_own", (F.col("dist_own") - F.col("o")).alias("margin"), "rank_own")


def precision_lift(rows: DataFrame, y: str, p: str, share: float = 0.1) -> DataFrame:
    """One row: average precision (equal scores are one threshold), and the rate of the first ``share``
    of the rows, by score then entity and month, over the rate of all."""
    lower = rows.withColumn("_v", -F.col(p))
    every = ranks.cumulative(lower, "_v").select("v", F.col("up").alias("seen"))
    hits = ranks.cumulative(lower.filter(F.col(y) == 1), "_v")
    ap = hits.join(every, "v").agg((F.sum(F.col("c") * F.col("up") / F.col("seen")) / F.max("n")).alias("average_precision"))
    order = pn.numbered(lower, ["_v", "entity", "month_idx"], "_k")
    total = F.broadcast(rows.agg(F.count("*").alias("_n"), F.avg(y).alias("_rate")))
    top = order.crossJoin(total).filter(F.col("_k") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(1)))
    return ap.crossJoin(top.agg(F.try_divide(F.avg(y), F.max("_rate")).alias("lift")))


def quantiles(rows: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """(k, q): linear quantiles of a column by running counts, so no task sorts or holds it all."""
    table = ranks.cumulative(rows, value)
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("at")) for k, x in enumerate(grid)]))
    size = table.select("n").limit(1).select(F.col("n").alias("_all"), marks.alias("_m"))
    at = size.select("_m.k", (F.col("_m.at") * (F.col("_all") - 1)).alias("w"))
    ends = at.select("k", "w", F.explode(F.array(F.floor("w"), F.ceil("w"))).alias("e")).distinct()  # two rows a quantile
    found = table.join(F.broadcast(ends), (F.col("e") >= F.col("up") - F.col("c")) & (F.col("e") < F.col("up")))
    part = F.col("w") - F.floor("w")
    return found.groupBy("k").agg((F.min_by("v", "e") + F.max(part) * (F.max_by("v", "e") - F.min_by("v", "e"))).alias("q"))


def calibration_curve(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_pred, frac_pos: bins between the quantiles of the score, empty ones left out; a
    score equal to an edge is in the upper bin."""
    edges = quantiles(rows, p, [k / bins for k in range(1, bins)]).agg(F.collect_list(F.round("q", 12)).alias("_q"))  # bins - 1 values
    b = F.size(F.filter("_q", lambda q: q <= F.col(p))).cast("long")
    return rows.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("frac_pos"))


def agreement(table: DataFrame, columns: list[str]) -> DataFrame:
    """type_id, pair, spearman, kendall (tau-b), jaccard_top3, jaccard_top5 of descriptions of a type's
    parts: one row a type and part, a column a description. Equal values: the first part's name."""
    of = W.partitionBy("type_id")
    rank = {c: F.rank().over(of.orderBy(c)) + (F.count("*").over(W.partitionBy("type_id", c)) - 1) / 2 for c in columns}
    place = {c: F.row_number().over(of.orderBy(F.desc(c), "part")) for c in columns}
    ranked = table.withColumns({f"_r{c}": x for c, x in rank.items()} | {f"_t{c}": x for c, x in place.items()})
    a = table.select("type_id", F.col("part").alias("_p"), *[F.col(c).alias(f"_a{c}") for c in columns])
    both = table.join(a, "type_id").filter("part < _p")  # parts times parts of one type
    out = []
    for x, y in combinations(columns, 2):
        sx, sy = F.signum(F.col(x) - F.col(f"_a{x}")), F.signum(F.col(y) - F.col(f"_a{y}"))
        tau = both.groupBy("type_id").agg(F.try_divide(F.sum(sx * sy), F.sqrt(F.sum(F.abs(sx)) * F.sum(F.abs(sy)))).alias("kendall"))

        def top(k: int, x: str = x, y: str = y):
            one, two = F.col(f"_t{x}") <= k, F.col(f"_t{y}") <= k
            return (F.count_if(one & two) / F.count_if(one | two)).alias(f"jaccard_top{k}")

        rows = ranked.groupBy("type_id").agg(F.corr(f"_r{x}", f"_r{y}").alias("spearman"), top(3), top(5)).join(tau, "type_id")
        out.append(rows.select("type_id", F.lit(f"{x}_{y}").alias("pair"), "spearman", "kendall", "jaccard_top3", "jaccard_top5"))
    return reduce(DataFrame.unionByName, out)


def agreement_verdict(pairs: DataFrame, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """type_id, score (mean of half the rank correlation and half the overlap of five), verdict."""
    s = pairs.groupBy("type_id").agg(F.round(F.avg(0.5 * F.col("spearman") + 0.5 * F.col("jaccard_top5")), 9).alias("score"))
    verdict = F.when(F.col("score") <= low, "disputed").when(F.col("score") <= high, "core agreed").when(F.col("score") > high, "consistent")
    return s.withColumn("verdict", verdict)


def inverse_law(types: DataFrame, rising: str, falling: str) -> DataFrame:
    """One row: types, rank correlation (null up to two types), whether ``falling`` never grows with
    ``rising``. A row per type."""
    order = W.partitionBy(F.lit(0)).orderBy(rising)
    r = types.withColumns({"_a": F.rank().over(order), "_b": F.rank().over(W.partitionBy(F.lit(0)).orderBy(falling)), "_before": F.lag(falling).over(order)})
    rho = F.when(F.count("*") > 2, F.corr("_a", "_b"))
    return r.agg(F.count("*").alias("n_types"), rho.alias("spearman"), F.coalesce(F.every(F.col(falling) <= F.col("_before")), F.lit(True)).alias("monotone"))


def listed_against_rest(rows: DataFrame, listed: DataFrame, value: str) -> DataFrame:
    """One row: entities on the list, their median, the rest's, and the share of the listed above the
    rest's upper quartile."""
    inside, rest = rows.join(listed, "entity", "left_semi"), rows.join(listed, "entity", "left_anti")
    edge = F.broadcast(rest.agg(F.median(value).alias("median_rest"), F.percentile(value, F.lit(0.75)).alias("_q")))
    one = inside.crossJoin(edge).agg(F.avg((F.col(value) > F.col("_q")).cast("double")).alias("share_above_q75"))
    return inside.agg(F.count("*").alias("n_listed"), F.median(value).alias("median_listed")).crossJoin(edge.select("median_rest")).crossJoin(one)


def nmi_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, nmi (never below 0, whatever the rounding) of every two labellings, with the median, least
    and greatest of all."""
    pairs = [gr.agreement(rows, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col("nmi") <= 0, 0.0).otherwise(F.col("nmi")).alias("nmi")) for a, b in combinations(columns, 2)]
    every = W.partitionBy(F.lit(0))  # a row per two labellings
    return reduce(DataFrame.unionByName, pairs).withColumns({"median": F.median("nmi").over(every), "least": F.min("nmi").over(every), "most": F.max("nmi").over(every)})


def publish(scores: DataFrame, best: str = "boosted", simple: str = "margin_rank", linear: str = "logistic") -> DataFrame:
    """One row: the simple model is published unless the best one beats it; whether the linear one
    beats the best. A row (model, pr_auc) per model."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("pr_auc")))
    row = scores.agg((of(best) > of(simple)).alias("beats_margin"), (of(linear) > of(best)).alias("logistic_wins"))
    return row.select(F.lit(best).alias("ranking"), F.when(F.col("beats_margin"), best).otherwise(simple).alias("publish"), "beats_margin", "logistic_wins")


def switch_f1(labels: DataFrame, true: str, found: str, window: int = 1) -> DataFrame:
    """One row (hits, n_true, n_found, f1): months where a label changes; each true change, in order,
    takes the nearest free found change at most ``window`` months off, the earlier of two. f1 is null
    without true changes. The months of one entity are a group."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_idx")
        month = pdf["month_idx"].to_numpy()
        at = [month[1:][pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1]].tolist() for c in (true, found)]
        free, hits = list(at[1]), 0
        for m in at[0]:
            near = [(abs(t - m), t) for t in free if abs(t - m) <= window]
            if near:
                free.remove(min(near)[1])
                hits += 1
        return pd.DataFrame({"hits": [hits], "n_true": [len(at[0])], "n_found": [len(at[1])]})

    per = labels.select("entity", "month_idx", true, found).groupBy("entity").applyInPandas(match, "hits long, n_true long, n_found long")
    sums = per.agg(*[F.sum(c).alias(c) for c in ("hits", "n_true", "n_found")])
    return sums.withColumn("f1", F.when(F.col("n_true") > 0, 2 * F.col("hits") / (F.col("n_true") + F.col("n_found"))))
