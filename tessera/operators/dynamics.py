"""Label dynamics: smoothing, transitions, order test, events, targets, convergence."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import ranks
from tessera.operators.cluster import assignment


def _by():
    return W.partitionBy("entity").orderBy("month_idx")


def smoothed(labels: DataFrame) -> DataFrame:
    """Majority of three months; ties keep the own label, so only A B A changes."""
    a, c = F.lag("type_id").over(_by()), F.lead("type_id").over(_by())
    return labels.withColumn("type_id_smooth", F.when(a == c, a).otherwise(F.col("type_id")))


def flicker_share(labels: DataFrame) -> DataFrame:
    a, b, c = F.lag("type_id").over(_by()), F.col("type_id"), F.lead("type_id").over(_by())
    rows = labels.select(a.alias("a"), b.alias("b"), c.alias("c")).filter("a is not null and c is not null")
    return rows.agg(F.avg(((F.col("a") != F.col("b")) & (F.col("b") == F.col("c"))).cast("double")).alias("flicker"))


def transitions(labels: DataFrame, column: str = "type_id") -> DataFrame:
    """month_idx, type_from, type_to, n_movers, n_base, with zero cells."""
    nxt = F.lead(column).over(_by())
    step = labels.select("month_idx", F.col(column).alias("type_from"), nxt.alias("type_to")).filter("type_to is not null")
    ids = step.select(F.col("type_from").alias("k")).union(step.select("type_to")).distinct()
    grid = step.select("month_idx").distinct().crossJoin(F.broadcast(ids.withColumnRenamed("k", "type_from"))).crossJoin(F.broadcast(ids.withColumnRenamed("k", "type_to")))
    n = step.groupBy("month_idx", "type_from", "type_to").agg(F.count("*").alias("n_movers"))
    full = grid.join(n, ["month_idx", "type_from", "type_to"], "left").fillna(0, ["n_movers"])
    return full.withColumn("n_base", F.sum("n_movers").over(W.partitionBy("month_idx", "type_from")))


def mean_transition(labels: DataFrame) -> DataFrame:
    """type_from, type_to, p: counts over all months, rows without departures left out."""
    n = transitions(labels).groupBy("type_from", "type_to").agg(F.sum("n_movers").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("type_from"))
    return n.withColumn("b", F.sum("n").over(W.partitionBy("type_from"))).filter("b > 0").select("type_from", "type_to", p.alias("p"))


def order_test(labels: DataFrame) -> DataFrame:
    """Likelihood ratio of second- against first-order dependence and its degrees of freedom."""
    rows = labels.select(F.lag("type_id").over(_by()).alias("h"), F.col("type_id").alias("i"), F.lead("type_id").over(_by()).alias("j")).filter("h is not null and j is not null")
    n = rows.groupBy("h", "i", "j").agg(F.count("*").cast("double").alias("n"))
    hi, ij, i = W.partitionBy("h", "i"), W.partitionBy("i", "j"), W.partitionBy("i")
    ratio = (F.col("n") / F.sum("n").over(hi)) / (F.sum("n").over(ij) / F.sum("n").over(i))
    k = rows.agg(F.countDistinct("i").alias("k"))
    return n.withColumn("x", 2 * F.col("n") * F.log(ratio)).agg(F.sum("x").alias("lr")).crossJoin(k).select("lr", (F.col("k") * F.pow(F.col("k") - 1, 2)).cast("int").alias("df"))


def targets(labels: DataFrame, horizon: int = 3) -> DataFrame:
    """y: any change in the next ``horizon`` months; null where they cannot be seen."""
    ahead = [F.lead("type_id", k).over(_by()) for k in range(1, horizon + 1)]
    seen = ahead[-1].isNotNull()
    changed = F.greatest(*[(x != F.col("type_id")).cast("int") for x in ahead]) if horizon > 1 else (ahead[0] != F.col("type_id")).cast("int")
    return labels.select("entity", "month_idx", F.when(seen, changed).alias("y"))


def jaccard(labels: DataFrame) -> DataFrame:
    """month_idx, a, b, jaccard of the members of group a this month and b next month."""
    step = labels.select("entity", "month_idx", F.col("type_id").alias("a"), F.lead("type_id").over(_by()).alias("b")).filter("b is not null")
    n = step.groupBy("month_idx", "a", "b").agg(F.count("*").alias("n"))
    wa, wb = W.partitionBy("month_idx", "a"), W.partitionBy("month_idx", "b")
    return n.withColumn("jaccard", F.col("n") / (F.sum("n").over(wa) + F.sum("n").over(wb) - F.col("n"))).drop("n")


def gini(rows: DataFrame, value: str, group: str) -> DataFrame:
    w = W.partitionBy(group).orderBy(value)
    r = rows.withColumn("_r", F.row_number().over(w))
    n, total = F.count("*"), F.sum(value)
    return r.groupBy(group).agg((2 * F.sum(F.col("_r") * F.col(value)) / (n * total) - (n + 1) / n).alias("gini"))


def cross_sectional_h(series: DataFrame, value: str) -> DataFrame:
    """H_t: mean squared distance of the series' ratio to their mean from one."""
    ratio = F.col(value) / F.avg(value).over(W.partitionBy("month_idx")) - 1
    return series.withColumn("_d", ratio * ratio).groupBy("month_idx").agg(F.avg("_d").alias("h"))


def sigma_trend(series: DataFrame, value: str) -> DataFrame:
    """Slope of the log dispersion over time, and first and last coefficient of variation."""
    cv = series.groupBy("month_idx").agg((F.stddev_pop(value) / F.avg(value)).alias("cv"))
    return cv.agg(F.regr_slope(F.log("cv"), F.col("month_idx").cast("double")).alias("slope"), F.min_by("cv", "month_idx").alias("cv_first"), F.max_by("cv", "month_idx").alias("cv_last"))


def beta(series: DataFrame, value: str) -> DataFrame:
    """Slope of monthly growth on the initial level."""
    months = F.max("month_idx") - F.min("month_idx")
    g = series.groupBy("entity").agg(F.min_by(value, "month_idx").alias("x0"), ((F.max_by(value, "month_idx") - F.min_by(value, "month_idx")) / months).alias("d"))
    return g.agg(F.regr_slope("d", "x0").alias("beta"), F.count("*").alias("n"))


def kruskal(rows: DataFrame, value: str, group: str) -> DataFrame:
    """H with tie correction, and eta squared."""
    table = ranks.cumulative(rows, value, "_v").select("_v", F.col("c").alias("t"), (F.col("up") - (F.col("c") - 1) / 2).alias("rank"))
    tie = table.agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"), F.sum("t").cast("double").alias("n"))
    per = rows.join(table, F.col(value) == F.col("_v")).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("m"))
    s = per.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("k")).crossJoin(tie)
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, 3) - n))
    return s.select(h.alias("h"), ((h - F.col("k") + 1) / (n - F.col("k"))).alias("eta2"))


def aligned_labels(labels: DataFrame) -> DataFrame:
    """month_idx, now, ref, shared: for each label of a month the label of the month before with
    the most common members, the smaller on ties."""
    step = labels.select("month_idx", F.col("type_id").alias("now"), F.lag("type_id").over(_by()).alias("ref")).filter("ref is not null")
    n = step.groupBy("month_idx", "now", "ref").agg(F.count("*").alias("c"))
    best = n.groupBy("month_idx", "now").agg(F.min(F.struct((-F.col("c")).alias("o"), "ref")).alias("b"))
    return best.select("month_idx", "now", "b.ref", (-F.col("b.o")).alias("shared"))


def two_way(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts, distinct entities and the shares of each cell in its row and its column."""
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))
    share = lambda k: F.col("n") / F.sum("n").over(W.partitionBy(k))
    return n.withColumns({f"of_{'label' if a == 'label' else a}": share(a), f"of_{'type' if b == 'type_id' else b}": share(b)})


def sensitivity(rows: DataFrame, value: str, event: str, grid: list[float]) -> DataFrame:
    """q, threshold, admitted: events at or above each quantile of ``value``."""
    cuts = rows.agg(F.percentile(value, F.array(*map(F.lit, grid))).alias("t"))
    q = cuts.select(F.explode(F.arrays_zip(F.array(*map(F.lit, grid)).alias("q"), F.col("t"))).alias("z")).select("z.q", F.col("z.t").alias("threshold"))
    return rows.crossJoin(F.broadcast(q)).groupBy("q", "threshold").agg(F.count_if(F.col(event) & (F.col(value) >= F.col("threshold"))).alias("admitted"))


def spatial_markov(labels: DataFrame, near: DataFrame, share: float = 0.5) -> DataFrame:
    """context, type_from, type_to, n, p: transitions by the type that at least ``share`` of an
    entity's neighbours have (the smaller on ties), -1 where none does."""
    their = labels.select(F.col("entity").alias("j"), "month_idx", F.col("type_id").alias("k"))
    n = near.join(their, "j").groupBy(F.col("i").alias("entity"), "month_idx", "k").agg(F.count("*").alias("c"))
    top = n.groupBy("entity", "month_idx").agg(F.min(F.struct((-F.col("c")).alias("o"), "k")).alias("t"), F.sum("c").alias("all"))
    context = top.select("entity", "month_idx", F.when(-F.col("t.o") >= share * F.col("all"), F.col("t.k")).otherwise(-1).alias("context"))
    step = labels.select("entity", "month_idx", F.col("type_id").alias("type_from"), F.lead("type_id").over(_by()).alias("type_to")).filter("type_to is not null")
    cells = step.join(context, ["entity", "month_idx"]).groupBy("context", "type_from", "type_to").agg(F.count("*").alias("n"))
    return cells.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("context", "type_from")))


def stationary(mean: DataFrame, damping: float = 0.99) -> DataFrame:
    """type_from, type_to, pi (of type_to), passage (mean steps from one to the other), regularised.

    The chain has a row per type, so it is solved on the driver. A chain with a state nobody enters,
    or without a solution of positive shares, is mixed with a uniform restart."""
    cells = {(r.type_from, r.type_to): r.p for r in mean.collect()}
    ids = sorted({a for a, _ in cells})
    p = np.array([[cells.get((a, b), 0.0) for b in ids] for a in ids])
    p /= p.sum(axis=1, keepdims=True)

    def solved(q: np.ndarray) -> np.ndarray:
        k = len(q)
        return np.linalg.lstsq(np.vstack([q.T - np.eye(k), np.ones(k)]), np.append(np.zeros(k), 1.0), rcond=None)[0]

    pi = solved(p)
    mixed = bool((p.sum(axis=0) == 0).any() or (pi <= 1e-12).any())
    if mixed:
        p = damping * p + (1 - damping) / len(p)
        pi = solved(p)
    z = np.linalg.inv(np.eye(len(p)) - p + pi[None, :])
    steps = (np.diag(z)[None, :] - z) / pi[None, :] + np.diag(1 / pi)
    rows = [(a, b, float(pi[j]), float(steps[i, j]), mixed) for i, a in enumerate(ids) for j, b in enumerate(ids)]
    return mean.sparkSession.createDataFrame(rows, "type_from int, type_to int, pi double, passage double, regularised boolean")


def _cells(labels: DataFrame) -> list[tuple]:
    """(month, label before, label now, members) of neighbouring months: contingency counts."""
    step = labels.select(F.col("month_idx").alias("m"), F.lag("type_id").over(_by()).alias("a"), F.col("type_id").alias("b"))
    return [tuple(r) for r in step.groupBy("m", "a", "b").agg(F.count("*").alias("n")).orderBy("m", "a", "b").collect()]


def lineage(labels: DataFrame, inherit: float = 0.3, split: float = 0.15) -> DataFrame:
    """Registry of identities that labels of a month keep over time: type_id, birth_month,
    death_month, parent_id, merged_into, lifetime, members (JSON by month).

    Spark counts who goes from which label to which; the chain of months is walked on the driver
    over these counts, a few numbers a month. Labels of neighbouring months are paired one to one at
    the least sum of 1 - Jaccard; a pair of at least ``inherit`` keeps its identity. An identity
    without a pair that overlaps a kept label by ``split`` merges (the largest takes the label, the
    smaller number on ties); otherwise it ends. A label without an identity is born, with the
    identity of its largest kept overlap of ``split`` as its parent. Ended identities stay so."""
    by_month: dict[int, dict[tuple[int | None, int], int]] = {}
    for m, a, b, n in _cells(labels):
        by_month.setdefault(m, {})[a, b] = n
    months, registry, counts = sorted(by_month), [], {}

    def born(month: int, parent: int | None) -> int:
        registry.append({"birth_month": month, "death_month": None, "parent_id": parent, "merged_into": None})
        return len(registry) - 1

    def end(identity: int, month: int, into: int | None = None) -> None:
        if registry[identity]["death_month"] is None:
            registry[identity].update(death_month=month, merged_into=into)

    name: dict[int, int] = {}
    for t, month in enumerate(months):
        cell = by_month[month]
        now = sorted({b for _, b in cell})
        size_now = {b: sum(n for (_, y), n in cell.items() if y == b) for b in now}
        if t == 0:
            name = {b: born(month, None) for b in now}
        else:
            last = months[t - 1]
            before = {a: i for a, i in name.items()}
            identities = sorted(set(before.values()))
            size = {i: counts[last, i] for i in identities}
            common = {(i, b): sum(n for (a, y), n in cell.items() if y == b and a is not None and before.get(a) == i) for i in identities for b in now}
            j = {k: n / (size[k[0]] + size_now[k[1]] - n) if n else 0.0 for k, n in common.items()}
            cost = np.array([[1 - j[i, b] for b in now] for i in identities])
            kept = {now[c]: identities[r] for r, c in assignment(cost) if j[identities[r], now[c]] >= inherit}
            taken = set(kept.values())
            for b in list(kept):
                if registry[kept[b]]["merged_into"] is not None:
                    continue
                others = [i for i in identities if i not in taken and registry[i]["merged_into"] is None and j[i, b] >= split]
                if others:
                    family = [kept[b], *others]
                    largest = min(family, key=lambda i: (-size[i], i))
                    for i in family:
                        if i != largest:
                            end(i, last, largest)
                            taken.discard(i)
                    kept[b] = largest
                    taken.add(largest)
            for i in identities:
                if i not in taken:
                    end(i, last)
            for b in now:
                if b not in kept:
                    near = sorted((i for i in identities if i in taken and registry[i]["death_month"] is None and j[i, b] >= split), key=lambda i: (-common[i, b], i))
                    kept[b] = born(month, near[0] if near else None)
            name = kept
        for b in now:
            counts[month, name[b]] = counts.get((month, name[b]), 0) + size_now[b]
    rows = []
    for i, r in enumerate(registry):
        seen = {str(m): n for (m, k), n in sorted(counts.items()) if k == i}
        rows.append((i, r["birth_month"], r["death_month"], r["parent_id"], r["merged_into"], len(seen), json.dumps(seen)))
    return labels.sparkSession.createDataFrame(rows, "type_id int, birth_month int, death_month int, parent_id int, merged_into int, lifetime int, members string")
