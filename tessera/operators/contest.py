"""Ranking of candidates by weighted legs: verdicts, sensitivity, resampling, paired tests.

Tables of candidates and legs are small by nature (a row per candidate and leg), so windows over all
candidates and the arrays given to the resampling tasks are bounded by the number of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def _all():
    return W.partitionBy(F.lit(0))


def leg_scores(legs: DataFrame) -> DataFrame:
    """leg, candidate, z of (leg, candidate, v): population z-score within the leg, 0 where it is flat."""
    by = W.partitionBy("leg")
    spread = F.stddev_pop("v").over(by)
    return legs.select("leg", "candidate", F.when(spread > 0, (F.col("v") - F.avg("v").over(by)) / spread).otherwise(0.0).alias("z"))


def _weights(weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("leg"))


def composite(z: DataFrame, weights: dict[str, float]) -> DataFrame:
    """candidate, score: weighted sum of the legs that have a weight."""
    return z.withColumn("_w", _weights(weights)).filter("_w is not null").groupBy("candidate").agg(F.sum(F.col("_w") * F.col("z")).alias("score"))


def margin_rule(scores: DataFrame, order: list[str], times: float = 1.0) -> DataFrame:
    """One row (winner, runner_up, margin, se, verdict) of (candidate, score, se): a lead of at least
    ``times`` the leader's se wins, else the earlier of the two in ``order`` does."""
    top = scores.withColumn("_n", F.row_number().over(_all().orderBy(F.desc("score"), "candidate"))).filter("_n <= 2")
    side = lambda k, c: F.max(F.when(F.col("_n") == k, F.col(c)))
    row = top.agg(side(1, "candidate").alias("a"), side(2, "candidate").alias("b"), (side(1, "score") - side(2, "score")).alias("margin"), side(1, "se").alias("se"))
    place = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    wins = F.col("margin") >= times * F.col("se")
    first = wins | (place("a") < place("b"))
    return row.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("runner_up"),
        "margin", "se", F.when(wins, "win").otherwise("tie_tiebreak").alias("verdict"),
    )


def leave_one_leg_out(z: DataFrame, weights: dict[str, float]) -> DataFrame:
    """dropped, winner, changed, photo_finish: the winner without each leg at weights made to sum to
    one again; more than one change of winner is a photo finish. Equal scores: the first name."""
    w = z.withColumn("_w", _weights(weights)).filter("_w is not null")
    drops = w.select(F.col("leg").alias("dropped")).distinct()
    rest = w.join(F.broadcast(drops), F.col("leg") != F.col("dropped"))  # legs times legs
    scored = rest.groupBy("dropped", "candidate").agg((F.sum(F.col("_w") * F.col("z")) / F.sum("_w")).alias("score"))
    best = lambda df, *k: df.groupBy(*k).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "candidate")).alias("m"))
    full = best(composite(z, weights)).select(F.col("m.candidate").alias("full"))
    rows = best(scored, "dropped").crossJoin(F.broadcast(full)).select("dropped", F.col("m.candidate").alias("winner"), (F.col("m.candidate") != F.col("full")).alias("changed"))
    return rows.withColumn("photo_finish", F.sum(F.col("changed").cast("int")).over(_all()) > 1)


def admissible(gate: DataFrame, candidates: list[str], never: list[str]) -> DataFrame:
    """name, scoring, reason of (name, verdict): candidates that passed; the others, and what is only
    an example of the contrary, with the reason."""
    named = gate.filter(F.col("name").isin(candidates + never))
    anti, passed = F.col("name").isin(never), F.col("verdict") == "pass"
    reason = F.when(~F.col("name").isin(candidates), "anti_example").when(~F.coalesce(passed, F.lit(False)), "failed admissibility").when(anti, "anti_example")
    return named.select("name", reason.isNull().alias("scoring"), reason.alias("reason"))


def method_scores(methods: DataFrame, weights: dict[str, float], sub: dict[str, float]) -> DataFrame:
    """method, with_zero, renormalised: weighted z-scores of accuracy, stability (half the bootstrap
    agreement, half less the spread over seeds), the validity indices and speed (less log seconds).
    Interpretability is not there: its leg counts as zero, or the other weights are made to sum to one."""

    def z(x: Column) -> Column:
        spread = F.stddev_pop(x).over(_all())
        return F.when(spread > 0, (x - F.avg(x).over(_all())) / spread).otherwise(0.0)

    col = F.col
    legs = methods.select(
        "method", col("nmi").alias("nmi"), (0.5 * z(col("boot")) - 0.5 * z(col("iqr"))).alias("stability"), (-F.log("seconds")).alias("speed"),
        ((sub["sw"] * z(col("sw")) + sub["ch"] * z(col("ch")) - sub["sdbw"] * z(col("sdbw")) + sub["mq"] * z(col("mq"))) / weights["validity"]).alias("validity"),
    )
    score = sum(weights[c] * z(col(c)) for c in ("nmi", "stability", "validity", "speed"))
    return legs.select("method", score.alias("with_zero"), (score / (1 - weights["interpretability"])).alias("renormalised"))


def dirichlet_sensitivity(z: DataFrame, weights: dict[str, float], concentration: float = 100.0, draws: int = 2000, seed: int = 0) -> DataFrame:
    """candidate, p_top1, p_top2: how often a candidate is first, or among the first two, under weights
    drawn about the given ones. Every draw has its own generator, so any task can make it again."""
    legs = sorted(weights)
    table = z.filter(F.col("leg").isin(legs)).toPandas().pivot(index="candidate", columns="leg", values="z").reindex(columns=legs).fillna(0.0).sort_index()
    names, grid, mean = list(table.index), table.to_numpy(), np.array([weights[x] for x in legs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d in pdf["id"]:
                score = grid @ np.random.default_rng([seed, int(d)]).dirichlet(concentration * mean)
                out += [(names[k], int(n == 0)) for n, k in enumerate(np.argsort(-score, kind="stable")[:2])]
            yield pd.DataFrame(out, columns=["candidate", "first"])

    spark = z.sparkSession
    hits = spark.range(draws).mapInPandas(run, "candidate string, first int").groupBy("candidate").agg((F.sum("first") / draws).alias("p_top1"), (F.count("*") / draws).alias("p_top2"))
    return z.select("candidate").distinct().join(hits, "candidate", "left").fillna(0.0)


def paired_bootstrap(points: DataFrame, replicas: DataFrame, weights: dict[str, float], draws: int = 1000, seed: int = 0) -> DataFrame:
    """candidate, se_diff, ci_lo, ci_hi, p_beats: composites of resampled replicas (leg, candidate, rep,
    v) against the runner-up of the points (leg, candidate, v). A leg's resampled replicas are the same
    for all candidates; legs without replicas stay as they are."""
    legs = sorted(weights)
    base = points.filter(F.col("leg").isin(legs)).toPandas().pivot(index="candidate", columns="leg", values="v").reindex(columns=legs).sort_index()
    names, mean, value = list(base.index), np.array([weights[x] for x in legs]), base.to_numpy(float)
    held = {leg: t.pivot(index="candidate", columns="rep", values="v").reindex(names).to_numpy(float) for leg, t in replicas.filter(F.col("leg").isin(legs)).toPandas().groupby("leg")}

    def score(v: np.ndarray) -> np.ndarray:
        spread = v.std(axis=0)
        return np.divide(v - v.mean(axis=0), spread, out=np.zeros_like(v), where=spread > 0) @ mean

    runner = names[np.argsort(-score(value), kind="stable")[min(1, len(names) - 1)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d in pdf["id"]:
                rng, v = np.random.default_rng([seed, int(d)]), value.copy()
                for leg, t in held.items():
                    v[:, legs.index(leg)] = t[:, rng.integers(0, t.shape[1], t.shape[1])].mean(axis=1)
                s = score(v)
                out += [(n, float(x), float(x - s[names.index(runner)])) for n, x in zip(names, s, strict=True)]
            yield pd.DataFrame(out, columns=["candidate", "score", "diff"])

    drawn = points.sparkSession.range(draws).mapInPandas(run, "candidate string, score double, diff double")
    return drawn.groupBy("candidate").agg(
        F.stddev_samp("diff").alias("se_diff"), F.percentile("score", F.lit(0.025)).alias("ci_lo"), F.percentile("score", F.lit(0.975)).alias("ci_hi"),
        F.avg((F.col("diff") > 0).cast("double")).alias("p_beats"),
    )


def signed_ranks(scores: DataFrame) -> DataFrame:
    """a, b, stat, n, n_common, ties of (method, rep, v), a < b: the smaller sum of signed ranks over
    common replicas without their zero differences (n of them); ties is the sum of t^3 - t."""
    x, y = (scores.select("rep", F.col("method").alias(m), F.col("v").alias(v)) for m, v in (("a", "x"), ("b", "y")))
    d = x.join(y, "rep").filter("a < b and x is not null and y is not null").withColumn("d", F.round(F.col("x") - F.col("y"), 12))
    pair, tied = W.partitionBy("a", "b", "_zero"), W.partitionBy("a", "b", "_zero", F.abs("d"))
    r = d.withColumn("_zero", F.col("d") == 0).withColumn("_c", F.count("*").over(tied)).withColumn("_r", F.rank().over(pair.orderBy(F.abs("d"))) + (F.col("_c") - 1) / 2)
    some = ~F.col("_zero")
    side = lambda c: F.sum(F.when(c, F.col("_r")).otherwise(0.0))
    return r.groupBy("a", "b").agg(
        F.least(side(some & (F.col("d") > 0)), side(some & (F.col("d") < 0))).alias("stat"), F.count_if(some).alias("n"), F.count("*").alias("n_common"),
        F.sum(F.when(some, F.col("_c") * F.col("_c") - 1.0).otherwise(0.0)).alias("ties"),
    )


def signed_rank_p(stat: float, n: int, n_common: int, ties: float) -> float | None:
    """Two-sided p: exact up to 50 differences without ties or zeros, else normal; 1 where all
    differences are zero, undefined below 5 replicas."""
    if n_common < 5:
        return None
    if n == 0:
        return 1.0
    if n <= 50 and n == n_common and ties == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(stat) + 1]) / 2**n)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return math.erfc(abs(stat - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


def wilcoxon(scores: DataFrame) -> DataFrame:
    """a, b, stat, n_common, p, p_adj (step-up over the defined p) of (method, rep, v)."""

    @F.pandas_udf("double")
    def p_of(stat: pd.Series, n: pd.Series, common: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(s, int(k), int(c), t) for s, k, c, t in zip(stat, n, common, ties, strict=True)], dtype="float64")

    few = F.col("n_common") < 5
    tested = signed_ranks(scores).withColumn("p", F.when(~few, p_of("stat", "n", "n_common", "ties")))
    ranked = W.partitionBy(F.col("p").isNull())  # a row per pair of methods
    adj = tested.withColumn("_q", F.col("p") * F.count("p").over(ranked) / F.row_number().over(ranked.orderBy("p", "a", "b")))
    adj = adj.withColumn("p_adj", F.when(~few, F.least(F.min("_q").over(ranked.orderBy(F.desc("p"), F.desc("a"), F.desc("b"))), F.lit(1.0))))
    return adj.select("a", "b", F.when(~few, F.col("stat")).alias("stat"), "n_common", "p", "p_adj")


def cluster_count(table: DataFrame, least: float = 0.9) -> DataFrame:
    """One row (k, veto_failed) of (k, ari_med, sdbw): the least sdbw among stable counts, or the most
    stable count and the flag where none is stable. Equal values: the smaller count."""
    stable = F.col("ari_med") >= least
    row = table.agg(F.min(F.when(stable, F.struct("sdbw", "k"))).alias("a"), F.min(F.struct((-F.col("ari_med")).alias("n"), "k")).alias("b"))
    return row.select(F.coalesce("a.k", "b.k").alias("k"), F.col("a").isNull().alias("veto_failed"))
