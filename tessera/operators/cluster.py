"""Graph clustering fan-out: Louvain-style local moving per seed, and their co-association."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as gr
from tessera.sources import files


def moved_to(v: int, to: np.ndarray, group: np.ndarray, volume: np.ndarray, strength: np.ndarray, total: float, gamma: float) -> bool:
    """Put v into the group of most gain, given its weight ``to`` each; whether that is another one."""
    own = group[v]
    volume[own] -= strength[v]
    best, gain = own, (to[own] if own < len(to) else 0.0) - gamma * strength[v] * volume[own] / total
    held = np.flatnonzero(to)
    now = to[held] - gamma * strength[v] * volume[held] / total
    better = np.flatnonzero(now > gain + 1e-12)
    while len(better):  # as if the groups were tried one by one
        best, gain = held[better[0]], now[better[0]]
        better = better[now[better] > gain + 1e-12]
    volume[best] += strength[v]
    group[v] = best
    return best != own


def louvain(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, seed: int | np.random.Generator, gamma: float = 1.0) -> np.ndarray:
    """Labels 0.. of n nodes: local moving on modularity at resolution gamma, then aggregation,
    until no node moves."""
    rng, member = np.random.default_rng(seed), np.arange(n)  # a generator goes on as it is
    while True:
        # neighbours of each node in one array, in the order of the edges
        loop = i == j
        ends = np.stack([i, j], axis=1).ravel()
        order = np.argsort(ends, kind="stable")
        near, weight = np.stack([j, i], axis=1).ravel()[order].astype(np.int32), np.repeat(w, 2)[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
        strength = np.bincount(ends, weights=np.repeat(w, 2), minlength=n)
        total, group, moved = strength.sum(), np.arange(n), False
        if not total:
            break
        if loop.any():
            weight[near == ends[order]] = 0.0  # a node's own weight does not pull it
        del ends, order, loop
        volume = strength.copy()
        changed = True
        while changed:
            changed = False
            for v in rng.permutation(n):
                at = group[near[first[v] : first[v + 1]]]
                to = np.bincount(at, weights=weight[first[v] : first[v + 1]])
                if moved_to(v, to, group, volume, strength, total, gamma):
                    changed = moved = True
        if not moved:
            break
        names, group = np.unique(group, return_inverse=True)
        member, n = group[member], len(names)
        pair, at = np.unique(group[i] * n + group[j], return_inverse=True)  # one edge for each two groups
        i, j, w = pair // n, pair % n, np.bincount(at, weights=w)
    return np.unique(member, return_inverse=True)[1]


def by_seed(edges: DataFrame, seeds: int, gamma: float = 1.0) -> DataFrame:
    """(seed, entity, label): as many copies of the edge list as cores, each with its share of the
    seeds; a task holds its copy as arrays, some 50 bytes an edge at most."""
    held = files.reread(edges.select("i", "j", "w"), "seed-edges")
    shares = min(seeds, held.sparkSession.sparkContext.defaultParallelism)
    copies = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            share = b.column("share").to_numpy()
            for k in np.unique(share).tolist():
                parts.setdefault(k, []).append([b.column(c).to_numpy()[share == k] for c in "ijw"])
        for k in list(parts):
            i, j, w = (np.concatenate(c) for c in zip(*parts.pop(k), strict=True))
            nodes = np.union1d(np.unique(i), np.unique(j))
            i, j = (np.searchsorted(nodes, c).astype(np.int32) for c in (i, j))
            order = np.lexsort((j, i))
            i, j, w = i[order], j[order], w[order]
            for seed in range(k, seeds, shares):
                lab = louvain(i, j, w, len(nodes), seed, gamma)
                cols = np.full(len(nodes), seed, np.int32), nodes, lab.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["seed", "entity", "label"])

    return copies.repartitionByRange(shares, "share").mapInArrow(run, "seed int, entity long, label int")


def louvain_correlated(z: np.ndarray, above: float, seed: int, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (rows of ``z`` with an edge) and their labels: ``louvain`` on the correlations over ``above`` (not
    negative), of which the first level makes a few rows at a time and holds none."""

    def rows(at: np.ndarray) -> np.ndarray:
        r = z[at] @ z.T / z.shape[1]
        r[~(r > above)] = 0.0  # undefined ones too
        r[np.arange(len(at)), at] = 0.0
        return r

    def parts(order: np.ndarray) -> Iterator[np.ndarray]:
        step = max((1 << 21) // max(len(z), 1), 1)
        return (order[s : s + step] for s in range(0, len(order), step))

    strength = np.concatenate([rows(at).sum(axis=1) for at in parts(np.arange(len(z)))] or [np.zeros(0)])
    nodes = np.flatnonzero(strength)
    z, strength, n = z[nodes], strength[nodes], len(nodes)
    rng, group, volume, total, changed, moved = np.random.default_rng(seed), np.arange(n), strength.copy(), strength.sum(), n > 0, False
    while changed:
        changed = False
        for at in parts(rng.permutation(n)):
            for v, w in zip(at, rows(at), strict=True):
                if moved_to(v, np.bincount(group, weights=w), group, volume, strength, total, gamma):
                    changed = moved = True
    if not moved:
        return nodes, group
    names, group = np.unique(group, return_inverse=True)
    k, held = len(names), np.zeros((2, 0))
    for at in parts(np.arange(n)):  # weights between groups, each pair of nodes once
        r = rows(at)
        r[np.arange(n)[None, :] <= at[:, None]] = 0.0
        sums = [np.bincount(group, weights=w) for w in r]
        pair = np.concatenate([group[v] * k + np.flatnonzero(s) for v, s in zip(at, sums, strict=True)])
        pair, to = np.unique(np.r_[held[0].astype(np.int64), pair], return_inverse=True)
        held = np.stack([pair, np.bincount(to, weights=np.concatenate([held[1], *[s[s > 0] for s in sums]]), minlength=len(pair))])
    pair = held[0].astype(np.int64)
    return nodes, louvain(pair // k, pair % k, held[1], k, rng, gamma)[group]


def by_seed_correlated(series: DataFrame, value: str, above: float, seeds: int, gamma: float = 1.0) -> DataFrame:
    """``by_seed`` on the correlations of ``series`` over ``above``. A task holds the series of all entities
    (some 200 bytes each) and makes the edges of a node when it is moved, so none is stored."""
    spark = series.sparkSession
    got = gr.standardised(series, value).select("entity", "z").toPandas().sort_values("entity")
    held = spark.sparkContext.broadcast((got["entity"].to_numpy("int64"), gr.stacked(got, "z") if len(got) else np.empty((0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, z = held.value
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                nodes, lab = louvain_correlated(z, above, seed, gamma)
                cols = np.full(len(nodes), seed, np.int32), names[nodes], lab.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["seed", "entity", "label"])

    return spark.range(0, seeds, 1, seeds).mapInArrow(run, "seed int, entity long, label int")


def co_association(runs: DataFrame) -> DataFrame:
    """(i, j, w): share of the runs that put i < j together. Pairs are made in two blocks of entities
    at a time, with all their runs."""
    runs = files.reread(runs, "seed-labels")
    seeds = runs.select("seed").distinct().count()
    rows = runs.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("seed", "label"))).alias("l"))  # a row per run
    rows = rows.select("entity", F.col("l.seed").alias("seeds"), F.col("l.label").alias("labels"))

    def fold(x: pd.DataFrame, y: pd.DataFrame, _) -> pd.DataFrame:
        every = np.unique(np.concatenate([*x["seeds"], *y["seeds"]]))

        def filled(t: pd.DataFrame, missing: int) -> np.ndarray:
            out = np.full((len(t), len(every)), missing)
            for k, (s, l) in enumerate(zip(t["seeds"], t["labels"], strict=True)):
                out[k, np.searchsorted(every, s)] = l
            return out

        n = np.zeros((len(x), len(y)), np.int32)
        for a, b in zip(filled(x, -1).T, filled(y, -2).T, strict=True):
            n += a[:, None] == b[None, :]
        return gr.listed(x, y, gr.apart(x, y) & (n > 0), w=n / seeds)

    return gr.in_blocks(rows, fold, "i long, j long, w double")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one pairing of rows and columns (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[col]:
            seen[col] = True
            free = np.flatnonzero(~seen[1:]) + 1
            now = c[owner[col] - 1, free - 1] - u[owner[col]] - v[free]
            better = now < least[free]
            least[free[better]], back[free[better]] = now[better], col
            nxt = free[np.argmin(least[free])]
            step = least[nxt]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            col = nxt
        while col:
            owner[col], col = owner[back[col]], back[col]
    pairs = [(int(owner[k]) - 1, k - 1) for k in range(1, m + 1) if owner[k]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)
