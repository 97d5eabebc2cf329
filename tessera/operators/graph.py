"""Similarity graphs: pair correlations, p-values, FDR, nearest neighbours, layers, indices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import _parse_datatype_string

from tessera.operators import ranks
from tessera.sources import files


def standardised(series: DataFrame, value: str) -> DataFrame:
    """entity, z: the series less its mean over its population deviation, as an array."""
    by = W.partitionBy("entity")
    z = series.withColumn("_z", F.try_divide(F.col(value) - F.avg(value).over(by), F.stddev_pop(value).over(by)))
    ordered = F.array_sort(F.collect_list(F.struct("month_idx", "_z")))
    return z.groupBy("entity").agg(F.transform(ordered, lambda s: s["_z"]).alias("z"))


#: Entities in a block of the pair matrix, at most.
BLOCK = 1024


def in_blocks(rows: DataFrame, fold: Callable, schema: str, edges: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """``fold(x, y, e)`` of each two blocks of ``rows`` (a row per entity), each block with itself
    too: x and y are tables in the order of entity, the same object for a block with itself, and e
    the given ``edges`` (i, j and more) between the two. A task holds two blocks at a time whatever
    the number of entities; pairs are neither shuffled nor broadcast, only what ``fold`` returns is
    passed on. A row is copied once for each block: ``size`` (else ``BLOCK``) can be larger where
    ``fold`` does not hold the whole matrix. ``fold`` may give a table after another."""
    rows = files.reread(rows, "blocks")
    n = rows.count()
    blocks = max(-(-n // (size or BLOCK)), min(8, -(-n // 128)), 1)
    deal = lambda c: F.pmod(F.hash(F.col(c).cast("long")), F.lit(blocks))
    names = [c for c in rows.columns if c != "entity"]
    dealt = rows.withColumn("_b", deal("entity")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("entity", *names, "_b", F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"))
    if edges is not None:
        dealt = dealt.unionByName(edges.withColumn("_b", F.lit(-1)).withColumns({"_p": F.least(deal("i"), deal("j")), "_q": F.greatest(deal("i"), deal("j"))}), allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in _parse_datatype_string(schema)}
    parts = min(blocks * (blocks + 1) // 2, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * rows.sparkSession.sparkContext.defaultParallelism))

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        key, held = None, []
        for batch in batches:
            for k, part in batch.groupby(["_p", "_q"], sort=False):
                if k != key and held:
                    yield key, pd.concat(held)
                    held = []
                key = k
                held.append(part)
        if held:
            yield key, pd.concat(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (p, q), t in groups(batches):
            x = t[t["_b"] == p].sort_values("entity", ignore_index=True)
            y = x if p == q else t[t["_b"] == q].sort_values("entity", ignore_index=True)
            e = t[t["_b"] == -1]
            if len(x) and len(y) or len(e):
                made = fold(x, y, e)
                for out in [made] if made is None or isinstance(made, pd.DataFrame) else made:
                    if out is not None and len(out):
                        yield out[list(kinds)]

    return dealt.repartition(parts, "_p", "_q").sortWithinPartitions("_p", "_q").mapInPandas(run, schema)


def stacked(t: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in t[column]])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to unit length; constant rows become NaN."""
    c = x - x.mean(axis=1, keepdims=True)
    size = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return c / np.where(size > 1e-12, size, np.nan)


def product(x: pd.DataFrame, y: pd.DataFrame, column: str = "z") -> np.ndarray:
    """Correlations of standardised series."""
    if not len(x) or not len(y):
        return np.empty((len(x), len(y)))
    a, b = stacked(x, column), stacked(y, column)
    return a @ b.T / a.shape[1]


#: Entities in a block of which ``strips`` are made, and cells of a strip.
WIDE, CELLS = 8192, 1 << 19


def strips(x: pd.DataFrame, y: pd.DataFrame, cells: int, column: str = "z") -> Iterator[tuple]:
    """The matrix of ``product`` by rows: part of x, the y it meets, correlations and which of them are
    pairs."""
    if not len(x) or not len(y):
        return
    a, b = stacked(x, column), stacked(y, column)
    step = max(cells // len(y), 1)
    for s in range(0, len(x), step):
        first = s if x is y else 0
        r = a[s : s + step] @ b[first:].T / a.shape[1]
        keep = np.ones(r.shape, bool)
        yield x.iloc[s : s + step], y.iloc[first:], r, np.triu(keep, 1) if x is y else keep


def apart(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    """Which cells of the matrix are pairs: all, or those above the diagonal of a block with itself."""
    full = np.ones((len(x), len(y)), bool)
    return np.triu(full, 1) if x is y else full


def listed(x: pd.DataFrame, y: pd.DataFrame, keep: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
    """i < j of the kept cells, with their ``values``."""
    a, b = np.nonzero(keep)
    i, j = x["entity"].to_numpy()[a], y["entity"].to_numpy()[b]
    return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), **{c: v[a, b] for c, v in values.items()}})


def defined(pairs: DataFrame, *columns: str) -> DataFrame:
    return pairs.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def correlations(series: DataFrame, value: str, above: float | None = None) -> DataFrame:
    """(i, j, r) for i < j; null where a series is constant; those of r > ``above`` only, if given."""

    def fold(x: pd.DataFrame, y: pd.DataFrame, _) -> pd.DataFrame:
        r = product(x, y)
        return listed(x, y, apart(x, y) if above is None else apart(x, y) & (r > above), r=r)

    return defined(in_blocks(standardised(series, value), fold, "i long, j long, r double"), "r")


def correlated_or_linked(series: DataFrame, value: str, above: float, edges: DataFrame) -> DataFrame:
    """(i, j, r, w): pairs of r > ``above``, else r is null, and the ``edges`` (i < j, w, each once),
    else w is null. Edges go to the blocks of their ends, so neither side is shuffled pair by pair."""

    def fold(x: pd.DataFrame, y: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        r = product(x, y)
        made = listed(x, y, apart(x, y) & (r > above), r=r)
        given = pd.DataFrame({"i": e["i"].astype("int64"), "j": e["j"].astype("int64"), "w": e["w"].astype(float)})
        return made.merge(given, how="outer", on=["i", "j"]) if len(given) else made.assign(w=np.nan)

    ends = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "w")
    return defined(in_blocks(standardised(series, value), fold, "i long, j long, r double, w double", ends), "r", "w")


def two_correlations(series: DataFrame, value: str, names: dict[str, Column]) -> DataFrame:
    """i < j and, for each name, the correlation over the rows of its condition, made together."""
    rows, kept = None, list(names)
    for name, condition in names.items():
        one = standardised(series.filter(condition), value).withColumnRenamed("z", name)
        rows = one if rows is None else rows.join(one, "entity")

    def fold(x: pd.DataFrame, y: pd.DataFrame, _) -> pd.DataFrame:
        return listed(x, y, apart(x, y), **{c: product(x, y, c) for c in kept})

    made = in_blocks(rows, fold, "i long, j long, " + ", ".join(f"{c} double" for c in kept))
    return defined(made, *kept)


def best_cells(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k least keys, the first columns on ties."""
    k = min(k, key.shape[1])
    a, b = np.nonzero(key <= np.partition(key, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((b, key[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k]


def best_partners(x: pd.DataFrame, y: pd.DataFrame, key: np.ndarray, value: np.ndarray, k: int, name: str) -> pd.DataFrame:
    """i, j, value: for each entity of either block its k partners of least key in the other."""
    i, j = x["entity"].to_numpy(), y["entity"].to_numpy()
    if x is y:
        key = key.copy()
        np.fill_diagonal(key, np.inf)
    a, b = best_cells(key, k)
    found = [(i[a], j[b], value[a, b])]
    if x is not y:
        a, b = best_cells(key.T, k)
        found.append((j[a], i[b], value.T[a, b]))
    cols = [np.concatenate(c) for c in zip(*found, strict=True)]
    out = pd.DataFrame(dict(zip(("i", "j", name), cols, strict=True)))
    return out[out["i"] != out["j"]]


def nearest_correlated(series: DataFrame, value: str, k: int) -> DataFrame:
    """``nearest`` of ``correlations`` (i, j, r, rank), of which each two blocks pass on k partners of
    an entity."""

    def fold(x: pd.DataFrame, y: pd.DataFrame, _) -> pd.DataFrame:
        r = product(x, y)
        return best_partners(x, y, np.where(np.isnan(r), np.finfo(float).max, -r), r, k, "r")

    few = defined(in_blocks(standardised(series, value), fold, "i long, j long, r double"), "r")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.col("r").desc(), "j"))).filter(F.col("rank") <= k)


def nearest_of(rows: DataFrame, df: int, k: int, floor: float | None = None) -> DataFrame:
    """(i, j, r, p, rank): each entity's k nearest of ``rows`` (entity, z), ties by number; correlations under
    ``floor`` and null ones count as it, if given."""
    cells = CELLS

    def fold(x: pd.DataFrame, y: pd.DataFrame, _) -> Iterator[pd.DataFrame]:
        for t, o in ((x, y),) if x is y else ((x, y), (y, x)):
            if not len(t) or not len(o):
                continue
            a, b = stacked(t, "z"), stacked(o, "z")
            step = max(cells // len(o), 1)
            for s in range(0, len(t), step):
                r = a[s : s + step] @ b.T / a.shape[1]
                key = np.where(np.isnan(r), np.finfo(float).max, -r) if floor is None else -np.fmax(r, floor)
                if t is o:
                    key[np.arange(len(key)), s + np.arange(len(key))] = np.inf
                m, n = best_cells(key, k)
                m, n = (c[key[m, n] < np.inf] for c in (m, n))
                yield pd.DataFrame({"i": t["entity"].to_numpy()[s + m], "j": o["entity"].to_numpy()[n], "r": r[m, n], "p": p_values(r[m, n], df)})

    few = defined(in_blocks(rows, fold, "i long, j long, r double, p double", size=WIDE), "r")
    best = F.col("r").desc() if floor is None else F.greatest("r", F.lit(floor)).desc()
    return few.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(best, "j"))).filter(F.col("rank") <= k)


def t_pvalue(r: Column, df: int) -> Column:
    """Two-sided p of a correlation, finite sums for odd and even degrees of freedom."""
    t = r * F.sqrt(F.lit(float(df)) / F.greatest(1 - r * r, F.lit(1e-15)))
    theta = F.atan(t / F.sqrt(F.lit(float(df))))
    s, c2 = F.sin(theta), F.pow(F.cos(theta), 2)
    total, term = F.lit(0.0), F.cos(theta) if df % 2 else F.lit(1.0)
    for k in range(1 if df % 2 else 0, df - 1, 2):
        total = total + term
        term = term * c2 * ((k + 1.0) / (k + 2.0))
    inside = (2 / 3.141592653589793) * (theta + s * total) if df % 2 else s * total
    return F.greatest(1 - F.abs(inside), F.lit(0.0))


def p_values(r: np.ndarray, df: int) -> np.ndarray:
    """``t_pvalue`` of an array; there too, as in the SQL, p is 0 without a correlation."""
    t = r * np.sqrt(df / np.maximum(1 - r * r, 1e-15))
    theta = np.arctan(t / np.sqrt(df))
    s, c2 = np.sin(theta), np.cos(theta) ** 2
    total, term = np.zeros_like(r), np.cos(theta) if df % 2 else np.ones_like(r)
    for k in range(1 if df % 2 else 0, df - 1, 2):
        total = total + term
        term = term * c2 * ((k + 1.0) / (k + 2.0))
    inside = (2 / 3.141592653589793) * (theta + s * total) if df % 2 else s * total
    return np.fmax(1 - np.abs(inside), 0.0)


#: Values of p that are counted singly, at most, in the last pass of ``bh_limit``.
SINGLY = 1 << 17


def bh_limit(rows: DataFrame, df: int, level: float) -> float:
    """The greatest p of the pairs of ``rows`` (entity, z) whose q of ``bh`` is at most ``level``; -1 if
    there is none. A pair's q is at most ``level`` if and only if its p is at most this one. Values
    of p are counted in classes of leading bits where the pairs are made, first all up to ``level`` (no
    greater p can pass), then those of the classes that can hold the limit, down to single values."""
    cells, least = CELLS, 0.0  # correlations nearer to zero have a p over the level
    for step in 2.0 ** -np.arange(1, 40):
        least += step if p_values(np.array([least + step]), df)[0] > level * (1 + 1e-9) else 0.0
    below, low, high, shift, n = 0, 0, int(np.float64(level).view(np.int64)), 42, None
    while True:
        def fold(x: pd.DataFrame, y: pd.DataFrame, _, low=low, high=high, shift=shift) -> pd.DataFrame:
            found, size = [], 0
            for _x, _y, r, keep in strips(x, y, cells):
                size += np.count_nonzero(keep)
                p = p_values(r[keep & ~(np.abs(r) < least)], df) + 0.0  # no minus zero
                bits = p.view(np.int64)
                found.append(np.stack(np.unique(bits[(bits >= low) & (bits <= high)] >> shift, return_counts=True)))
            k, c = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            k, at = np.unique(k, return_inverse=True)
            return pd.DataFrame({"k": np.r_[k, -1], "c": np.r_[np.bincount(at, weights=c, minlength=len(k)).astype("int64"), size]})

        got = np.array([tuple(r) for r in in_blocks(rows, fold, "k long, c long", size=WIDE).groupBy("k").agg(F.sum("c")).orderBy("k").collect()], np.int64).reshape(-1, 2)
        n, (k, c) = int(got[got[:, 0] < 0, 1].sum()), got[got[:, 0] >= 0].T
        up = below + np.cumsum(c)
        first, last = ((b.astype(np.int64)).view(np.float64) for b in (k << shift, ((k + 1) << shift) - 1))
        able = np.flatnonzero(first * n / up <= level)
        sure = np.flatnonzero(last * n / up <= level)
        able = able[able >= sure[-1]] if len(sure) else able
        if not len(able):
            return -1.0
        if not shift:  # a little more than it, as a pair made elsewhere may differ in the last bits
            top, after = first[able[-1]], np.append(first, np.inf)[able[-1] + 1]
            return float(min(top * (1 + 1e-9), (top + after) / 2))
        a, b = able[0], able[-1]
        below, low, high = int(up[a] - c[a]), int(k[a] << shift), int(((k[b] + 1) << shift) - 1)
        shift = 0 if up[b] - below <= SINGLY else max(shift - 10, 0)


def tested(series: DataFrame, value: str, df: int, level: float, safety: int) -> DataFrame:
    """(i, j, r, p, bh_pass, in_safety): the pairs, whether their q is at most ``level`` and whether one is
    among the other's ``safety`` nearest. Pairs are made again for each pass, never stored."""
    rows = files.reread(standardised(series, value), "standardised")
    limit, near, cells = bh_limit(rows, df, level), undirected(nearest_of(rows, df, safety)), CELLS

    def fold(x: pd.DataFrame, y: pd.DataFrame, e: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ends = e[["i", "j"]].to_numpy("int64")
        ends = ends if x is y else np.where(np.isin(ends[:, :1], x["entity"]), ends, ends[:, ::-1])
        row, col = (np.searchsorted(t["entity"], c) for t, c in zip((x, y), ends.T, strict=True))
        for part, other, r, keep in strips(x, y, cells):
            mark, a, b = np.zeros(r.shape, bool), row - part.index[0], col - other.index[0]
            here = (a >= 0) & (a < len(part))
            mark[a[here], b[here]] = True
            out = listed(part, other, keep, r=r, in_safety=mark)
            p = p_values(out["r"].to_numpy(), df)
            yield out.assign(p=p, bh_pass=p <= limit)

    return defined(in_blocks(rows, fold, "i long, j long, r double, p double, bh_pass boolean, in_safety boolean", near, WIDE), "r")


def tested_edges(series: DataFrame, value: str, df: int, k: int = 10, safety: int = 3, level: float = 0.05) -> DataFrame:
    """``similarity_edges`` of the tested correlations of ``series``; two blocks pass on the nearest of each
    entity only."""
    rows = files.reread(standardised(series, value), "standardised")
    e1 = nearest_of(rows, df, k, 0.0).filter(F.col("p") <= bh_limit(rows, df, level))
    return undirected(e1.union(nearest_of(rows, df, safety)))


def bh(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg q values: step-up over distinct p values, which are ranked in range
    partitions with an offset for each."""
    table = ranks.cumulative(pairs, p, "_p").withColumn("_raw", F.col("_p") * F.col("n") / F.col("up"))
    q = ranks.later_min(table, "_raw", "_p", "_q").select("_p", F.least("_q", F.lit(1.0)).alias("q"))
    return pairs.join(q.hint("merge"), F.col(p) == F.col("_p")).drop("_p")  # q is as long as the pairs


def both_ways(pairs: DataFrame, value: str) -> DataFrame:
    return pairs.select("i", "j", value).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value))


def nearest(pairs: DataFrame, value: str, k: int) -> DataFrame:
    """The k best partners of each node, ties by the partner's number."""
    w = W.partitionBy("i").orderBy(F.col(value).desc(), "j")
    return both_ways(pairs, value).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def similarity_edges(pairs: DataFrame, k: int = 10, safety: int = 3, q: float = 0.05) -> DataFrame:
    """(union of k nearest and significant) and each node's few best."""
    pairs = files.reread(pairs, "tested-pairs")
    e1 = undirected(nearest(pairs.withColumn("s", F.greatest("r", F.lit(0.0))), "s", k))
    e2 = pairs.filter((F.col("q") <= q)).select("i", "j")
    e3 = undirected(nearest(pairs, "r", safety))
    return e1.intersect(e2).union(e3).distinct()


def block_sums(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, s): weight between groups; s of a = b counts each inner edge twice."""
    l1 = labels.select(F.col("entity").alias("i"), F.col("label").alias("a"))
    l2 = labels.select(F.col("entity").alias("j"), F.col("label").alias("b"))
    both = both_ways(edges, "w").join(l1, "i").join(l2, "j")
    return both.groupBy("a", "b").agg(F.sum("w").alias("s"))


def correlated_block_sums(series: DataFrame, value: str, labels: DataFrame, above: float) -> DataFrame:
    """``block_sums`` of the correlations over ``above``, summed where they are made."""
    rows = standardised(series, value).join(labels.select("entity", "label"), "entity")

    def fold(x: pd.DataFrame, y: pd.DataFrame, _) -> pd.DataFrame:
        r = product(x, y)
        keep = apart(x, y) & (r > above)
        (ka, ca), (kb, cb) = (np.unique(t["label"], return_inverse=True) for t in (x, y))
        one, two = np.eye(len(ka))[ca], np.eye(len(kb))[cb]
        n, s = one.T @ keep.astype(float) @ two, one.T @ np.where(keep, r, 0.0) @ two
        a, b = np.nonzero(n)
        return pd.DataFrame({"a": np.r_[ka[a], kb[b]], "b": np.r_[kb[b], ka[a]], "s": np.r_[s[a, b], s[a, b]]})

    kind = dict(labels.dtypes)["label"]
    return in_blocks(rows, fold, f"a {kind}, b {kind}, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))


def graph_indices(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """avi, avu, anui, q, mq_turbo of a labelled graph: zero denominators give zero."""
    return block_indices(block_sums(edges, labels), labels)


def block_indices(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """The indices from the weights between groups, which are written once."""
    s = files.reread(sums, "block-sums")
    groups = labels.select(F.col("label").alias("a")).distinct()
    per = groups.join(
        s.groupBy("a").agg(F.sum("s").alias("vol"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s")).otherwise(0.0)).alias("inner")), "a", "left"
    ).fillna(0.0, ["vol", "inner"]).withColumn("out", F.col("vol") - F.col("inner"))
    total = F.sum("vol").over(W.partitionBy(F.lit(0)))
    head = per.withColumn("m2", total).agg(
        F.count("*").alias("k"),
        F.sum(F.coalesce(F.try_divide("inner", "vol"), F.lit(0.0))).alias("avi"),
        F.sum(F.coalesce(F.try_divide("inner", "m2") - F.pow(F.try_divide("vol", "m2"), 2), F.lit(0.0))).alias("q"),
        F.sum(F.coalesce(F.try_divide("inner", F.col("inner") + F.col("out")), F.lit(0.0))).alias("mq_turbo"),
    )
    o = per.select("a", "out")
    cross = s.filter("a <> b").join(o, "a").join(o.select(F.col("a").alias("b"), F.col("out").alias("out_b")), "b")
    avu = cross.agg(F.coalesce(F.sum(F.coalesce(F.try_divide("s", F.col("out") + F.col("out_b") - F.col("s")), F.lit(0.0))), F.lit(0.0)).alias("avu"))
    both = head.crossJoin(avu).select(
        (F.col("avi") / F.col("k")).alias("avi"), (F.col("avu") / F.col("k")).alias("avu"), "q", "mq_turbo"
    )
    anui = F.when(F.col("avi") == 0, 0.0).otherwise(1 / (F.col("avu") + F.try_divide(F.lit(1.0), F.col("avi"))))
    return both.withColumn("anui", anui)


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and arithmetic NMI of two labellings, from contingency counts."""
    n = pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    c2 = lambda x: x * (x - 1) / 2
    ra, rb = (n.groupBy(c).agg(F.sum("n").alias("n")) for c in (a, b))
    cell = n.agg(F.sum(c2(F.col("n"))).alias("s"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("h"))
    rows = ra.agg(F.sum(c2(F.col("n"))).alias("sa"), F.sum(F.col("n") * F.log("n")).alias("ha"))
    cols = rb.agg(F.sum(c2(F.col("n"))).alias("sb"), F.sum(F.col("n") * F.log("n")).alias("hb"))
    t = F.col("t")
    expected = F.col("sa") * F.col("sb") / (t * (t - 1) / 2)
    ha, hb = F.log(t) - F.col("ha") / t, F.log(t) - F.col("hb") / t
    mutual = F.col("h") / t + F.log(t) - F.col("ha") / t - F.col("hb") / t
    return cell.crossJoin(rows).crossJoin(cols).select(
        F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"),
        F.try_divide(mutual, (ha + hb) / 2).alias("nmi"),
    )


def layered(layers: dict[int, DataFrame]) -> DataFrame:
    """i, j, mask: the bits of the layers that have an edge."""
    every = None
    for bit, edges in layers.items():
        one = undirected(edges).withColumn("bit", F.lit(bit))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("i", "j").agg(F.bit_or("bit").alias("mask"))


def topology(nodes: DataFrame, edges: DataFrame, parts: DataFrame, regions: DataFrame) -> DataFrame:
    """nodes, edges, mean_degree, isolates, giant (share in the largest component), within (share of
    edges inside a region)."""
    a, b = (regions.select(F.col("entity").alias(k), F.col("region_name").alias(f"r_{k}")) for k in ("i", "j"))
    m = edges.join(a, "i").join(b, "j").agg(F.count("*").alias("edges"), F.avg((F.col("r_i") == F.col("r_j")).cast("double")).alias("within"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("c")).agg(F.max("c").alias("top"), F.sum("c").alias("linked"))
    n = F.col("nodes")
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(m).crossJoin(sizes).select(
        "nodes", "edges", (2 * F.col("edges") / n).alias("mean_degree"), (n - F.coalesce("linked", F.lit(0))).alias("isolates"), (F.coalesce("top", F.lit(0)) / n).alias("giant"), "within"
    )


def nonnegative(edges: DataFrame) -> DataFrame:
    """Weights clipped at zero if any is positive, else less the smallest."""
    ends = edges.agg(F.max("w").alias("_hi"), F.min("w").alias("_lo"))
    w = F.when(F.col("_hi") > 0, F.greatest("w", F.lit(0.0))).otherwise(F.col("w") - F.col("_lo"))
    return edges.crossJoin(F.broadcast(ends)).select("i", "j", w.alias("w"))


def nearest_graph(near: DataFrame) -> DataFrame:
    """The union of the nearest of each node (i, j, r), weights not negative."""
    edges = near.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("r").alias("w"))
    return nonnegative(files.reread(edges, "nearest"))


def perturbed(edges: DataFrame, absent: DataFrame, share: float, seed: int) -> DataFrame:
    """``edges`` without a share of them and with as many of the ``absent`` pairs at the median
    weight; which ones, a hash of pair and seed decides."""
    key = F.md5(F.concat_ws("-", F.col("i").cast("string"), F.col("j").cast("string"), F.lit(str(seed))))
    n, middle = edges.agg(F.floor(F.count("*") * share).cast("int"), F.median("w")).first()
    gone = edges.orderBy(key).limit(n).select("i", "j")
    added = absent.orderBy(key).limit(n).select("i", "j", F.lit(middle).alias("w"))
    return edges.join(gone, ["i", "j"], "left_anti").unionByName(added)


def edge_jaccard(sets: dict[str, DataFrame]) -> DataFrame:
    """a, b, jaccard of named edge sets, from one pass over each."""
    every = None
    for name, edges in sets.items():
        one = edges.select("i", "j", F.lit(name).alias("m"))
        every = one if every is None else every.unionByName(one)
    held = every.groupBy("i", "j").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    both = held.select(F.explode("ms").alias("a"), "ms").select("a", F.explode("ms").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    sizes = both.filter("a = b").select(F.col("a").alias("k"), F.col("n").alias("size"))
    x, y = sizes.withColumnsRenamed({"k": "a", "size": "na"}), sizes.withColumnsRenamed({"k": "b", "size": "nb"})
    return both.join(F.broadcast(x), "a").join(F.broadcast(y), "b").select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))
