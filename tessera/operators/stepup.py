"""Benjamini-Hochberg q values of all pairs without a table of them.

Pairs are made again for each range of |r| instead of being sorted on disk: a task holds the series of
all entities (some 200 bytes each) and the values of its range, whose ranks follow from the counts
of the ranges before. The work grows with pairs times ranges, the disk not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as gr

#: Entities in a side of a tile, classes of |r| counted, values of a range that a task holds, rows of a batch.
TILE, CLASSES, HELD, BATCH = 768, 1 << 17, 16_000_000, 200_000


def tiles(n: int, tile: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(0, n, tile) for b in range(a, n, tile)]


def sizes(z: np.ndarray, tile: int, a: int, b: int) -> np.ndarray:
    """|r| of a tile: 2 without a correlation (p is 0 there), -1 where the cell is no pair."""
    u = np.abs(z[a : a + tile] @ z[b : b + tile].T / z.shape[1])
    u[np.isnan(u)] = 2.0
    if a == b:
        u[np.tril_indices(len(u))] = -1.0
    return u


def within(z: np.ndarray, tile: int, low: float, high: float) -> Iterator[tuple]:
    """Rows, columns and |r| of the pairs with low <= |r| < high, a tile after another."""
    for a, b in tiles(len(z), tile):
        u = sizes(z, tile, a, b)
        at = np.flatnonzero((u >= low) & (u < high))
        if len(at):
            i, j = np.divmod(at, u.shape[1])
            yield a + i, b + j, u.ravel()[at]


def range_values(z: np.ndarray, tile: int, low: float, high: float, expected: int, most: int) -> tuple[np.ndarray, np.ndarray | int]:
    """The |r| of a range, descending, and how often each is there (1, or counts if they are more than
    ``most``, the ties of one class)."""

    def merged(values, counts):
        u, at = np.unique(values, return_inverse=True)
        return u, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)

    buffer, full, seen, held = np.empty(min(expected, most)), 0, 0, []
    for _i, _j, u in within(z, tile, low, high):
        seen += len(u)
        while len(u) and seen <= expected:
            part = u[: len(buffer) - full]
            buffer[full : full + len(part)], full, u = part, full + len(part), u[len(part) :]
            if full == len(buffer) and expected > most:
                held = [merged(*(np.concatenate(c) for c in zip(*held, (buffer, np.ones(full, np.int64)), strict=True)))]
                full = 0
    if seen != expected:  # the same tiles must give the same numbers on every machine
        raise ValueError(f"{seen} pairs with |r| in [{low}, {high}), {expected} were counted")
    if held:
        u, c = merged(*(np.concatenate(c) for c in zip(*held, (buffer[:full], np.ones(full, np.int64)), strict=True)))
        return u[::-1], c[::-1]
    buffer.sort()
    return buffer[::-1], 1


def least_later(u: np.ndarray, c: np.ndarray | int, before: int, n: int, df: int) -> np.ndarray:
    """p n / rank of descending |r|, of each and all later ones the least. Equal p have the rank of the
    last."""
    up = before + (np.arange(1, len(u) + 1) if isinstance(c, int) else np.cumsum(c))
    raw = np.empty(len(u))
    for s in range(0, len(u), BATCH):
        at = slice(s, s + BATCH)
        p = np.where(u[at] > 1.5, 0.0, gr.p_values(u[at], df))
        raw[at] = p * n / up[at]
    return np.minimum.accumulate(raw[::-1], out=raw[::-1])[::-1]


def step_up(series: DataFrame, value: str, df: int) -> DataFrame:
    """(i, j, q) of all pairs of ``series``."""
    spark = series.sparkSession
    got = gr.standardised(series, value).select("entity", "z").toPandas().sort_values("entity")
    z = gr.stacked(got, "z") if len(got) else np.empty((0, 1))
    held = spark.sparkContext.broadcast((got["entity"].to_numpy("int64"), z))
    cores = spark.sparkContext.defaultParallelism
    tile, most = TILE, HELD
    n_tiles = len(tiles(len(z), tile))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, total = held.value[1], np.zeros(2 * CLASSES + 1, np.int64)
        every = tiles(len(z), tile)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                u = sizes(z, tile, *every[k]).ravel()
                total += np.bincount((u[u >= 0] * CLASSES).astype(np.int64), minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "c"])

    counts = np.zeros(2 * CLASSES + 1, np.int64)
    tasks = spark.range(0, n_tiles, 1, max(min(4 * cores, n_tiles), 1))
    for k, c in tasks.mapInArrow(counted, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        counts[k] = c
    n, before, edges, size = int(counts.sum()), 0, [], 0
    top = high = len(counts)
    for k in np.flatnonzero(counts)[::-1].tolist():  # descending |r|: ascending p
        if size and size + counts[k] > most:
            edges.append(((k + 1) / CLASSES, high / CLASSES if high < top else np.inf, before, size))
            high, before, size = k + 1, before + size, 0
        size += int(counts[k])
    if size:
        edges.append((0.0, high / CLASSES if high < top else np.inf, before, size))
    ranges = spark.range(0, len(edges), 1, max(len(edges), 1))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high, before, size = edges[k]
                found = least_later(*range_values(held.value[1], tile, low, high, size, most), before, n, df)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array(found[:1])], ["k", "m"])

    least = np.full(len(edges) + 1, 1.0)  # q is 1 at most
    if len(edges) > 1:
        for k, m in ranges.filter("id > 0").mapInArrow(lowest, "k long, m double").collect():
            least[k] = m
    after = np.minimum.accumulate(least[::-1])[::-1][1:].tolist() if edges else []

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, z = held.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high, before, size = edges[k]
                u, c = range_values(z, tile, low, high, size, most)
                q = np.minimum(least_later(u, c, before, n, df), after[k])[::-1]
                u, parts, rows = u[::-1], [], 0
                del c
                for i, j, v in within(z, tile, low, high):
                    parts.append((names[i], names[j], v))
                    rows += len(i)
                    if rows >= BATCH:
                        yield out(parts, u, q)
                        parts, rows = [], 0
                if rows:
                    yield out(parts, u, q)

    def out(parts: list, u: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        i, j, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(v)
        at = np.empty(len(v), np.int64)
        at[order] = np.searchsorted(u, v[order])
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(q[at])], ["i", "j", "q"])

    return ranges.mapInArrow(made, "i long, j long, q double")
