"""Line deduplication by pairwise alignment.

Lines are hashed, and documents that share lines are paired:

* a rare line, held by two to ``RARE`` documents, pairs each of them with every earlier one;
* a passage that more documents hold has no rare line. Each of its runs of lines that reach
  ``least_words`` words pairs the later holders with the first one: pairs grow with the documents,
  not with the square of a passage's holders, and none is lost, as the first holder has the run.

Each pair is aligned by patience diff over line hashes, and common blocks of ``least_words`` words
or more are deleted from the later document. Such an alignment keeps one order and lines that occur
once; blocks that are repeated in either document or stand in another order are found by matching
the rest against all runs of the earlier document's lines. What is moved between tasks for this
are line hashes; texts move once, to be cut. Lines and documents that a large part of the corpus
shares are dealt over several tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import give_back, join_spread, slices, stored, text_or_empty

#: Documents that may hold a line that counts as rare.
RARE = 8


def outline(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line; a blank line has hash 0 and no words."""
    hashes, words = [], []
    for line in text.split("\n"):
        w = line.split()
        words.append(len(w))
        hashes.append(xxhash.xxh64_intdigest(" ".join(w)) - (1 << 63) if w else 0)
    return hashes, words


def anchors(hashes: list[int], words: list[int], least_words: int) -> set[int]:
    """Hashes of the shortest runs of lines, one from each line on, with enough words."""
    full = [k for k, n in enumerate(words) if n]
    out, stop, total = set(), 0, 0
    for start in range(len(full)):
        while stop < len(full) and total < least_words:
            total += words[full[stop]]
            stop += 1
        if total < least_words:
            break
        run = b"".join(hashes[k].to_bytes(8, "little", signed=True) for k in full[start:stop])
        out.add(xxhash.xxh64_intdigest(run) - (1 << 63))
        total -= words[full[start]]
    return out


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: index pairs of equal lines, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if count_a[x] == 1 and count_b.get(x) == 1}
        common = [(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(common):
            p = bisect_left(tails, i)
            tails[p : p + 1] = [i]
            ends[p : p + 1] = [k]
            back.append(ends[p - 1] if p else -1)
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        if not chain:
            continue
        chain.reverse()
        out += chain
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            if i1 - i0 > 1 and j1 - j0 > 1:
                todo.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


def longest_matches(a: list[int], b: list[int]) -> list[int]:
    """For each line of ``b``, how many lines up to it stand in a row anywhere in ``a`` (the most):
    a suffix automaton of ``a``, so the time grows with the lines of both."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for x in a:
        new, p = len(step), last
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if longest[q] != longest[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        last = new
    out, at, n = [], 0, 0
    for x in b:
        while at and x not in step[at]:
            at = link[at]
            n = longest[at]
        if x in step[at]:
            at, n = step[at][x], n + 1
        out.append(n)
    return out


def common_lines(a: list[int], b: list[int], words_b: list[int], least_words: int) -> list[int]:
    """Lines of ``b`` in blocks, contiguous in both but for blank lines, of enough words: all
    that stand anywhere in ``a``, how often and in what order they may."""
    full_a, full_b = [k for k, h in enumerate(a) if h], [k for k, h in enumerate(b) if h]
    out, block, total = [], [], 0
    last = (-2, -2)
    for i, j in [*aligned([a[k] for k in full_a], [b[k] for k in full_b]), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if total >= least_words:
                out += block
            block, total = [], 0
        if j >= 0:
            block.append(full_b[j])
            total += words_b[full_b[j]]
        last = (i, j)
    if len(out) == len(full_b):
        return out
    total, covered, found = [0, *accumulate(words_b[k] for k in full_b)], len(full_b), set(out)
    for end, n in reversed([*enumerate(longest_matches([a[k] for k in full_a], [b[k] for k in full_b]), 1)]):
        if n and total[end] - total[end - n] >= least_words:
            found.update(full_b[end - n : min(end, covered)])
            covered = min(covered, end - n)
    return sorted(found)


def _outlines(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """A row per (doc_id, raw = digest of the text): node (a number fixed in the written table), o (its
    place in the order), copies (rows alike), hashes and words of the lines, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                made = [outline(t) for t in part.column(2).to_pylist()]
                held = [sorted(anchors(h, w, least_words)) for h, w in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([h for h, _ in made], pa.list_(pa.int64())), pa.array([w for _, w in made], pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int64()))],
                    ["doc_id", "raw", "hashes", "words", "anchors"],
                )
        give_back()

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("raw"), text.alias("t"))
    lined = rows.mapInArrow(run, "doc_id long, raw binary, hashes array<long>, words array<int>, anchors array<long>")
    one = lined.groupBy("doc_id", "raw").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("hashes", "words", "anchors")])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw", "node")
    return stored(one.withColumn("node", F.monotonically_increasing_id()).withColumn("o", order), "line-outlines")


def overlaps(lined: DataFrame) -> DataFrame:
    """(node, first): each pair of a document and an earlier one that is to be aligned."""
    lines = lined.select("o", F.explode(F.array_distinct(F.filter("hashes", lambda h: h != 0))).alias("line"))
    held = stored(lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1"), "line-frequencies")
    rare = join_spread(lines, held.filter(F.col("n") <= RARE).select("line"), "line", F.xxhash64("o.node"), held)
    few = rare.groupBy("line").agg(F.array_sort(F.collect_list("o")).alias("os"))
    earlier = F.transform("os", lambda o, i: F.struct(o["node"].alias("node"), F.transform(F.slice("os", 1, i), lambda f: f["node"]).alias("firsts")))
    by_line = few.select(F.explode(earlier).alias("p")).select("p.node", F.explode("p.firsts").alias("first"))

    runs = lined.select("o", F.explode("anchors").alias("anchor"))
    first = stored(runs.groupBy("anchor").agg(F.min("o").alias("f"), F.count("*").alias("n")).filter("n > 1"), "line-runs")
    met = join_spread(runs, first.select("anchor", F.col("f.node").alias("first")), "anchor", F.xxhash64("o.node"), first)
    by_run = met.select(F.col("o.node").alias("node"), "first").filter("first <> node")
    return by_line.unionByName(by_run).distinct()


def repeated_lines(lined: DataFrame, least_words: int) -> DataFrame:
    """(node, lines): for each document with something to delete, the numbers of those lines."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                node, ha, hb, wb = (part.column(k).to_pylist() for k in ("node", "first_hashes", "hashes", "words"))
                found = [common_lines(x, y, w, least_words) for x, y, w in zip(ha, hb, wb, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["node", "lines"])

    pairs = stored(overlaps(lined), "line-pairs")
    later = pairs.join(lined.select("node", "hashes", "words").hint("merge"), "node")
    firsts = lined.select(F.col("node").alias("first"), F.col("hashes").alias("first_hashes"))
    both = join_spread(later, firsts, "first", F.xxhash64("node"), pairs.groupBy("first").agg(F.count("*").alias("n")))
    found = both.mapInArrow(align, "node long, lines array<int>").select("node", F.explode("lines").alias("line"))
    return found.groupBy("node").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (what is left; null stays null), n_lines,
    deleted (line numbers from 0, empty if none).

    The earlier of two documents is the one with the smaller id (null last), then the smaller digest
    of the text. A document that is a copy of an earlier one loses all lines. Of rows with the same
    id and text one counts as the earliest and the others as copies. Blocks of fewer than
    ``least_words`` words stay, and so do blank lines between deleted ones. An empty table gives an
    empty result; other columns are not read.
    """
    lined = _outlines(docs, id_col, text_col, least_words)
    full = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i) > 0)
    enough = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w) >= least_words
    whole = F.when(enough, full).otherwise(F.array().cast("array<int>"))
    cut = lined.join(repeated_lines(lined, least_words), "node", "left").select("doc_id", "raw", "copies", "lines", F.when(F.col("copies") > 1, whole).alias("whole"))
    cut = stored(cut.filter("lines is not null or copies > 1").withColumnsRenamed({"doc_id": "_id", "raw": "_raw"}), "line-blocks")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("raw"))
    # Cuts grow with the documents: sorted at every size, never broadcast.
    joined = rows.join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")), "left")
    if not cut.filter("copies > 1").isEmpty():
        again = joined.filter("copies > 1").groupBy("doc_id", "raw", "t", "lines", "whole").agg(F.count("*").alias("copies"))
        nth = again.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
        nth = nth.withColumn("lines", F.when(F.col("nth") == 1, F.col("lines")).otherwise(F.col("whole")))
        joined = joined.filter("copies is null or copies = 1").select("doc_id", "t", "lines").unionByName(nth.select("doc_id", "t", "lines"))
    lines, gone = F.split("t", "\n", -1), F.coalesce("lines", F.array().cast("array<int>"))
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("lines", i)), "\n")
    return joined.select(
        "doc_id",
        F.when(F.size(gone) == 0, F.col("t")).otherwise(left).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        gone.alias("deleted"),
    )
