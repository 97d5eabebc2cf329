"""Secret scanning: fixed rules plus character Markov models.

Rules find assignments, access keys and long hex runs. The models judge every other run of 16 or
more key characters, whatever its characters: one first-order character model of random strings, one
of ordinary identifiers, and a run is a secret where the log-likelihood ratio per character and in
total is high enough. Both models are trained from labelled samples: strings that the rules for
assignments and access keys mark are random (hex runs have an alphabet of their own and a rule),
distinct runs of a sample of texts that no rule marks are ordinary: words, numbers, dates, slugs,
paths, rulers. No transition counts for more than ``CLIP``, so a few strange ones (as in camel case)
do not decide.

DataFrame expressions only. What is broadcast or sent to the driver is a table over pairs of
ASCII characters, whatever the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import text_or_empty

#: The kinds in their order, and the rules' patterns. Runs that a shorter match
#: could not extend need no length test afterwards; an assignment does.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A whole run of 16 or more key characters with a letter or digit among them; ordinary runs are learnt from 6 characters on.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[+/_=-]*[A-Za-z0-9])[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}"
ALPHABET = 128
#: Kinds of key characters; bound of a transition's log ratio.
SEEN, CLIP = 66, 3.5


@dataclass
class MarkovModel:
    """``ratio[a * 128 + b]``: log P(b after a | random) - log P(b after a | ordinary)."""

    ratio: list[float]
    least_total: float = 12.0
    least_mean: float = 0.5


def _spans(rows: DataFrame, pattern: str, name: str, group: int | None = None, least: int = 0) -> DataFrame:
    """``rows`` with ``name``: array of (start, end, value) in code points; null if none.

    The text between matches has known lengths, so a running sum gives the positions.
    """
    t, found = F.col("_t"), F.col("_t").rlike(pattern)
    rows = rows.withColumns(
        {
            "_m": F.when(found, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))),
            "_v": F.when(found, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))) if group else F.lit(None).cast("array<string>"),
            "_p": F.when(found, F.split(t, pattern, -1)),
        }
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get("_p", i))
        end = start + F.length(F.get("_m", i))
        one = F.struct(start.alias("start"), end.alias("end"), F.get("_v" if group else "_m", i).alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(0), F.size("_m") - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    if least:
        folded = F.filter(folded, lambda s: F.length(s["value"]) >= least)
    return rows.withColumn(name, F.when(F.size("_m") > 0, folded)).drop("_m", "_v", "_p")


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, _t, assign, access, hex): the rules' spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_t"))
    rows = _spans(rows, ASSIGN, "assign", group=2, least=6)
    return _spans(_spans(rows, ACCESS, "access"), HEX, "hex")


def _pairs(tokens: DataFrame) -> list:
    """Counts of neighbouring characters in a column of ASCII tokens: at most 128 x 128 rows."""
    pair = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    return tokens.select(F.explode(pair).alias("p")).groupBy("p").count().collect()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_random: int = 20_000, max_texts: int = 5_000) -> MarkovModel:
    """Models from at most ``max_random`` distinct strings that the rules mark (16 characters or
    more) and the distinct ordinary runs of at most ``max_texts`` texts, both chosen by hash.

    Null and empty texts and repeated rows teach nothing more; other columns are not read. Without
    marked strings every ratio is 0 and the method adds nothing."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    marked = base_spans(rows.filter(F.col("_text").rlike(f"{ASSIGN}|{ACCESS}")), "doc_id", "_text")
    values = F.flatten(F.array(*[F.coalesce(F.col(k), F.array()) for k in KINDS[:2]]))
    random = marked.select(F.explode(F.transform(values, lambda s: s["value"])).alias("token")).filter(F.length("token") >= 16).distinct()
    random = random.orderBy(F.xxhash64("token"), "token").limit(max_random)
    # Rows are picked by their hashes alone: the texts themselves do not meet in one task.
    hashes = [F.xxhash64("doc_id").alias("_a"), F.xxhash64("_text").alias("_b")]
    picked = rows.select(*hashes).orderBy("_a", "_b").limit(max_texts).distinct()
    some = rows.select("_text", *hashes).join(F.broadcast(picked), ["_a", "_b"], "left_semi").select("_text")
    unmarked = F.regexp_replace("_text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    ordinary = some.select(F.explode(F.regexp_extract_all(unmarked, F.lit(ORDINARY), F.lit(0))).alias("token")).distinct()
    tables = []
    for tokens in (random, ordinary):
        pair, one = [0] * ALPHABET**2, [0] * ALPHABET
        for p, n in _pairs(tokens):
            pair[ord(p[0]) * ALPHABET + ord(p[1])] += n
            one[ord(p[0])] += n
        tables.append((pair, one))
    (rp, ro), (op, oo) = tables
    if not sum(ro):
        return MarkovModel([0.0] * ALPHABET**2)

    def ratio(k: int) -> float:
        a = k // ALPHABET
        x = math.log((rp[k] + 0.5) / (ro[a] + 0.5 * SEEN)) - math.log((op[k] + 0.5) / (oo[a] + 0.5 * SEEN))
        return max(-CLIP, min(CLIP, x))

    return MarkovModel([ratio(k) for k in range(ALPHABET**2)])


def _score(token: Column, model: MarkovModel) -> Column:
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model.ratio)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    start = F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("s"))

    def step(acc: Column, b: Column) -> Column:
        gain = F.when(acc["a"] < 0, 0.0).otherwise(F.get(table, acc["a"] * ALPHABET + b))
        return F.struct(b.alias("a"), (acc["s"] + gain).alias("s"))

    return F.aggregate(codes, start, step)["s"]


def _ranked(rank: int, kind: str) -> Column:
    spans = F.coalesce(F.col(kind), F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end) by
    start, then kind in the order of ``KINDS``; positions in code points, end exclusive.

    A model's span never overlaps a rule's span. A null or empty text has no spans. Repeated
    rows and null ids keep their row. An empty table gives an empty result; other columns are
    not read.
    """
    rows = _spans(base_spans(docs, id_col, text_col), RUN, "markov").drop("_t")
    base = [F.coalesce(F.col(k), F.array().cast("array<struct<start:int,end:int,value:string>>")) for k in KINDS[:3]]
    rows = rows.withColumn("_base", F.concat(*base))

    def random(s: Column) -> Column:
        score, apart = _score(s["value"], model), ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return apart & (score >= model.least_total) & (score >= model.least_mean * (F.length(s["value"]) - 1))

    rows = rows.withColumn("markov", F.when(F.col("markov").isNotNull(), F.filter("markov", random)))
    ranked = [_ranked(i, kind) for i, kind in enumerate(KINDS)]
    ordered = F.transform(F.array_sort(F.concat(*ranked)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", ordered.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
