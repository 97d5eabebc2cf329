"""Decoding where ids are put together gives the rows of encoding and decoding one after the other."""

import public_tokenizers

import corpus_pipeline
from tessera.llm import bpe

TEXTS = [None, "", " \n\t", "a  b", "é ́x ", "x" * 50_000, "word " * 20_000, "<|endoftext|> a", "日本 語。", "a\x00 b"]


def test_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "no id"), (3, "a")], "doc_id long, text string")
    by = lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens)
    want = sorted(bpe.decode(bpe.encode(docs, path, chunk_words=1000), path).collect(), key=by)
    assert len(want) == 12 and sorted(bpe.round_trip(docs, path, chunk_words=1000).collect(), key=by) == want
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_the_stage_holds_a_chunk_in_one_worker(spark):
    """No second Python step follows the one that puts ids together."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = corpus_pipeline.bpe_stage(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("MapInArrow") and "decoded" in plan.split("\n")[0]
