"""Cleaning and encoding of ``documents`` in five stages.

Each stage's result is written as Parquet and read again as the next stage's input. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, exact_dedup, near, toxicity
from tessera.llm._util import free_name, small_batches, stored

#: Stages 1 to 4 need the documents' columns doc_id and text; others may be there or not.
TOKENIZER = "byte_bpe_50k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go. The model learns from all labels; null texts
    score like empty ones, rows without an id and repeated rows like any other. Without toxic labels
    all stay; an empty table gives an empty result."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    score = free_name(docs, "_toxicity")
    return docs.withColumn(score, toxicity.toxicity(F.col("text"), model)).filter(F.col(score) < 0.5).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, chosen as in ``exact_groups``."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8 or more."""
    small_batches(spark)
    return near.drop_near(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or paraphrased, go. Null and empty texts hold
    none; repeated rows go or stay together; an empty benchmark or table changes nothing."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, decontaminate.searchers(docs, benchmark))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from them."""
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path(TOKENIZER)
    return bpe.round_trip(docs, path)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", bpe_stage),
]

#: No stage after the second can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
