"""The ``opN_*`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, exact_dedup, labelled, line_dedup, quality, secrets, sharding, simhash, token_store, toxicity
from tessera.llm._util import small_batches, work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    """A public tokenizer file as installed on this machine; operators take the path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", F.size("deleted").alias("n_deleted"), "deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return decontaminate.contaminated(docs, decontaminate.searchers(docs, _table(spark, sf_dir, "benchmark")))


def _judged(docs: DataFrame, score, held_out) -> DataFrame:
    rows = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), labelled.fold("doc_id", 5) == 0
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return _judged(docs, toxicity.toxicity(F.col("text"), model), held_out)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found, spans = secrets.scan(docs, secrets.fit(docs)), F.col("spans")

    def n(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"), n("markov").alias("n_markov"),
    )


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), path)
    return token_store.read_checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), labelled.fold("doc_id", 3) == 1
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return _judged(docs, quality.quality(F.col("text"), model), held_out)


QUERIES = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_simhash_components": op2_simhash_components,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_store": op9_token_store,
    "op10_quality": op10_quality,
}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL}
