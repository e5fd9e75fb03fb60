"""The thin ``opN_<name>`` queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, decontam, jaccard, lm, quality, rans, sharding, topk, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the published vocabulary file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.train(docs), out="s").select("doc_id", "s.*")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs.select("doc_id", "text"), model, out="t").select("doc_id", "t.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), out="d").select("doc_id", "d.*").drop("spans")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"), out="n_tokens").select("doc_id", "n_tokens")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = rans.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return rans.read_digests(segments)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, tokenizer_path("word_bpe_49k.json"), out="b").select("doc_id", "b.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs.select("doc_id", "text"), model, out="q")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "q.score", "q.predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_topk, op2_pseudo_likelihood, op3_jaccard, op4_toxicity, op5_decontaminate, op6_token_counts, op7_shard, op8_token_file, op9_bpe, op10_quality]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {k: v for k, v in sql.ORACLE.items() if k in queries()}
