"""The corpus pipeline: quality, toxicity, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on every row of its predecessor and returns a
DataFrame; :func:`run` writes each stage as Parquet in the shared folder and reads it as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plangrove.llm import bpe, decontam, jaccard, quality, toxicity
from plangrove.llm.common import materialise, table
from plangrove.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality model predicts to be bad."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model, out="__q").where("__q.predicted = 1").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents judged toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model, out="__t").where("NOT __t.toxic").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, once.

    Rows count one by one, by id and text: those that repeat an id, or have none, are kept unless another row is their
    near-duplicate or equals them in both. A null id is the largest; ties go by a hash of the text.
    """
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text", F.col("text").isNull())
    rows = docs.withColumn("__row", key)
    found = jaccard.join(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id").distinct()
    named = found.join(rows.select("__row", "doc_id").distinct(), "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__row"))
    return rows.join(first, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages contaminate."""
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), out="__d")
    return judged.where("NOT __d.contaminated").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is kept."""
    return bpe.encode_digests(docs, tokenizer_path("word_bpe_49k.json"), out="__b").select("doc_id", "__b.*")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near-duplicates", one_of_each),
    ("decontamination", drop_contaminated),
    ("bpe", tokens),
]

#: The classifiers are fitted models and BPE is no SQL function.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}", clean=True)
    return docs
