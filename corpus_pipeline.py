"""The corpus pipeline: quality, near-duplicates, personal data, mixing, tokens; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, mixing, ngram_join, pii, quality
from foliant.llm.common import Stash, table


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*like.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the ratings of documents that are here; those that are likelier below grade 1 go."""
    rated = docs.select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    model = quality.train(spark, rated, "doc_id", "text", "quality")
    return _as_documents(quality.judged(docs, model).where(F.col("tail_probability") >= quality.KEEP), docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that with the smallest id."""
    return _as_documents(ngram_join.one_of_each(spark, docs), docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; n_chars follows."""
    found = pii.redacted(docs)
    return _as_documents(found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    made = mixing.plan(spark, docs, F.array("source"))
    taken = mixing.with_copies(docs, made, F.array("source")).where("copies > 0")
    return _as_documents(taken.withColumn("__pass", F.explode(F.expr("sequence(1L, copies)"))), docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256) of each row."""
    out = bpe.encode_column(docs.select("doc_id", "source", "text"), bpe.vocabulary_file(), digests=True)
    return out.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard),
    ("pii_redaction", pii_redaction),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]
#: SQL expresses neither the trained classifier nor the tokens; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = Stash(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        stash.clear(before)  # the next stage reads what this one has written alone
    return docs
