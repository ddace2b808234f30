"""The corpus pipeline: toxicity, line dedup, near copies, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import bpe, decontam, line_dedup, ngram_join, toxicity
from sensorloom.llm.queries import tokenizer_file, toxicity_model
from sensorloom.session import bounded_batches, table, written


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go; it learns from the labelled rows of the documents given."""
    bounded_batches(spark)
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; every document stays."""
    bounded_batches(spark)
    return _counted(line_dedup.drop_repeated_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; documents without words stay."""
    bounded_batches(spark)
    return ngram_join.keep_firsts(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of benchmark items are cut out of the texts; every document stays."""
    bounded_batches(spark)
    return _counted(decontam.remove_benchmark(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to."""
    bounded_batches(spark)
    return bpe.encode_documents(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("byte_bpe", encode),
]

#: A fitted classifier and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
