"""From raw documents to encoded ones: toxicity, line dedup, near duplicates, benchmark decontamination, encoding.

Every stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all rows that it gets.
All but the last return those columns; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

In every stage null and empty texts are texts without words and stay, long texts are worked on whole, repeated rows are
rows of their own but in the near-copy stage (one row of a doc_id stays), rows without doc_id stay and are no copies,
an empty table stays empty, and further columns of any name go through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, decontam, jaccard, lines, pieces, toxicity
from graphloom.llm.queries import model_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without labels of toxic ones none does."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, if with an empty text.  Rows without doc_id keep all."""
    return _measured(lines.deduplicate(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays; of rows with one doc_id that whose text has
    the smallest hash."""
    return jaccard.representatives(docs)


def cut_benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows go, and documents that are mostly such spans; a null text stays null."""
    return _measured(decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, as digests; a row for each row, null texts as empty ones."""
    return pieces.digest(docs, model_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark_spans),
    ("sentencepiece", encode),
]

#: The classifier and the encoder are no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        with common.scratch(spark) as keep:
            docs = stage(spark, docs, sf_dir) if i == len(STAGES) - 1 else keep(common.cut(stage(spark, docs, sf_dir)))
        if i < len(STAGES) - 1:
            if last:
                common.scrap(spark, last)
            last = docs._table_path
    return docs
