"""The corpus pipeline: rejects go, copies go, near copies go, repeated passages go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of `documents`; the last returns the pieces and their places in the sequences.
Results of a stage are written before the next one starts, so a lost executor costs one stage at most,
and the tables that a stage made for itself are removed when the next one begins.

Texts may be null or empty: such documents count as one empty line, as copies of one another, as without
shingles and windows, and are packed as their closing id. A stage without rows returns none.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from gazette.llm.common import Tables, free_name, owned, prepare, table
from gazette.llm.queries import BYTE_BPE, quality_model
from gazette.session import shared_dir

#: Near copies of the pipeline: shingles of five words, a similarity of 0.8 (`op7_ngram_join` keeps its own).
NEAR_WORDS, NEAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the last stage made for itself. Its result has been written before the next stage starts.
LEFT: list[Tables] = []


def stage(work: Stage) -> Stage:
    """Removes what the stage before made for itself, and nothing of anybody else."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        while LEFT:
            LEFT.pop().remove(spark)
        with owned() as tables:
            LEFT.append(tables)
            return work(spark, docs, sf_dir)

    return run


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    score = free_name(docs, "score")
    scored = quality.score(docs, quality_model(spark, sf_dir), keep=docs.columns, name=score)
    return scored.filter(F.col(score) >= 0.5).drop(score)


@stage
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one row that exact de-duplication keeps."""
    return exact_dedup.kept_rows(docs)


@stage
def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


@stage
def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; `n_chars` follows the text."""
    cut = substring_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else cut


@stage
def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), closing=1, carry=F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", unlike_documents),
    ("substring_dedup", without_passages),
    ("packing", packed_documents),
]

#: A fitted classifier has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
