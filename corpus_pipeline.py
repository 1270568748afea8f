"""From raw documents to encoded training data: quality rules, near-duplicate join, personal data, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents. Documents that the quality rules reject go; of each group of near
copies the document with the least id stays; personal data is masked; the mix repeats or leaves out documents until each
source meets its target, in training order; the last stage encodes what is left.

Null texts and empty tables pass through every stage as its operator says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.functions.frames import forget, settled
from veilframe.llm import chosen_path, curriculum, pieces, pii, quality
from veilframe.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.distinct(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.ordered(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data), ("mixing to target weights", mixing), ("SentencePiece encoding", encoding)]

#: Neither the join nor the segmentation can be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written goes when the next one's rows are there."""
    before, docs = None, table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if before is not None:
            forget(before)
        before = docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
