"""Corpus pipeline: classify, dedup lines, keep one of each group of near copies, mix, encode and decode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes each stage's rows to the shared folder and reads
them back as the next one's input, so that a lost executor repeats one stage at most.

Defined cases: a null text is scored like an empty one, is one empty line, is linked with
nothing, takes no words and has no tokens; rows with a null id count as one document after
all others for lines, and are told apart by their texts elsewhere; repeated rows are near
copies of each other, so one stays; empty tables give empty results; other columns travel
to the mixture untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import byte_bpe, line_dedup, mixing, ngram_join, quality_cnn
from rasterloom.llm import common as C


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_cnn.keep_good(docs, C.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller id holds go; the documents stay."""
    return line_dedup.filter_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one of the least id stays."""
    return ngram_join.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy of each document, and the SHA-256 of the bytes they decode to."""
    return byte_bpe.round_trip(docs.select("doc_id", "source", "text")).select("doc_id", "source", "ids", "decoded_sha256")


STAGES = [("quality", quality), ("lines", lines), ("near copies", near_copies), ("mixture", mixture), ("encoding", encoding)]

#: The classifier and the encoder have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
