"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import exact, near, packing, quality, toxicity
from siftline.llm.common import drop_scratch, scratch_table
from siftline.llm.queries import read, tokenizer_file



#: Rows of texts that are scored at once. What the JVM and a Python worker hold grows with them, and
#: the stages that follow in the same executors do not get all of it back.
TEXT_ROWS = 1000
#: The table that the last result was read from.
_read_from: list[DataFrame] = []


def in_batches(kept: DataFrame, label: str) -> DataFrame:
    """A stage's result, its texts scored ``TEXT_ROWS`` at a time."""
    _read_from.append(scratch_table(kept, label, TEXT_ROWS))
    return _read_from[-1]


def drop_read() -> None:
    """A stage begins when the result before it has been written, so what that was read from goes."""
    while _read_from:
        if (table := _read_from.pop()).sparkSession.sparkContext._jsc:
            drop_scratch(table)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return in_batches(kept, "not-toxic")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer rejects go."""
    drop_read()
    return in_batches(quality.drop_poor(docs, quality.train(docs)), "not-poor")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    drop_read()
    return exact.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8 or more."""
    return near.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut and packed; one row per piece."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", simhash_stage),
    ("packing", packing_stage),
]

#: The learned stages and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    was = None
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
        if was is not None:
            drop_scratch(was)
        was = docs
    return STAGES[-1][1](spark, docs, sf_dir)
