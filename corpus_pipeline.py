"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet, and the next stage reads that. All stages but the last return the columns
of documents, each of the documents they keep.

Defined results: a null text counts as empty; rows without an id, and rows that
repeat one, are documents of their own by their texts, and of rows that repeat both
one stays; equal and nearly equal texts leave the row with the smallest id; a null
label is none; without labels of both classes no document is toxic; empty tables
give an empty result. What else the operators define for such cases holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm import exact_dedup, minhash, mixing, packing, toxicity
from gridwright.llm.common import settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go (operator 6)."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays (operator 8)."""
    return exact_dedup.drop_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays (operator 4)."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says (operator 3)."""
    return mixing.emit_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids (operator 1)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no form for the models, signatures and packing; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents. What a stage wrote goes when the next one has read it."""

    def after(docs: DataFrame, left: list) -> DataFrame:
        if not left:
            return docs
        (name, stage), rest = left[-1], left[:-1]
        return settled(spark, f"stage-{name}", lambda: stage(spark, after(docs, rest), sf_dir))

    return after(table(spark, sf_dir, "documents"), STAGES)
