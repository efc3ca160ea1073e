"""A corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed to their weights; what the mix takes
is packed into sequences.

Each stage works on all that its predecessor kept.  ``run`` chains the stages, each written as Parquet to the shared folder and read
again, so that a stage starts from a table and not from its predecessors' plan.

Stages handle what their operators do: null texts are empty texts (clean, one group of copies, of size 0 and so not in the mix), null ids and
sources are values of their own, repeated rows are copies; empty tables give empty tables; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tidemill.llm.common import ship, stored, table
from tidemill.llm.queries import byte_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold.  It learns from the corpus's labels."""
    ship(spark)
    return toxicity.clean(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with similar sets of five-word shingles."""
    ship(spark)
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: where each piece of each document lies."""
    ship(spark)
    out = packing.pack(docs, byte_bpe(), ids="crc32(ids)")
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier, min-max hashing and a tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
