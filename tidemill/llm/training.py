"""What the classifiers share: labelled rows, all of them or a bounded sample for a trainer that runs on one executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import addressed, located, stored

#: Labelled rows that toxicity's classifier is fitted on, at most: those with the smallest digests of their id.
MAX_LABELLED = 12_000


def remainder(id_col: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % of, F.lit(0))


def labels_of(labels: DataFrame, label: str, trainable: Column, id_col: str) -> DataFrame:
    """id_col, label: one row per id.  ``trainable`` is over the labels' id; of labels of one id that differ, the larger counts."""
    return labels.filter(trainable & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, trainable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, label of all rows that have a label, also where rows share an id.  Ids and addresses are joined; texts are picked where they are read."""
    ids = labels_of(labels, label, trainable, id_col).select(F.col(id_col).alias("id"), "label")
    docs, slim = addressed(docs, F.col(id_col).alias("id"))
    rows = stored(slim.join(ids, "id").select("id", "label", "file", "at"), "labelled")
    picked = located(docs, rows, "inner")
    return picked.select(rows["id"].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), rows["label"].alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trainable: Column, limit: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, label of at most ``limit`` rows, also where rows share an id.  ``trainable`` is over the labels' id; of labels of one id that
    differ, the larger counts.  What is broadcast are ids and then addresses, at most ``limit`` of them; texts are picked where they are read."""
    ids = labels_of(labels, label, trainable, id_col)
    drawn = F.md5(F.col(id_col).cast("string").cast("binary")).alias("drawn")
    ids = ids.select(F.col(id_col).alias("id"), "label", drawn).orderBy("drawn", "id").limit(limit)
    docs, slim = addressed(docs, F.col(id_col).alias("id"))
    rows = slim.join(F.broadcast(ids), "id").orderBy("drawn", "id", "file", "at").limit(limit)
    few = stored(rows.select("id", "label", "file", "at"), "sample")
    picked = located(docs, few, "inner")
    return picked.select(few["id"].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), few["label"].alias("label"))
