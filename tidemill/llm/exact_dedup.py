"""Exact dedup by content-defined chunk recipes.  DataFrame functions only.

A text, white space deleted, is cut where its own content says so: at the first punctuation mark
after ``MIN_CHUNK`` characters, at ``MAX_CHUNK`` at the latest.  Each chunk gets a compact 64-bit
identifier.  The chunk dictionary (identifier, SHA-256) is deduplicated over the whole corpus and
*verified*: an identifier that stands for two different SHA-256 digests is not used, and recipes then
carry the digests themselves.  A document is its recipe, the ordered list of chunk identifiers, and
equal recipes are equal texts.  Long texts are read once and never shuffled: what moves is some
8 bytes for each kilobyte of text.

Defined results: a null text counts as empty, all empty texts form one group; a null id sorts last;
repeated rows (same id and text) count one by one, and exactly one row of a group is kept; an empty
table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, addressed, stored, text_of, without

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: Sentence and clause marks, Latin and CJK, at which chunks end.
MARKS = r".,;:!?。，；？،।"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[{MARKS}]|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_of(text), f"[{SPACE}]+", "")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", address: bool = False) -> DataFrame:
    """One row per document: id, row (unique), n_chars of the original text, text_sha256, chunk ids and digests, and the row's
    file and at if they are asked for.  It reads the texts once and is stored."""
    columns = [F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.length(text_of(text_col)).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("t")]
    rows = addressed(docs, *columns)[1] if address else docs.select(*columns)
    out = (
        rows.withColumn("chunks", F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0)))
        .select(
            "id", "row", "n_chars", F.sha2("t", 256).alias("text_sha256"),
            F.transform("chunks", lambda c: F.xxhash64(c)).alias("ids"),
            F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
            *(["file", "at"] if address else []),
        )
    )
    return stored(out, "recipes")


def dictionary(recipes: DataFrame) -> DataFrame:
    """The deduplicated chunks: identifier, digest, number of uses."""
    return recipes.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).groupBy(F.col("c.ids").alias("chunk_id"), F.col("c.digests").alias("digest")).agg(F.count(F.lit(1)).alias("uses"))


def verified(recipes: DataFrame) -> bool:
    """Whether each 64-bit identifier stands for one digest only."""
    return dictionary(recipes).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, row, keep_id, group_size, kept, text_sha256.  Of equal texts, that with the
    most code points before normalisation stays, then that with the smallest id."""
    return judged(recipes(docs, id_col, text_col)).drop("ids", "digests")


def judged(rec: DataFrame) -> DataFrame:
    """The recipes with keep_id, group_size and kept.

    Counting groups combines on the map side, so a group of any size is one row per task; only groups of two
    or more are joined back, from a stored table, which lets the engine broadcast it if it is small and split
    the skewed side of the join if it is not."""
    key = "ids" if verified(rec) else "digests"
    rank = F.struct((-F.col("n_chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row").alias("d"))
    many = rec.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("first")).filter("group_size > 1")
    many = stored(many.select(F.col(key).alias("k"), "group_size", F.col("first.c").alias("keep_id"), F.col("first.d").alias("keep_row")), "copies")
    return rec.join(many, rec[key] == many["k"], "left").select(
        "id", "row",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256", "ids", "digests", *(c for c in ("file", "at") if c in rec.columns),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less the copies.  Rows are told apart by their address, so ids that repeat or are null
    are safe; of rows that agree in everything, one stays.  Texts stay where they are while copies are few (``common.BROADCAST_ROWS``)."""
    docs, _ = addressed(docs)
    gone = judged(recipes(docs, id_col, text_col, address=True)).filter(~F.col("kept")).select("file", "at")
    return without(docs, stored(gone, "gone"))
