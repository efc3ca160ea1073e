"""Mixing sources to target weights by Efraimidis-Spirakis sampling.  DataFrame functions only.

Sources get targets in words (water filling under a cap of so many epochs).  A source takes complete
epochs first.  The rest of its target is a weighted sample without replacement: each document draws
the exponential key -ln(u)/w, u from a hash of its id and w its quality weight, documents are taken in
the order of their keys, and prefix sums of their sizes are held against the budget.

The order is never sorted in one piece: keys fall into buckets (a monotone function of the key, so many
of them that a bucket stays small), bucket totals give each bucket's prefix, and only rows of one bucket
are sorted together.  A source with a third of all rows is spread over all its buckets.

Defined results: a null text has size 0; a null source is a source, after all others; a document is taken
whole, by its midpoint (so a source misses its target by at most half of one document); documents of size 0
take 0 words; rows with null ids draw by their texts; equal keys go by id; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import addressed, fresh, n_words, stored, text_of

#: Rows of a source that one bucket holds, about.
BUCKET_ROWS = 10_000
SYMBOLS = r"[#*$%&|<>]"
#: Sources whose limits are broadcast (some 100 bytes each); with more, they are joined by shuffle.
BROADCAST_SOURCES = 20_000


def quality_weight(text: Column) -> Column:
    """Weight in (0, 1]: texts full of symbols are drawn later."""
    text = text_of(text)
    return F.lit(1.0) / (F.lit(1.0) + F.lit(50.0) * F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.length(text), F.lit(1)))


def key_of(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """-ln(u)/w with u in (0, 1) from 52 bits of a digest of seed and id; a null id gives way to a digest of the text, so that many of them don't share a key."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(text)), F.lit(""))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(2.0**52)) / weight


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), epochs: float = 3) -> DataFrame:
    """One row per source: no_source, source, source_size, target.  ``sizes`` has the columns no_source, source and size.
    Sources are ordered by code point, null last; weights repeat.  Targets share the sum of all sizes; one that would
    pass ``epochs`` times its source stops there and the others share the excess by weight, which is to say that all
    of them stop at one level: the first, by their ratio of cap and weight, that the ones before leave below its cap."""
    each = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy("no_source", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    each = each.withColumn("w", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    each = each.withColumn("level", level).withColumn("free", F.col("cap") / F.col("w") >= F.col("level"))
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(all_)
    return each.withColumn("target", F.least("cap", first * F.col("w"))).select("no_source", "source", "source_size", "target")


def drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: str) -> list[Column]:
    """What the mix has to know of a row: id, no_source, source, size, key."""
    weight = quality_weight(F.col(text_col)) if weight is None else weight
    return [
        F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        n_words(F.col(text_col)).alias("size"), key_of(F.col(id_col), F.col(text_col), weight, seed).alias("key"),
    ]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = "mix", weights: tuple = (1, 2, 3), epochs: float = 3) -> DataFrame:
    """One row per document: id, row, size, source_size, target, times (copies the mix takes), taken (words).  A source's limit comes to the rows,
    which are written as they lie, not as their keys were dealt out."""
    sized = stored(docs.select(*drawn(docs, id_col, text_col, source_col, weight, seed), F.monotonically_increasing_id().alias("row")), "sizes")  # the texts are read once
    order = ["key", "id", "size", "row"]
    upto = limits(sized, order, weights, epochs, "source_size", "target")
    out = sized.join(few(upto), ["no_source", "source"])
    return out.withColumn("times", times(F.col("size"), F.struct(*order), F.col("full"), F.col("upto"))).select("id", "row", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def limits(sized: DataFrame, order: list[str], weights: tuple, epochs: float, *also: str) -> DataFrame:
    """One row per source, stored: no_source, source, full (epochs), upto (the last row, by ``order``, that the mix takes once more; null: none) and
    the columns ``also``.  ``order`` is key, id, size and what tells apart rows that agree in these."""
    each = allotted(sized, order[3:], weights, epochs)
    upto = F.max(F.when(F.col("more") & (F.col("size") > 0), F.struct(*order))).alias("upto")
    return stored(each.groupBy("no_source", "source").agg(F.max("full").alias("full"), upto, *[F.max(c).alias(c) for c in also]), "limits")


def few(upto: DataFrame) -> DataFrame:
    return F.broadcast(upto) if upto.count() <= BROADCAST_SOURCES else upto


def times(size: Column, place: Column, full: Column, upto: Column) -> Column:
    """How often the mix takes a row that has this place in its source's order."""
    more = upto.isNotNull() & (place <= upto)
    return F.when(size > 0, full + F.coalesce(more, F.lit(False)).cast("int")).otherwise(0).cast("long")


def allotted(sized: DataFrame, last: list[str], weights: tuple, epochs: float) -> DataFrame:
    """The stored rows with source_size, target, full (epochs) and more (whether the mix takes them once more).  Rows of one key go by id, size and the columns ``last``.

    What a source takes beyond full epochs is the beginning of its order: a row whose midpoint lies beyond the budget
    ends at or beyond it, and so does whatever comes later."""
    n = max(256, math.ceil(sized.count() / BUCKET_ROWS))
    place = sized.withColumn("bucket", F.floor(F.col("key") / (F.col("key") + 1) * n).cast("int"))
    plan = stored(targets(sized, weights, epochs), "targets")
    sums = place.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    budget = (
        sums.join(plan, ["no_source", "source"])
        .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .select("no_source", "source", "bucket", "source_size", "target", "full", (F.col("target") - F.col("full") * F.col("source_size") - F.coalesce(F.sum("bucket_size").over(upto), F.lit(0))).alias("left"))
    )
    inside = Window.partitionBy("no_source", "source", "bucket").orderBy("key", "id", "size", *last).rowsBetween(Window.unboundedPreceding, -1)
    out = place.join(budget, ["no_source", "source", "bucket"])
    return out.withColumn("more", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2 <= F.col("left"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = "mix", weights: tuple = (1, 2, 3), epochs: float = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.  What decides is how far a source's order is taken, one row per source, so
    texts stay where they are; rows that agree in key, id and size go by their address."""
    docs, slim = addressed(docs, *drawn(docs, id_col, text_col, source_col, weight, seed))
    order = ["key", "id", "size", "file", "at"]
    upto = limits(stored(slim, "sizes"), order, weights, epochs).filter("full > 0 OR upto IS NOT NULL")
    own, copy, of, full, to = (fresh(docs, f"mixed_{x}") for x in ("own", "copy", "of", "full", "upto"))
    upto = upto.select(F.struct("no_source", "source").alias(of), F.col("full").alias(full), F.col("upto").alias(to))
    place = docs.metadataColumn("_metadata")
    row = F.struct(*drawn(docs, id_col, text_col, source_col, weight, seed), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))
    rows = docs.select("*", row.alias(own))
    rows = rows.join(few(upto), F.struct(F.col(own)["no_source"], F.col(own)["source"]) == F.col(of))
    n = times(F.col(own)["size"], F.struct(*[F.col(own)[c].alias(c) for c in order]), F.col(full), F.col(to)).cast("int")
    return rows.filter(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*[F.col(f"`{c}`") for c in docs.columns])
