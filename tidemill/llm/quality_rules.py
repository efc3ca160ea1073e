"""Quality rules with distribution divergence.  DataFrame functions only.

Each language gets two references, counted over all of its documents: the histogram of its character
classes, and that of its ``TOP`` most common words (all others as one class).  A document is held against
both by Jensen-Shannon distance (base 2, so 0 to 1) and rejected beyond a threshold.  Guards: below
``MIN_CHARS`` characters, or ``MIN_WORDS`` words, a histogram says nothing and that comparison is left out.
Every language has a reference of characters; one of words needs ``MIN_REFERENCE`` words in all, however flat they are.

Counts for the rules of thumb: characters in words, symbols, lines that repeat an earlier one, and words that
lie in 5-word windows found twice or more.  All are worked out inside the row, so texts are never shuffled; what is
shuffled are word counts by language, combined on the map side.  Ranking takes the best ``TOP`` of each
partition before any shuffle, so it is bounded work for a language with any number of words.

Defined results: a null text has no words and fails; a null language is a language of its own; rows may repeat;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, WORD, stored, text_of

TOP = 20
MIN_CHARS, MIN_WORDS, MIN_REFERENCE = 200, 50, 1000
#: Square roots of 0.10 and 0.17.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.10**0.5, 0.17**0.5
#: Languages whose references are broadcast (some 2 kB each); with more, they are joined by shuffle.
BROADCAST_LANGUAGES = 2000
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Character classes; what is in none of them is the last class, of other ASCII.
CLASSES = {"lower": "[a-z]", "space": f"[{SPACE}]", "upper": "[A-Z]", "stop": r"[.,;:?!'\"()-]", "digit": "[0-9]", "wide": r"[^\x00-\x7F]"}


def with_classes(rows: DataFrame, text: str, counts: str) -> DataFrame:
    """``rows`` with an array of the number of characters in each class.  Classes are taken out one after another, the commonest first, so that only
    the first pass goes over all of the text; what is left after the last is in ``counts`` + "_rest"."""
    left = [text, *(f"{counts}_{k}" for k in range(len(CLASSES) - 1)), f"{counts}_rest"]
    for a, b, pattern in zip(left, left[1:], CLASSES.values(), strict=False):
        rows = rows.withColumn(b, F.regexp_replace(a, pattern + "+", ""))
    known = [F.length(a) - F.length(b) for a, b in zip(left, left[1:], strict=False)]
    return rows.withColumn(counts, F.array(*known, F.length(left[-1]))).drop(*left[1:-1])


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: the square root of the divergence to base 2, so 0 to 1."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    js = F.aggregate(F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(js, F.lit(0.0)))


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / total)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per language: no_lang, lang, chars (shares by class), words (the most common), word_shares (theirs, then all others')."""
    lang = [F.col(lang_col).isNull().alias("no_lang"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")]
    text = text_of(text_col)
    n = len(CLASSES) + 1
    by_class = with_classes(docs.select(*lang, text.alias("t")), "t", "c").select("no_lang", "lang", "c").groupBy("no_lang", "lang").agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(n)])
    by_class = by_class.withColumn("c", F.array(*[f"c{i}" for i in range(n)])).withColumn("all", reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(n)]))
    by_class = by_class.select("no_lang", "lang", shares(F.col("c"), F.greatest("all", F.lit(1))).alias("chars"))
    words = docs.select(*lang, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("w")).groupBy("no_lang", "lang", "w").agg(F.count(F.lit(1)).alias("n"))
    words = stored(words, "words")  # used twice
    total = words.groupBy("no_lang", "lang").agg(F.sum("n").alias("total"))
    first = Window.partitionBy("no_lang", "lang").orderBy(F.desc("n"), "w")
    common = words.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= TOP)  # a limit by group: each task passes on TOP of its words
    common = common.join(total, ["no_lang", "lang"]).groupBy("no_lang", "lang", "total").agg(F.sort_array(F.collect_list(F.struct("k", "w", "n"))).alias("top")).filter(F.col("total") >= MIN_REFERENCE)
    share = F.transform("top", lambda t: t["n"] / F.col("total"))
    common = common.select("no_lang", "lang", F.transform("top", lambda t: t["w"]).alias("words"), F.concat(share, F.array(1 - F.aggregate(share, F.lit(0.0), lambda s, x: s + x))).alias("word_shares"))
    return stored(by_class.join(common, ["no_lang", "lang"], "left"), "references")


def repeated_words(words: str, grams: str, sorted_: str) -> tuple[Column, Column, Column]:
    """Columns to add one after another, so that none is worked out inside a lambda: hashes of the windows of ``words`` (hashes, too); these with their
    places, sorted, where any repeats (else null); the number of words in windows that repeat."""
    window = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WINDOW)]))
    hashes = F.when(F.size(words) >= WINDOW, window)
    placed = F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    s = F.col(sorted_)
    same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))  # each with the next
    twice = F.zip_with(s, F.zip_with(same, F.concat(F.array(F.lit(False)), same), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))), lambda a, d: F.when(d, a["i"]))
    at = F.array_sort(F.array_compact(twice))
    covered = F.aggregate(at, F.struct(F.lit(-WINDOW).alias("end"), F.lit(0).alias("n")), lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n")), lambda acc: acc["n"])
    return hashes, placed, F.when(s.isNull(), F.lit(0)).otherwise(covered).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, the base counts, char_distance and word_distance (null where a guard holds).  Words are taken out once;
    from then on their 64-bit hashes stand for them."""
    refs = references(docs, text_col, lang_col).withColumn("common", F.transform("words", lambda x: F.xxhash64(x)))
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), F.col(lang_col).isNull().alias("no_lang"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")).join(refs, ["no_lang", "lang"], "left")
    rows = with_classes(rows, "t", "cc").withColumns({"raw": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
    rows = rows.withColumns({"w": F.transform("raw", lambda x: F.xxhash64(x)), "low": F.transform("raw", lambda x: F.xxhash64(F.lower(x)))})
    # of words that a reference doesn't have there are none
    each = [F.coalesce(F.size("low") - F.size(F.array_remove("low", F.get("common", F.lit(k)))), F.lit(0)) for k in range(TOP)]
    rows = rows.withColumn("found", F.slice(F.array(*each), F.lit(1), F.greatest(F.size("common"), F.lit(0))))
    hashes, placed, repeated = repeated_words("w", "grams", "placed")
    rows = rows.withColumn("grams", hashes).withColumn("placed", placed)
    n, chars = F.size("w"), F.length("t")
    rest = n - F.aggregate("found", F.lit(0), lambda s, x: s + x)
    symbols = F.length("cc_rest") - F.length(F.regexp_replace("cc_rest", SYMBOLS + "+", ""))  # marks of other ASCII, all of them
    return rows.select(
        "id", n.cast("long").alias("n_words"), (chars - F.get("cc", F.lit(list(CLASSES).index("space")))).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
        F.when((chars >= MIN_CHARS) & F.col("chars").isNotNull(), distance(shares(F.col("cc"), chars), F.col("chars"))).alias("char_distance"),
        F.when((n >= MIN_WORDS) & F.col("words").isNotNull(), distance(F.concat(shares(F.col("found"), n), F.array(rest / n)), F.col("word_shares"))).alias("word_distance"),
    )


def verdicts(docs: DataFrame, **columns: str) -> DataFrame:
    """``measure`` with base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > MAX_WORD_DISTANCE)
    return measure(docs, **columns).withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)
