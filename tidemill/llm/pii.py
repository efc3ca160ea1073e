"""Personal data by bootstrapped contextual extraction.

Seeds are spans that four exact rules find: e-mail addresses, IP addresses, card numbers that pass Luhn, and phone numbers.  The
rules scan in linear time: runs that a backtracking engine would try from each of their characters are tried once.

Bootstrapping.  An *instance* is a seed or anything else that looks like an identifier: a token with an @, one of ``MIN_DIGITS`` digits or more
and marks, or several of these with single spaces between them, 7 to 19 digits in all.  A *pattern* is what stands next to it: the last word or
the last two before it, the first or the first two after it, whatever their length.  Spark counts the graph of patterns and instances over the
whole corpus and scores it in rounds: a pattern's confidence in a kind is the share of its occurrences whose instance is held to be
of that kind (smoothed); an unseen instance's is a noisy-or over the confident patterns that it occurs with, and one of sufficient score, whose
shape suits the kind, is held to be of it from then on.  Rounds go on until one adds nothing; as none takes anything away, there is such a
round.  An unseen instance becomes a span wherever a confident pattern of its kind stands next to it.  Seeds always stay.

The texts are read once; what is shuffled are counts of pairs, combined on the map side, and spans.

Defined results: a null text is empty; rows may repeat, and repeat as evidence; a null id stays; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, stored

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS, MIN_SUPPORT = 5, 5
CONFIDENT, ACCEPTED, SMOOTH = 0.8, 0.8, 1.0
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NUMBER = re.compile(r"[+(]?[0-9][0-9.()/-]*").fullmatch
_LOWER = {c: c + 32 for c in range(65, 91)}
_MARKS = ".,;:!?\"'()[]{}<>=|#*$%&"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
        last = max(last, 0)
    return out


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), sorted."""
    found = [(0, *s) for s in emails(text)]
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := q.lstrip("0") or "0") <= 3 and int(p) <= 255 for q in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def suits(token: str) -> int:
    """Kinds, as bits, that a token's shape suits."""
    if "@" in token:
        return 1
    digits = sum("0" <= c <= "9" for c in token)
    if digits < MIN_DIGITS or any(not ("0" <= c <= "9" or c in ".+-()/") for c in token):
        return 0
    return 2 * (2 <= token.count(".") <= 4) + 4 * (12 <= digits <= 19) + 8 * (7 <= digits <= 15)


def phrases(words: list[str], words_: int = 2) -> list[list[str]]:
    """The first word and the first two, without marks, in lower case (A-Z) and with words of marks alone left out."""
    near = [w for w in (x.strip(_MARKS).translate(_LOWER) for x in words) if w][:words_]
    return [near[:k] for k in range(1, len(near) + 1)]


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int], int]]:
    """(kind or -1, start, end, shape, hashes of the patterns, hash of the instance) of seeds and of whatever else looks like an identifier.
    The time is linear in the text: a token is looked at once for itself and as context of the few identifiers that are next to it."""
    taken = sorted((s, e) for _, s, e in found)
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [s for s, _ in tokens]
    out: list[tuple] = []

    def number(x: str) -> int:
        return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)

    def add(kind: int, s: int, e: int, shape: int) -> None:
        i, j = bisect_right(starts, s) - 1, bisect_right(starts, e - 1) - 1
        left = [text[tokens[i][0] : s], *(text[slice(*x)] for x in tokens[max(0, i - 2) : i][::-1])]
        right = [text[e : tokens[j][1]], *(text[slice(*x)] for x in tokens[j + 1 : j + 3])]
        patterns = [" ".join(x[::-1]) + " <" for x in phrases(left)] + ["> " + " ".join(x) for x in phrases(right)]
        out.append((kind, s, e, shape, [number(p) for p in patterns], number(text[s:e])))

    def bare(k: int) -> tuple[int, int]:
        """A token without the marks around it; an opening bracket that it closes stays."""
        s, e = tokens[k]
        t = text[s:e]
        s += len(t) - len(t.lstrip(_MARKS))
        e -= len(t) - len(t.rstrip(_MARKS))
        return (s - 1, e + 1) if s > tokens[k][0] and e < tokens[k][1] and text[s - 1] + text[e] == "()" else (s, max(s, e))

    def free(s: int, e: int) -> bool:
        k = bisect_right(taken, (s, e))
        return s < e and not (k and taken[k - 1][1] > s) and not (k < len(taken) and taken[k][0] < e)

    for kind, s, e in found:
        add(kind, s, e, 1 << kind)
    done = -1
    for m in _HINT.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if k <= done:
            continue
        run = [bare(k)]
        last = k
        while _NUMBER(text[run[-1][0] : run[-1][1]]) and run[-1][1] == tokens[last][1] and last + 1 < len(tokens) and tokens[last + 1][0] == tokens[last][1] + 1 and text[tokens[last][1]] == " ":
            nxt = bare(last + 1)
            if nxt[0] != tokens[last + 1][0] or not _NUMBER(text[nxt[0] : nxt[1]]):
                break
            run.append(nxt)
            last += 1
        done = last
        s, e = run[0][0], run[-1][1]
        if len(run) > 1 and 7 <= sum("0" <= c <= "9" for c in text[s:e]) <= 19 and free(s, e):
            if shape := suits(text[s:e].replace(" ", "")):
                add(-1, s, e, shape)
                continue
        for s, e in run:
            if free(s, e) and (shape := suits(text[s:e])):
                add(-1, s, e, shape)
    return out


def extracted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored, one row per document: row, id, found (its seeds), candidates."""
    kind = docs.schema[id_col].dataType
    types = [pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("shape", pa.int32()), ("patterns", pa.list_(pa.int64())), ("instance", pa.int64())]))]
    schema = f"id {kind.simpleString()}, found array<struct<kind:int,start:long,end:long>>, candidates array<struct<kind:int,start:long,end:long,shape:int,patterns:array<long>,instance:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, others = [], []
            for text in b.column(1).to_pylist():
                spans = seeds(text) if text and _HINT.search(text) else []
                found.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans])
                others.append([dict(zip(("kind", "start", "end", "shape", "patterns", "instance"), x, strict=True)) for x in (candidates(text, spans) if text and _HINT.search(text) else [])])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(to_arrow_type(kind)), pa.array(found, types[0]), pa.array(others, types[1])], ["id", "found", "candidates"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "spans")


def bootstrap(rows: DataFrame) -> DataFrame:
    """Stored, (pattern, kind, confidence) of the confident patterns and the unseen instances they reach, scored: pattern, instance, kind, score."""
    occurrences = rows.select(F.explode("candidates").alias("c")).select("c.kind", "c.shape", "c.instance", F.explode("c.patterns").alias("pattern"))
    graph = stored(occurrences.groupBy("pattern", "instance", "kind", "shape").agg(F.count(F.lit(1)).alias("n")), "graph")
    known = graph.filter("kind >= 0").select("pattern", "instance", "kind", F.col("n").cast("double").alias("weight"))
    total = graph.groupBy("pattern").agg(F.sum("n").alias("total"), F.count_distinct("instance").alias("support")).filter(F.col("support") >= MIN_SUPPORT)
    total = stored(total, "patterns")
    kinds = F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))]))
    unseen = graph.filter("kind < 0").withColumn("kind", kinds).filter(F.expr("(shape & shiftleft(1, kind)) <> 0")).select("pattern", "instance", "kind", F.col("n").cast("double").alias("n"))
    unseen = stored(unseen.join(total.select("pattern"), "pattern", "left_semi"), "unseen")
    held, n = None, 0  # the unseen instances that are held to be of a kind, and their number
    while True:
        believed = known if held is None else known.union(unseen.join(held, ["instance", "kind"]).select("pattern", "instance", "kind", "n"))
        confidence = believed.groupBy("pattern", "kind").agg(F.sum("weight").alias("weight")).join(total, "pattern")
        confidence = stored(confidence.select("pattern", "kind", (F.col("weight") / (F.col("total") + SMOOTH)).alias("confidence")).filter(F.col("confidence") >= CONFIDENT / 2), "confidence")
        scores = unseen.join(confidence, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        held = stored(scores.filter(F.col("score") >= ACCEPTED), "held")
        if (more := held.count()) == n:
            break
        n = more
    sure = confidence.filter(F.col("confidence") >= CONFIDENT).select("pattern", "kind")
    return stored(unseen.join(held, ["instance", "kind"]).join(sure, ["pattern", "kind"]).select("pattern", "instance", "kind", "score"), "discovered")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, row, base (the seeds' spans) and spans (with the discovered ones): arrays of kind, start, end by kind and start."""
    rows = extracted(docs, id_col, text_col)
    found = bootstrap(rows)
    new = rows.select("row", F.explode(F.filter("candidates", lambda c: c["kind"] < 0)).alias("c")).select("row", "c.start", "c.end", "c.instance", F.explode("c.patterns").alias("pattern"))
    new = new.join(found, ["pattern", "instance"]).groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    new = new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))  # of one document's tokens
    each = rows.select("row", "id", "found").join(new, "row", "left")
    return each.select("id", "row", F.col("found").alias("base"), F.sort_array(F.concat("found", F.coalesce("new", F.expr("CAST(array() AS array<struct<kind:int,start:long,end:long>>)")))).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins within the one before it only hides what is left of it."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.concat(acc["out"], kept, F.lit("["), F.get(names, s["kind"]), F.lit("]")).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
