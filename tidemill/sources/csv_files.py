"""Header-less typed CSV, in and out, with a faithful round trip.

Reading is strict: a field that is not a value of its column's type, an empty number, a row of the wrong width or an unclosed quote is an
error.  There are no nulls: an empty text is an empty text.  A quote opens and closes a quoted stretch anywhere in a field, two of them within
one are a quote, and a blank line is a row of one empty field.  Known deltas of the reader: dates must exist; of a CHAR the first character is kept.

One large file is read by many tasks, although quoted fields may hold line ends.  Files are split by bytes into lines; quotes are counted by
split; so it is known which splits begin within a quoted stretch, and there the lines up to its record's end go to the split in which that
record began.  What the driver gets is a number for each split and those few lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import declared

QUOTED = ("TEXT", "VARCHAR(255)", "CHAR", "DATE", "TIMESTAMP")
#: A field and what ends it; a quoted stretch.  Nothing is tried twice.
_FIELD = r'((?:[^",]++|"[^"]*+")*+)(?:,|\z)'
_STRETCH = r'"([^"]*+(?:""[^"]*+)*+)"'
#: What the text of a value must look like, besides being one.
_SHAPES = {"BIGINT": "-?[0-9]+", "INTEGER": "-?[0-9]+", "SMALLINT": "-?[0-9]+", "DOUBLE": r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?(?i:inf(?:inity)?|nan)", "DATE": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "TIMESTAMP": "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}.*"}


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))


def _opens(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """For each split whether it begins within a quoted stretch: whether the splits before it have an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    out, file, inside = {}, None, False
    for r in sorted(lines.groupBy("file", "start").agg(F.sum(quotes).alias("n")).collect(), key=lambda r: (r["file"], r["start"])):
        inside = inside and r["file"] == file
        out[r["file"], r["start"]], file = inside, r["file"]
        inside ^= bool(r["n"] % 2)
    return out


def _tails(lines: DataFrame, inside: dict[tuple[str, int], bool]) -> dict[tuple[str, int], str]:
    """What later splits have of the record that is open at the end of a split."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed: set = set()
        for b in batches:
            for line, file, start, flip in zip(*(c.to_pylist() for c in b.columns), pc.bit_wise_and(pc.count_substring(b.column(0), '"'), 1).to_pylist(), strict=True):
                if inside[file, start] and (file, start) not in closed:
                    if flip:
                        closed.add((file, start))
                    yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "line": [line], "ends": [bool(flip)]})

    found: dict[tuple[str, int], tuple[list[str], bool]] = {}
    for r in lines.mapInArrow(heads, "file string, start long, line string, ends boolean").collect():
        part, _ = found.get((r["file"], r["start"]), ([], False))
        found[r["file"], r["start"]] = ([*part, r["line"]], r["ends"])
    out: dict[tuple[str, int], str] = {}
    splits = sorted(inside)
    for k, s in enumerate(splits):
        parts: list[str] = []
        for t in splits[k + 1 :]:
            if t[0] != s[0] or not inside[t]:
                break
            parts += found[t][0]
            if found[t][1]:
                out[s] = "\n".join(parts)
                break
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows as text, in the column ``record``."""
    lines = _numbered_lines(spark, path)
    inside = {s: x for s, x in _opens(lines).items()}
    tails = _tails(lines, inside) if any(inside.values()) else {}
    inside = {s for s, x in inside.items() if x}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, skipping, out = None, [], False, []

        def close() -> None:
            if held:
                if at not in tails:
                    raise ValueError(f"{at[0]}: a quote is not closed")
                out.append("\n".join([*held, tails[at]]))
                held.clear()

        for b in batches:
            flips = pc.bit_wise_and(pc.count_substring(b.column(0), '"'), 1).to_pylist()
            for line, file, start, flip in zip(*(c.to_pylist() for c in b.columns), flips, strict=True):
                if (file, start) != at:
                    close()
                    at = (file, start)
                    skipping = at in inside
                if skipping:  # the end of a record that began in another split
                    skipping = not flip
                elif held or flip:
                    held.append(line)
                    if flip and len(held) > 1:
                        out.append("\n".join(held))
                        held.clear()
                else:
                    out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])

    return lines.mapInArrow(joined, "record string")


def _value(text: Column, f: T.StructField) -> Column:
    kind = declared(f)
    bad = F.raise_error(F.concat(F.lit(f"Invalid value in {f.name}: "), text))
    if kind in ("TEXT", "VARCHAR(255)"):
        value = text
    elif kind == "CHAR":
        value = F.when(text != "", F.substring(text, 1, 1)).otherwise(bad)
    else:
        first = F.substring(text, 1, 19) if kind == "TIMESTAMP" else text  # whole seconds; what follows is ignored
        value = F.coalesce(F.when(text.rlike(f"^(?:{_SHAPES[kind]})$"), first.try_cast(f.dataType)), bad.cast(f.dataType))
    return value.alias(f.name, metadata=f.metadata)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    record = F.regexp_replace("record", "\r$", "")
    raw = F.regexp_extract_all("record", F.lit(_FIELD), F.lit(1))
    # a match of nothing at the end follows a field that the end itself has ended
    raw = F.when(F.col("record").endswith(","), raw).otherwise(F.slice(raw, F.lit(1), F.greatest(F.size(raw) - 1, F.lit(1))))
    quoted = F.transform(raw, lambda x: F.when(F.contains(x, F.lit('"')), F.replace(F.regexp_replace(x, _STRETCH, "$1"), F.lit('""'), F.lit('"'))).otherwise(x))
    fields = F.when(F.contains("record", F.lit('"')), quoted).otherwise(F.split("record", ",", -1))
    n = len(schema.fields)
    rows = records(spark, path).select(record.alias("record")).select("record", fields.alias("fields"))
    wrong = F.raise_error(F.concat(F.lit(f"A row has not {n} fields: "), F.col("record")))
    rows = rows.select(F.when(F.size("fields") == n, F.col("fields")).otherwise(wrong.cast("array<string>")).alias("fields"))
    return rows.select(*[_value(F.get("fields", F.lit(k)), f) for k, f in enumerate(schema.fields)])


@F.pandas_udf(T.StringType())
def _fifteen_digits(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.15g}")


def _field(f: T.StructField) -> Column:
    c, kind = F.col(f"`{f.name}`"), declared(f)
    if kind == "DOUBLE":
        return F.coalesce(_fifteen_digits(c), F.lit(""))
    if kind == "DATE":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind == "TIMESTAMP":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) if kind in QUOTED else c


def lines(df: DataFrame) -> DataFrame:
    """One CSV line per row, in the column ``value``: texts, dates and times always quoted, numbers never."""
    fields = [_field(f) for f in df.schema.fields]
    return df.select(F.concat_ws(",", *fields).alias("value") if fields else F.lit("").alias("value"))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of CSV parts, written in parallel, in the order of the rows."""
    if df.columns:
        lines(df).write.mode(mode).text(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file: parts are written in parallel and then joined, byte by byte, by the file system's client."""
    spark = df.sparkSession
    parts = f"{path}.parts"
    write_csv(df, parts, "overwrite")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here = jvm.org.apache.hadoop.fs.Path(parts)
    fs = here.getFileSystem(conf)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        if df.columns:
            for name in sorted(s.getPath().toString() for s in fs.listStatus(here) if s.getPath().getName().startswith("part-")):
                source = fs.open(jvm.org.apache.hadoop.fs.Path(name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                source.close()
    finally:
        out.close()
        fs.delete(here, True)
