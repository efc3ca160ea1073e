"""Declared column types and the header-less ``name,type`` files that hold them."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import types as T

#: The spellings of types, exactly as files have them, and what Spark keeps them as.
SPELLINGS = {
    "BIGINT": "BIGINT", "int64": "BIGINT",
    "INTEGER": "INTEGER", "INTENGER": "INTEGER",
    "SMALLINT": "SMALLINT",
    "TEXT": "TEXT", "string": "TEXT",
    "VARCHAR": "VARCHAR(255)", "VARCHAR(255)": "VARCHAR(255)",
    "CHAR": "CHAR",
    "TIMESTAMP": "TIMESTAMP",
    "DATE": "DATE",
    "DOUBLE": "DOUBLE", "double": "DOUBLE", "Float64": "DOUBLE",
}
SPARK = {"BIGINT": T.LongType(), "INTEGER": T.IntegerType(), "SMALLINT": T.ShortType(), "TEXT": T.StringType(), "VARCHAR(255)": T.StringType(), "CHAR": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "DATE": T.DateType(), "DOUBLE": T.DoubleType()}
DECLARED = "declared_type"


def field(name: str, spelling: str) -> T.StructField:
    if spelling not in SPELLINGS:
        raise ValueError(f"Invalid schema type: {spelling}")
    declared = SPELLINGS[spelling]
    return T.StructField(name, SPARK[declared], True, {DECLARED: declared})


def make_schema(columns: Iterable[tuple[str, str]]) -> T.StructType:
    fields: dict[str, T.StructField] = {}
    for name, spelling in columns:
        if name in fields:
            raise ValueError(f"Duplicate column in schema: {name}")
        fields[name] = field(name, spelling)
    return T.StructType(list(fields.values()))


def load_schema(path: str) -> T.StructType:
    """The schema in a file of ``name,type`` rows.  The order in the file is the order of columns."""
    with open(path, newline="", encoding="utf-8") as f:
        rows = list(csv.reader(f, strict=True))
    for row in rows:
        if len(row) != 2:
            raise ValueError(f"A schema row has two fields, name and type; this one has {len(row)}: {row}")
    return make_schema((name, kind) for name, kind in rows)


def declared(f: T.StructField) -> str:
    """The declared type of a field, or the one that its Spark type stands for."""
    if DECLARED in f.metadata:
        return f.metadata[DECLARED]
    for name, kind in SPARK.items():
        if f.dataType == kind:
            return name
    raise TypeError(f"{f.name}: {f.dataType.simpleString()} is none of the engine's types")
