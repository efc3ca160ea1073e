"""Scan, filter, compute, project, limit, sort: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Order = str | Column


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Parquet scan.  The one predicate both filters rows exactly and, pushed down, skips row groups by their
    statistics; only the columns asked for are read.  ``columns`` may be empty: rows are then counted from metadata."""
    df = spark.read.parquet(path)
    df = df if predicate is None else df.filter(predicate)
    return df if columns is None else df.select(*columns)


def _applied(df: DataFrame, f: Callable[[dict], object], kind: str) -> Column:
    return F.udf(lambda row: f(row.asDict()), kind, useArrow=True)(F.struct(*df.columns))


def keep(df: DataFrame, condition: Column | Callable[[dict], bool]) -> DataFrame:
    """Filter by a condition; a function of a row is an escape hatch and runs in Python."""
    return df.filter(condition if isinstance(condition, Column) else _applied(df, condition, "boolean"))


def compute(df: DataFrame, specs: Mapping[str, Column | tuple[Callable[[dict], object], str]]) -> DataFrame:
    """Appends columns.  All of them see the input only; a name that exists is an error."""
    if taken := [name for name in specs if name in df.columns]:
        raise ValueError(f"Duplicate column in schema: {taken[0]}")
    made = [(s if isinstance(s, Column) else _applied(df, *s)).alias(name) for name, s in specs.items()]
    return df.select("*", *made)


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, in that order."""
    for name in names:
        if name not in df.columns:
            raise KeyError(f"Column not found in schema: {name}")
    if len(set(names)) < len(names):
        raise ValueError("A column can be projected once")
    return df.select(*names)


def sort(df: DataFrame, *order: Order) -> DataFrame:
    return df.orderBy(*order)


def top_k(df: DataFrame, k: int, *order: Order) -> DataFrame:
    """Planned as a bounded heap in each task and one merge."""
    return df.orderBy(*order).limit(k)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def ordered_limit(df: DataFrame, n: int, *order: Order, offset: int = 0) -> DataFrame:
    """Rows offset to offset + n of the order."""
    return limit(df.orderBy(*order), n, offset)


def settled(df: DataFrame, *order: str) -> list[Order]:
    """An order (names; a leading minus is descending) with all other columns after it, so that ties are settled."""
    names = [o.lstrip("-") for o in order]
    return [F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in order] + [F.asc(c) for c in df.columns if c not in names]
