"""Global and grouped aggregation: count, sum, avg, min, max, exact distinct count."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Agg:
    kind: str
    column: str | None
    name: str


def count(name: str = "count") -> Agg:
    return Agg("count", None, name)


def sum_(column: str, name: str = "sum") -> Agg:
    return Agg("sum", column, name)


def avg(column: str, name: str = "avg") -> Agg:
    return Agg("avg", column, name)


def min_(column: str, name: str = "min") -> Agg:
    return Agg("min", column, name)


def max_(column: str, name: str = "max") -> Agg:
    return Agg("max", column, name)


def count_distinct(column: str, name: str = "uniq") -> Agg:
    return Agg("count_distinct", column, name)


def _expression(df: DataFrame, a: Agg) -> Column:
    if a.kind == "count":
        return F.count(F.lit(1))
    kind = df.schema[a.column].dataType
    if a.kind in ("sum", "avg") and not isinstance(kind, T.NumericType):
        raise TypeError(f"{a.kind}({a.column}): {kind.simpleString()} is not a number")
    c = F.col(a.column)
    if a.kind == "avg" and isinstance(kind, T.LongType):  # exact, whatever the order of summation
        return F.sum(c.cast("decimal(38,0)")).cast("double") / F.count(c)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[a.kind](c)


def global_agg(df: DataFrame, *aggs: Agg) -> DataFrame:
    """One row, also over no rows: then counts and sums are 0, averages 0.0, minimum and maximum null."""
    zero = {"sum": F.lit(0), "avg": F.lit(0.0)}
    made = [(F.coalesce(_expression(df, a), zero[a.kind]) if a.kind in zero else _expression(df, a)).alias(a.name) for a in aggs]
    return df.agg(*made)


def group_agg(df: DataFrame, keys: Sequence[str], *aggs: Agg) -> DataFrame:
    """Keys, then aggregates; without aggregates, the distinct keys."""
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[_expression(df, a).alias(a.name) for a in aggs])
