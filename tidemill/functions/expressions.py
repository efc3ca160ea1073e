"""Predicates and scalar functions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Scheme, one ``www.``, host; only if a slash follows.
_HOST = r"(?s)^https?://(?:www\.)?([^/]*)/.*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(*conditions: Column) -> Column:
    """Conjunction; of nothing, true."""
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def not_empty(c: str | Column) -> Column:
    return _col(c) != ""


def contains(c: str | Column, part: str) -> Column:
    """Literal, case-sensitive substring."""
    return F.contains(_col(c), F.lit(part))


def not_contains(c: str | Column, part: str) -> Column:
    return ~contains(c, part)


def byte_length(c: str | Column) -> Column:
    return F.octet_length(_col(c)).cast("bigint")


def minute_of(c: str | Column) -> Column:
    return F.minute(_col(c)).cast("bigint")


def minute_floor(c: str | Column) -> Column:
    return F.date_trunc("minute", _col(c)).cast("timestamp_ntz")


def domain(c: str | Column) -> Column:
    """Host of an http(s) URL without one leading ``www.``; anything without a slash after the host stays as it is."""
    return F.regexp_replace(_col(c), _HOST, "$1")


def widened_plus(c: str | Column, k: int) -> Column:
    return _col(c).cast("bigint") + F.lit(k).cast("bigint")
