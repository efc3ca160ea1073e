"""The 43 queries, as plans over a ``hits`` DataFrame.

Each plan names only the columns it uses, so it also runs over a table that has no others.  Ties under ORDER BY ... LIMIT are settled by
the other output columns.  ``having_min`` and ``offset`` stand for the queries' own constants."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import all_of, byte_length, contains, domain, minute_floor, minute_of, not_contains, not_empty
from ..operators.aggregates import Agg, avg, count, count_distinct, global_agg, group_agg, max_, min_, sum_
from ..operators.rows import compute, keep, limit, ordered_limit, project, settled, sort

#: Fixed values of the queries.
COUNTER = 62
USER = 435090932899640449
REFERER_HASH = 3594120000172545465
URL_HASH = 2868770270353813622
HAVING_MIN = 100001


def month(*more: Column, first: int = 1, last: int = 31) -> Column:
    """One site's page views, refreshes left out, in some days of July 2013."""
    days = F.col("EventDate").between(datetime.date(2013, 7, first), datetime.date(2013, 7, last))
    return all_of(F.col("CounterID") == COUNTER, days, F.col("IsRefresh") == 0, *more)


def ranked(df: DataFrame, keys: list[str], aggs: list[Agg], by: str, n: int = 10, offset: int = 0) -> DataFrame:
    """The groups with the largest value of ``by``."""
    out = group_agg(df, keys, *aggs)
    return ordered_limit(out, n, *settled(out, f"-{by}"), offset=offset)


def searches(df: DataFrame) -> DataFrame:
    return keep(df, not_empty("SearchPhrase"))


def views(df: DataFrame, keys: list[str], offset: int, *more: Column) -> DataFrame:
    return ranked(keep(df, month(*more)), keys, [count("PageViews")], "PageViews", offset=offset)


def _engine_width(df: DataFrame, keys: list[str]) -> DataFrame:
    return ranked(df, keys, [count("c"), sum_("IsRefresh"), avg("ResolutionWidth")], "c")


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    return ordered_limit(df, 10, *settled(df, *order))


def _widths(df: DataFrame) -> DataFrame:
    """sum(x + k) is sum(x) + k * count: one sum and one count instead of ninety sums."""
    one = global_agg(df, sum_("ResolutionWidth", "s"), count("n"))
    return one.select(*[(F.col("s") + k * F.col("n")).alias(f"s{k}") for k in range(90)])


def _lengths(df: DataFrame, text: str, key: str, having_min: int, *more: Agg) -> DataFrame:
    out = group_agg(df, [key], avg("len", "l"), count("c"), *more)
    out = keep(out, F.col("c") >= having_min)
    return ordered_limit(out, 25, *settled(out, "-l"))


def _q28(df: DataFrame, having_min: int) -> DataFrame:
    return _lengths(compute(keep(df, not_empty("URL")).select("CounterID", "URL"), {"len": byte_length("URL")}), "URL", "CounterID", having_min)


def _q29(df: DataFrame, having_min: int) -> DataFrame:
    rows = compute(keep(df, not_empty("Referer")).select("Referer"), {"k": domain("Referer"), "len": byte_length("Referer")})
    return _lengths(rows, "Referer", "k", having_min, min_("Referer", "min_referer"))


def _q35(df: DataFrame) -> DataFrame:
    out = group_agg(df, ["URL"], count("c")).select(F.lit(1).cast("bigint").alias("one"), "URL", "c")
    return ordered_limit(out, 10, F.desc("c"), "URL")


def _q36(df: DataFrame) -> DataFrame:
    ip = F.col("ClientIP")
    out = group_agg(df, ["ClientIP"], count("c")).select("ClientIP", *[(ip - F.lit(k)).alias(f"ClientIPMinus{k}") for k in (1, 2, 3)], "c")
    return ordered_limit(out, 10, F.desc("c"), "ClientIP")


def _q40(df: DataFrame, offset: int) -> DataFrame:
    own = F.when((F.col("SearchEngineID") == 0) & (F.col("AdvEngineID") == 0), F.col("Referer")).otherwise("")
    rows = keep(df, month()).select("TraficSourceID", "SearchEngineID", "AdvEngineID", own.alias("Src"), F.col("URL").alias("Dst"))
    return ranked(rows, rows.columns, [count("PageViews")], "PageViews", offset=offset)


def _q43(df: DataFrame, offset: int) -> DataFrame:
    rows = keep(df, month(F.col("DontCountHits") == 0, first=14, last=15)).select(minute_floor("EventTime").alias("M"))
    return ordered_limit(group_agg(rows, ["M"], count("PageViews")), 10, "M", offset=offset)


def _q18(df: DataFrame, settle: bool) -> DataFrame:
    out = group_agg(df, ["UserID", "SearchPhrase"], count("c"))
    return ordered_limit(out, 10, "UserID", "SearchPhrase") if settle else limit(out, 10)


def _q8(df: DataFrame) -> DataFrame:
    out = group_agg(keep(df, F.col("AdvEngineID") != 0), ["AdvEngineID"], count("c"))
    return sort(out, *settled(out, "-c"))


def _q23(df: DataFrame) -> DataFrame:
    rows = keep(df, all_of(contains("Title", "Google"), not_contains("URL", ".google."), not_empty("SearchPhrase")))
    return ranked(rows, ["SearchPhrase"], [min_("URL", "min_url"), min_("Title", "min_title"), count("c"), count_distinct("UserID")], "c")


#: Query to plan of (hits, having_min, offset, settle).
PLANS: dict[int, Callable[..., DataFrame]] = {
    1: lambda d, h, o, s: global_agg(d, count()),
    2: lambda d, h, o, s: global_agg(keep(d, F.col("AdvEngineID") != 0), count()),
    3: lambda d, h, o, s: global_agg(d, sum_("AdvEngineID"), count(), avg("ResolutionWidth")),
    4: lambda d, h, o, s: global_agg(d, avg("UserID")),
    5: lambda d, h, o, s: global_agg(d, count_distinct("UserID")),
    6: lambda d, h, o, s: global_agg(d, count_distinct("SearchPhrase")),
    7: lambda d, h, o, s: global_agg(d, min_("EventDate"), max_("EventDate")),
    8: lambda d, h, o, s: _q8(d),
    9: lambda d, h, o, s: ranked(d, ["RegionID"], [count_distinct("UserID", "u")], "u"),
    10: lambda d, h, o, s: ranked(d, ["RegionID"], [sum_("AdvEngineID"), count("c"), avg("ResolutionWidth"), count_distinct("UserID")], "c"),
    11: lambda d, h, o, s: ranked(keep(d, not_empty("MobilePhoneModel")), ["MobilePhoneModel"], [count_distinct("UserID", "u")], "u"),
    12: lambda d, h, o, s: ranked(keep(d, not_empty("MobilePhoneModel")), ["MobilePhone", "MobilePhoneModel"], [count_distinct("UserID", "u")], "u"),
    13: lambda d, h, o, s: ranked(searches(d), ["SearchPhrase"], [count("c")], "c"),
    14: lambda d, h, o, s: ranked(searches(d), ["SearchPhrase"], [count_distinct("UserID", "u")], "u"),
    15: lambda d, h, o, s: ranked(searches(d), ["SearchEngineID", "SearchPhrase"], [count("c")], "c"),
    16: lambda d, h, o, s: ranked(d, ["UserID"], [count("c")], "c"),
    17: lambda d, h, o, s: ranked(d, ["UserID", "SearchPhrase"], [count("c")], "c"),
    18: lambda d, h, o, s: _q18(d, s),
    19: lambda d, h, o, s: ranked(d.select("UserID", minute_of("EventTime").alias("m"), "SearchPhrase"), ["UserID", "m", "SearchPhrase"], [count("c")], "c"),
    20: lambda d, h, o, s: project(keep(d, F.col("UserID") == USER), ["UserID"]),
    21: lambda d, h, o, s: global_agg(keep(d, contains("URL", "google")), count()),
    22: lambda d, h, o, s: ranked(keep(d, contains("URL", "google") & not_empty("SearchPhrase")), ["SearchPhrase"], [min_("URL", "min_url"), count("c")], "c"),
    23: lambda d, h, o, s: _q23(d),
    24: lambda d, h, o, s: _ordered(keep(d, contains("URL", "google")), "EventTime"),
    25: lambda d, h, o, s: project(_ordered(searches(d).select("SearchPhrase", "EventTime"), "EventTime"), ["SearchPhrase"]),
    26: lambda d, h, o, s: _ordered(project(searches(d), ["SearchPhrase"]), "SearchPhrase"),
    27: lambda d, h, o, s: project(_ordered(searches(d).select("SearchPhrase", "EventTime"), "EventTime", "SearchPhrase"), ["SearchPhrase"]),
    28: lambda d, h, o, s: _q28(d, h),
    29: lambda d, h, o, s: _q29(d, h),
    30: lambda d, h, o, s: _widths(d),
    31: lambda d, h, o, s: _engine_width(searches(d), ["SearchEngineID", "ClientIP"]),
    32: lambda d, h, o, s: _engine_width(searches(d), ["WatchID", "ClientIP"]),
    33: lambda d, h, o, s: _engine_width(d, ["WatchID", "ClientIP"]),
    34: lambda d, h, o, s: ranked(d, ["URL"], [count("c")], "c"),
    35: lambda d, h, o, s: _q35(d),
    36: lambda d, h, o, s: _q36(d),
    37: lambda d, h, o, s: views(d, ["URL"], 0, F.col("DontCountHits") == 0, not_empty("URL")),
    38: lambda d, h, o, s: views(d, ["Title"], 0, F.col("DontCountHits") == 0, not_empty("Title")),
    39: lambda d, h, o, s: views(d, ["URL"], 1000 if o is None else o, F.col("IsLink") != 0, F.col("IsDownload") == 0),
    40: lambda d, h, o, s: _q40(d, 1000 if o is None else o),
    41: lambda d, h, o, s: views(d, ["URLHash", "EventDate"], 100 if o is None else o, F.col("TraficSourceID").isin(-1, 6), F.col("RefererHash") == REFERER_HASH),
    42: lambda d, h, o, s: views(d, ["WindowClientWidth", "WindowClientHeight"], 10000 if o is None else o, F.col("DontCountHits") == 0, F.col("URLHash") == URL_HASH),
    43: lambda d, h, o, s: _q43(d, 1000 if o is None else o),
}


def build_query(hits: DataFrame, query: int, having_min: int = HAVING_MIN, offset: int | None = None, settle: bool = False) -> DataFrame:
    """The plan of query 1 to 43.  ``offset`` replaces a query's own; ``settle`` gives query 18, a bare LIMIT, an order."""
    if query not in PLANS:
        raise ValueError("the query's number must be from 1 to 43")
    return PLANS[query](hits, having_min, offset, settle)
