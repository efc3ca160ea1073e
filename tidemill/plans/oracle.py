"""DuckDB SQL for the 43 queries over the derived ``hits``."""

from __future__ import annotations

from .clickbench import COUNTER, REFERER_HASH, URL_HASH, USER
from .hits import hits_sql

_MONTH = f"CounterID = {COUNTER} AND EventDate BETWEEN DATE '2013-07-01' AND DATE '2013-07-31' AND IsRefresh = 0"
_SEARCH = "SearchPhrase <> ''"
_HOST = "CASE WHEN regexp_matches(Referer, '^https?://(?:www\\.)?([^/]*)/') THEN regexp_extract(Referer, '^https?://(?:www\\.)?([^/]*)/', 1) ELSE Referer END"
_AVG = "coalesce(avg({}), 0.0)"


def _sum(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def _top(keys: str, aggs: str, by: str, where: str = "true", offset: int = 0, n: int = 10) -> str:
    numbers = ", ".join(str(i + 1) for i in range(keys.count(",") + 1))
    return f"SELECT {keys}, {aggs} FROM hits WHERE {where} GROUP BY {numbers} ORDER BY {by} DESC, {numbers} LIMIT {n} OFFSET {offset}"


def statements(having_min: int = 10, offset: int = 10) -> dict[str, str]:
    n, u, views = "count(*) AS c", "count(DISTINCT UserID) AS u", "count(*) AS PageViews"
    width = f"count(*) AS c, {_sum('IsRefresh')} AS sum, avg(ResolutionWidth) AS avg"
    source = "CASE WHEN SearchEngineID = 0 AND AdvEngineID = 0 THEN Referer ELSE '' END"
    body = {
        1: "SELECT count(*) AS count FROM hits",
        2: "SELECT count(*) AS count FROM hits WHERE AdvEngineID <> 0",
        3: f"SELECT coalesce({_sum('AdvEngineID')}, 0) AS sum, count(*) AS count, {_AVG.format('ResolutionWidth')} AS avg FROM hits",
        4: f"SELECT {_AVG.format('UserID')} AS avg FROM hits",
        5: "SELECT count(DISTINCT UserID) AS uniq FROM hits",
        6: "SELECT count(DISTINCT SearchPhrase) AS uniq FROM hits",
        7: "SELECT CAST(min(EventDate) AS VARCHAR) AS min, CAST(max(EventDate) AS VARCHAR) AS max FROM hits",
        8: f"SELECT AdvEngineID, {n} FROM hits WHERE AdvEngineID <> 0 GROUP BY 1 ORDER BY c DESC, 1",
        9: _top("RegionID", u, "u"),
        10: _top("RegionID", f"{_sum('AdvEngineID')} AS sum, {n}, avg(ResolutionWidth) AS avg, count(DISTINCT UserID) AS uniq", "c"),
        11: _top("MobilePhoneModel", u, "u", "MobilePhoneModel <> ''"),
        12: _top("MobilePhone, MobilePhoneModel", u, "u", "MobilePhoneModel <> ''"),
        13: _top("SearchPhrase", n, "c", _SEARCH),
        14: _top("SearchPhrase", u, "u", _SEARCH),
        15: _top("SearchEngineID, SearchPhrase", n, "c", _SEARCH),
        16: _top("UserID", n, "c"),
        17: _top("UserID, SearchPhrase", n, "c"),
        18: f"SELECT UserID, SearchPhrase, {n} FROM hits GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10",
        19: f"SELECT UserID, extract(minute FROM EventTime) AS m, SearchPhrase, {n} FROM hits GROUP BY 1, 2, 3 ORDER BY c DESC, 1, 2, 3 LIMIT 10",
        20: f"SELECT UserID FROM hits WHERE UserID = {USER}",
        21: "SELECT count(*) AS count FROM hits WHERE contains(URL, 'google')",
        22: _top("SearchPhrase", f"min(URL) AS min_url, {n}", "c", f"contains(URL, 'google') AND {_SEARCH}"),
        23: _top("SearchPhrase", f"min(URL) AS min_url, min(Title) AS min_title, {n}, count(DISTINCT UserID) AS uniq", "c", f"contains(Title, 'Google') AND NOT contains(URL, '.google.') AND {_SEARCH}"),
        24: "SELECT * REPLACE (CAST(EventDate AS VARCHAR) AS EventDate) FROM hits WHERE contains(URL, 'google') ORDER BY EventTime, WatchID LIMIT 10",
        25: f"SELECT SearchPhrase FROM hits WHERE {_SEARCH} ORDER BY EventTime, SearchPhrase LIMIT 10",
        26: f"SELECT SearchPhrase FROM hits WHERE {_SEARCH} ORDER BY SearchPhrase LIMIT 10",
        27: f"SELECT SearchPhrase FROM hits WHERE {_SEARCH} ORDER BY EventTime, SearchPhrase LIMIT 10",
        28: f"SELECT CounterID, avg(strlen(URL)) AS l, {n} FROM hits WHERE URL <> '' GROUP BY 1 HAVING count(*) >= {having_min} ORDER BY l DESC, 1 LIMIT 25",
        29: f"SELECT {_HOST} AS k, avg(strlen(Referer)) AS l, {n}, min(Referer) AS min_referer FROM hits WHERE Referer <> '' GROUP BY 1 HAVING count(*) >= {having_min} ORDER BY l DESC, 1 LIMIT 25",
        30: "SELECT " + ", ".join(f"coalesce({_sum(f'ResolutionWidth + {k}')}, 0) AS s{k}" for k in range(90)) + " FROM hits",
        31: _top("SearchEngineID, ClientIP", width, "c", _SEARCH),
        32: _top("WatchID, ClientIP", width, "c", _SEARCH),
        33: _top("WatchID, ClientIP", width, "c"),
        34: _top("URL", n, "c"),
        35: f"SELECT CAST(1 AS BIGINT) AS one, URL, {n} FROM hits GROUP BY URL ORDER BY c DESC, URL LIMIT 10",
        36: f"SELECT ClientIP, ClientIP - 1 AS ClientIPMinus1, ClientIP - 2 AS ClientIPMinus2, ClientIP - 3 AS ClientIPMinus3, {n} FROM hits GROUP BY ClientIP ORDER BY c DESC, ClientIP LIMIT 10",
        37: _top("URL", views, "PageViews", f"{_MONTH} AND DontCountHits = 0 AND URL <> ''"),
        38: _top("Title", views, "PageViews", f"{_MONTH} AND DontCountHits = 0 AND Title <> ''"),
        39: _top("URL", views, "PageViews", f"{_MONTH} AND IsLink <> 0 AND IsDownload = 0", offset=offset),
        40: f"SELECT TraficSourceID, SearchEngineID, AdvEngineID, {source} AS Src, URL AS Dst, {views} FROM hits WHERE {_MONTH} GROUP BY 1, 2, 3, 4, 5 ORDER BY PageViews DESC, 1, 2, 3, 4, 5 LIMIT 10 OFFSET {offset}",
        41: _top("URLHash, CAST(EventDate AS VARCHAR) AS EventDate", views, "PageViews", f"{_MONTH} AND TraficSourceID IN (-1, 6) AND RefererHash = {REFERER_HASH}", offset=offset),
        42: _top("WindowClientWidth, WindowClientHeight", views, "PageViews", f"{_MONTH} AND DontCountHits = 0 AND URLHash = {URL_HASH}", offset=offset),
        43: f"SELECT date_trunc('minute', EventTime) AS M, {views} FROM hits WHERE CounterID = {COUNTER} AND EventDate BETWEEN DATE '2013-07-14' AND DATE '2013-07-15' AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET {offset}",
    }
    return {f"q{k:02d}": f"{hits_sql()} {sql}" for k, sql in body.items()}
