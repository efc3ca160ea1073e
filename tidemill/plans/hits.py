"""A ``hits`` table derived from the test data's ``events``: the columns that the 43 queries touch.

The expressions are read alike by Spark and DuckDB but for the time stamp's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: event_id is e, user_id is u; the time stamp moves to July 2013.
TIME_SPARK = "CAST(date_trunc('second', ts) AS timestamp_ntz) - INTERVAL '3836' DAY"
TIME_DUCKDB = "date_trunc('second', ts) - INTERVAL '3836' DAY"
COLUMNS = {
    "WatchID": "e*1000003",
    "Title": "CASE CAST(e%5 AS int) WHEN 0 THEN concat('Google result ', CAST(e%31 AS string)) WHEN 1 THEN '' ELSE concat('Page ', CAST(e%211 AS string)) END",
    "EventTime": "{time}",
    "EventDate": "CAST({time} AS date)",
    "CounterID": "CAST(CASE WHEN e%3=0 THEN 62 ELSE e%50 END AS int)",
    "ClientIP": "CAST(e%409 AS int)",
    "RegionID": "CAST(u%23 AS int)",
    "UserID": "CASE WHEN u=7 THEN 435090932899640449 ELSE u END",
    "URL": "CASE CAST(e%4 AS int) WHEN 0 THEN concat('http://www.google.com/search?q=', CAST(e%700 AS string)) WHEN 1 THEN concat('https://site', CAST(e%97 AS string), '.example.com/p/', CAST(e%1300 AS string)) WHEN 2 THEN '' ELSE concat('http://google', CAST(e%13 AS string), '/é', CAST(e%50 AS string)) END",
    "Referer": "CASE CAST(e%7 AS int) WHEN 0 THEN '' WHEN 1 THEN 'http:///x' WHEN 2 THEN 'http://www./x' WHEN 3 THEN 'https://nohost' ELSE concat('https://www.ref', CAST(e%11 AS string), '.example.org/é/', CAST(e%17 AS string)) END",
    "IsRefresh": "CAST(CASE WHEN e%10=9 THEN 1 ELSE 0 END AS smallint)",
    "ResolutionWidth": "CAST(320+e%1600 AS smallint)",
    "MobilePhone": "CAST(u%6 AS smallint)",
    "MobilePhoneModel": "CASE WHEN event_type IN ('click','view') THEN concat('Model ', CAST(u%9 AS string)) ELSE '' END",
    "TraficSourceID": "CAST(e%8-1 AS smallint)",
    "SearchEngineID": "CAST(e%3 AS smallint)",
    "SearchPhrase": "CASE WHEN e%2=0 THEN '' ELSE concat('phrase ', CAST(e%301 AS string)) END",
    "AdvEngineID": "CAST(CASE WHEN e%6=0 THEN e%5 ELSE 0 END AS smallint)",
    "WindowClientWidth": "CAST(800+e%37 AS smallint)",
    "WindowClientHeight": "CAST(600+e%29 AS smallint)",
    "IsLink": "CAST(e%2 AS smallint)",
    "IsDownload": "CAST(CASE WHEN e%11=0 THEN 1 ELSE 0 END AS smallint)",
    "DontCountHits": "CAST(CASE WHEN e%13=0 THEN 1 ELSE 0 END AS smallint)",
    "RefererHash": "CASE WHEN e%2=1 THEN 3594120000172545465 ELSE e END",
    "URLHash": "CASE WHEN e%4=1 THEN 2868770270353813622 ELSE e%200 END",
}


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS e", "user_id AS u", "event_type", "ts")
    return events.selectExpr(*[f"{x.format(time=TIME_SPARK)} AS {name}" for name, x in COLUMNS.items()])


def hits_sql() -> str:
    columns = ", ".join(f"{x.format(time=TIME_DUCKDB)} AS {name}" for name, x in COLUMNS.items())
    return f"WITH hits AS (SELECT {columns} FROM (SELECT event_id AS e, user_id AS u, event_type, ts FROM events))"
