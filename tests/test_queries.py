import datetime
import os
import re

import duckdb
import pytest

from tidemill.plans.clickbench import PLANS, build_query
from tidemill.plans.hits import hits
from tidemill.plans.registry import ORACLE_SQL, QUERIES
from tidemill.sources.columnar import write_columnar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation orders lineitem events documents pages part".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain(cursor.fetchall(), names)


def test_all_registered():
    assert set(QUERIES) == set(ORACLE_SQL) and {f"q{k:02d}" for k in range(1, 44)} <= set(QUERIES) and len(PLANS) == 43


def test_number_out_of_range(spark):
    for k in (0, 44):
        with pytest.raises(ValueError):
            build_query(spark.range(1), k)


def test_search_phrases_in_order(spark):
    words = ["tide", "mill", "oat", "rye", "", "sluice", "weir", "leat"]
    rows = [("https://google.test/" if k % 3 == 0 else "https://other.test/", k * 13 % 50, w) for k, w in enumerate(words)]
    df = spark.createDataFrame([(u, datetime.datetime(2013, 7, 2, 0, 0, s), p) for u, s, p in rows], "URL string, EventTime timestamp_ntz, SearchPhrase string")
    assert [r["EventTime"].second for r in build_query(df, 24).collect()] == sorted(s for u, s, _ in rows if "google" in u)
    in_time = [p for _, s, p in sorted(rows, key=lambda r: r[1]) if p]
    for k in (25, 27):
        assert [r[0] for r in build_query(df, k).collect()] == in_time
    assert [r[0] for r in build_query(df, 26).collect()] == sorted(in_time)


def test_ninety_sums(spark):
    widths = [7 * k for k in range(50)]
    df = spark.createDataFrame([(w,) for w in widths], "ResolutionWidth smallint")
    row = build_query(df, 30).first()
    assert [row[f"s{k}"] for k in range(90)] == [sum(widths) + 50 * k for k in range(90)]
    assert build_query(df, 30)._jdf.queryExecution().optimizedPlan().toString().count("sum(") <= 2


def test_keys_that_follow_from_others(spark):
    urls = spark.createDataFrame([(f"u{k}",) for k in range(6) for _ in range(2 + 3 * k)], "URL string")
    assert [tuple(r) for r in build_query(urls, 35).collect()] == [(1, f"u{k}", 2 + 3 * k) for k in range(5, -1, -1)]
    ips = spark.createDataFrame([(1000 - k,) for k in range(4) for _ in range(9 - 2 * k)], "ClientIP int")
    assert [tuple(r) for r in build_query(ips, 36).collect()] == [(i, i - 1, i - 2, i - 3, n) for i, n in ((1000, 9), (999, 7), (998, 5), (997, 3))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
def test_filters_reach_the_scan_of_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "hits")
    write_columnar(hits(spark, SF), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    for k, columns in {2: ["AdvEngineID"], 20: ["UserID"], **{k: ["CounterID", "EventDate"] for k in range(37, 44)}}.items():
        plan = build_query(spark.read.parquet(path), k)._jdf.queryExecution().executedPlan().toString()
        pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)
        assert pushed and all(any(c in x for x in pushed) for c in columns), (k, plan)
