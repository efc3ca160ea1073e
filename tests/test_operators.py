import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions.expressions import all_of, byte_length, contains, domain, minute_floor, minute_of, not_contains
from tidemill.operators.aggregates import avg, count, count_distinct, global_agg, group_agg, max_, min_, sum_
from tidemill.operators.rows import compute, keep, limit, ordered_limit, project, scan, sort, top_k
from tidemill.sources.columnar import inspect, write_columnar


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i,) for i in range(1, 9)], "value long").coalesce(1)


@pytest.fixture(scope="module")
def groups(spark):
    """Forty rows by rule: three groups of unequal size, two parts each, values with gaps and repeats."""
    rows = [("north" if k % 5 < 3 else "south" if k % 5 == 3 else "west", k % 2, k * k % 23, f"n{k % 7}") for k in range(40)]
    return spark.createDataFrame(rows, "grp string, sub int, value long, name string")


def test_limit_and_offset(numbers):
    assert values(limit(numbers.orderBy("value"), 3, 2)) == [(3,), (4,), (5,)]
    assert values(limit(numbers, 3, 100)) == []
    assert values(limit(numbers, 0)) == []


def test_filter_project_compute(spark):
    df = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "name string, value long")
    assert [r["name"] for r in keep(df, F.col("value") >= 20).collect()] == ["b", "c"]
    assert [r["name"] for r in keep(df, lambda row: row["value"] >= 20).collect()] == ["b", "c"]
    none = keep(df, F.lit(False))
    assert none.columns == ["name", "value"] and none.count() == 0
    assert values(project(df, ["value"])) == [(10,), (20,), (30,)]
    assert [r["twice"] for r in compute(df, {"twice": F.col("value") * 2}).collect()] == [20, 40, 60]
    assert [r["twice"] for r in compute(df, {"twice": (lambda row: row["value"] * 2, "long")}).collect()] == [20, 40, 60]
    with pytest.raises(ValueError):
        compute(df, {"name": F.lit(1)})
    with pytest.raises(KeyError):
        project(df, ["gone"])
    with pytest.raises(ValueError):
        project(df, ["name", "name"])
    assert keep(df, all_of()).count() == 3


def test_aggregates(groups):
    rows = values(groups)
    row = global_agg(groups, count("cnt"), sum_("value"), avg("value"), min_("name", "min_name"), max_("value"), count_distinct("name", "distinct")).first()
    total = sum(r[2] for r in rows)
    assert tuple(row) == (40, total, total / 40, "n0", max(r[2] for r in rows), 7)
    want = {}
    for grp, sub, value, _ in rows:
        n, s = want.get((grp, sub), (0, 0))
        want[grp, sub] = (n + 1, s + value)
    assert sorted(values(group_agg(groups, ["grp", "sub"], count("n"), sum_("value")))) == sorted((*k, *v) for k, v in want.items())
    assert sorted(values(group_agg(groups, ["grp"]))) == [("north",), ("south",), ("west",)]
    none = global_agg(groups.filter(F.lit(False)), count("n"), sum_("value"), avg("value"), min_("value"), count_distinct("name")).first()
    assert tuple(none) == (0, 0, 0.0, None, 0)
    for bad in (sum_, avg):
        with pytest.raises(TypeError):
            global_agg(groups, bad("name"))


def test_average_of_large_numbers_is_exact(spark):
    df = spark.createDataFrame([(435090932899640449,), (1,), (3,)], "x long")
    assert global_agg(df, avg("x")).first()[0] == float(435090932899640453) / 3


def test_sort_and_top(spark):
    rows = [(k * 7 % 4, f"w{k * 11 % 17:02d}") for k in range(17)]
    df = spark.createDataFrame(rows, "score int, name string")
    order = [F.desc("score"), F.asc("name")]
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert values(sort(df, *order)) == want
    assert values(top_k(df, 3, *order)) == want[:3]
    assert values(top_k(df, 50, *order)) == want
    assert values(top_k(df, 0, *order)) == []
    assert values(ordered_limit(df, 2, *order, offset=1)) == want[1:3]
    plan = top_k(df, 3, *order)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_prunes_columns_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    write_columnar(spark.range(200_000).selectExpr("id", "id % 7 AS k", "repeat('x', 50) AS pad").coalesce(1), path, row_group_bytes=100_000, codec="none")
    meta = inspect(path)
    assert meta["rows"] == 200_000 and len(meta["row_groups"]) > 1
    assert meta["row_groups"][0]["chunks"]["id"]["min"] == 0
    df = scan(spark, path, ["id"], F.col("id") == 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert values(df) == [(5,)]
    assert "ReadSchema: struct<>" in scan(spark, path, []).groupBy().count()._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the scan of an executed plan has passed on."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_scan_skips_row_groups_by_their_statistics(spark, tmp_path):
    path = str(tmp_path / "t")
    write_columnar(spark.range(300_000).selectExpr("id", "id DIV 1000 AS block", "repeat(cast(id AS string), 8) AS pad").coalesce(1), path, row_group_bytes=200_000, codec="none")
    groups = inspect(path)["row_groups"]
    assert len(groups) > 5
    for predicate, fits in (
        (F.col("id") == 1234, lambda c: c["id"]["min"] <= 1234 <= c["id"]["max"]),
        (F.col("block").between(40, 41), lambda c: c["block"]["min"] <= 41 and c["block"]["max"] >= 40),
        (F.col("id") >= 290_000, lambda c: c["id"]["max"] >= 290_000),
        (F.col("id") < 0, lambda c: False),
    ):
        df = scan(spark, path, ["id"], predicate)
        assert scanned(df) <= sum(g["rows"] for g in groups if fits(g["chunks"])) < 300_000 / 2


def test_encodings_by_type(spark, tmp_path):
    path = str(tmp_path / "t")
    write_columnar(spark.range(50_000).selectExpr("id", "cast(id AS int) AS n", "cast('2013-07-01' AS date) + cast(id AS int) AS d", "concat('kind ', id % 9) AS few", "uuid() AS many", "rand() AS x").coalesce(1), path)
    chunks = inspect(path)["row_groups"][0]["chunks"]
    have = {c: set(chunks[c]["encodings"]) for c in chunks}
    assert "DELTA_BINARY_PACKED" in have["id"] | have["n"] and "DELTA_BINARY_PACKED" in have["d"]
    assert have["few"] & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} and have["many"] & {"DELTA_BYTE_ARRAY", "DELTA_LENGTH_BYTE_ARRAY"}
    assert have["x"] & {"PLAIN", "BYTE_STREAM_SPLIT"} and all(c["compression"] == "ZSTD" for c in chunks.values())
    assert all(c["compressed"] > 0 and c["uncompressed"] > 0 and c["min"] is not None for c in chunks.values())


def test_expressions(spark):
    df = spark.createDataFrame([("http://www.google.com/a",), ("http:///x",), ("http://www./x",), ("https://nohost",), ("ftp://h/x",), ("https://a.b/\nc",), ("é",)], "u string")
    assert [r[0] for r in df.select(domain("u")).collect()] == ["google.com", "", "", "https://nohost", "ftp://h/x", "a.b", "é"]
    assert df.select(byte_length("u")).collect()[-1][0] == 2
    assert df.filter(contains("u", "google")).count() == 1 and df.filter(not_contains("u", "google")).count() == 6
    t = spark.createDataFrame([(datetime.datetime(2013, 7, 1, 3, 59, 59),)], "t timestamp_ntz")
    assert tuple(t.select(minute_of("t"), minute_floor("t")).first()) == (59, datetime.datetime(2013, 7, 1, 3, 59))
