import datetime
import random

import pytest

from tidemill.cli import main, query_number
from tidemill.schema import load_schema, make_schema
from tidemill.sources.columnar import convert, export, inspect, read_columnar, write_columnar
from tidemill.sources.csv_files import lines, read_csv, records, write_csv_file

ALL = [("a", "BIGINT"), ("b", "INTENGER"), ("c", "SMALLINT"), ("d", "TEXT"), ("e", "VARCHAR(255)"), ("f", "CHAR"), ("g", "TIMESTAMP"), ("h", "DATE"), ("i", "Float64")]


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_schema_file(tmp_path):
    schema = load_schema(write(tmp_path / "s.csv", "str,string\nintegers,int64\n"))
    assert [(f.name, f.dataType.simpleString()) for f in schema.fields] == [("str", "string"), ("integers", "bigint")]
    for bad in ("a,int64\na,int64\n", "a,FLOAT\n", "a\n"):
        with pytest.raises(ValueError):
            load_schema(write(tmp_path / "bad.csv", bad))


def test_typed_csv(spark, tmp_path):
    schema = make_schema([("t", "string"), ("n", "int64"), ("s", "SMALLINT"), ("x", "DOUBLE"), ("d", "DATE"), ("ts", "TIMESTAMP")])
    path = write(tmp_path / "t.csv", '"one, two; three",9007199254740993,-32768,-6.02e23,"2024-02-29","1969-12-31 23:59:58"\r\n"say ""when""",-1,0,.5,"1582-10-15","2013-07-14 12:00:00.75+03"\r\n')
    rows = [tuple(r) for r in read_csv(spark, path, schema).collect()]
    assert rows == [("one, two; three", 9007199254740993, -32768, -6.02e23, datetime.date(2024, 2, 29), datetime.datetime(1969, 12, 31, 23, 59, 58)), ('say "when"', -1, 0, 0.5, datetime.date(1582, 10, 15), datetime.datetime(2013, 7, 14, 12))]


def test_quoted_line_ends_and_empty_texts(spark, tmp_path):
    schema = make_schema([("id", "int64"), ("text", "string")])
    long = "no end in sight, " * 80_000 + "\r\n\nbut here"
    path = write(tmp_path / "t.csv", f'17,"{long}"\n18,\n19,""\n')
    assert [tuple(r) for r in read_csv(spark, path, schema).collect()] == [(17, long), (18, ""), (19, "")]


def test_quotes_within_fields_and_blank_lines(spark, tmp_path):
    two = make_schema([("x", "string"), ("y", "string")])
    path = write(tmp_path / "q.csv", 'pre"in, and"post,z\n"""",x""""y\n"a"b"c",\n')
    assert [tuple(r) for r in read_csv(spark, path, two).collect()] == [("prein, andpost", "z"), ('"', 'x"y'), ("abc", "")]
    one = make_schema([("x", "string")])
    assert [r["x"] for r in read_csv(spark, write(tmp_path / "b.csv", "first\n\n\nlast"), one).collect()] == ["first", "", "", "last"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, "".join(r.choice(['"', "\n", ",", "é", "word ", "\r\n", "x"]) for _ in range(r.randrange(60)))) for k in range(2000)] + [(2000, "line\n" * 9000)]
    path = write(tmp_path / "m.csv", "".join('{},"{}"\n'.format(k, t.replace('"', '""')) for k, t in rows))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("2k", "33k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert records(spark, path).rdd.getNumPartitions() >= 3
            assert [tuple(x) for x in read_csv(spark, path, make_schema([("n", "int64"), ("t", "string")])).collect()] == rows
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_wide_table(spark, tmp_path):
    """As many columns as the benchmark's table has, of all types in turn."""
    kinds = {"BIGINT": "{}", "TEXT": '"t {}"', "SMALLINT": "{}", "DATE": '"2013-07-{:02d}"', "INTEGER": "-{}", "CHAR": '"c"', "TIMESTAMP": '"2013-07-{:02d} 10:11:12"', "VARCHAR(255)": '"""{}"""', "DOUBLE": "{}.5"}
    columns = [(f"c{k}", list(kinds)[k % len(kinds)]) for k in range(105)]
    text = "".join(",".join(kinds[kind].format(1 + (row + k) % 28) for k, (_, kind) in enumerate(columns)) + "\n" for row in range(40))
    source, schema = write(tmp_path / "in.csv", text), write(tmp_path / "s.csv", "\n".join(",".join(x) for x in columns) + "\n")
    convert(spark, source, schema, str(tmp_path / "store"))
    assert inspect(str(tmp_path / "store"))["rows"] == 40 and read_columnar(spark, str(tmp_path / "store")).columns == [c for c, _ in columns]
    export(spark, str(tmp_path / "store"), str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_text() == text


@pytest.mark.parametrize("bad", ["x,1\n", ",1\n", "4,4,4\n", "92233720368547758080,1\n", '6,"\n', "7\n", "+8,a\n", " 9,a\n", "\n"])
def test_bad_rows_are_errors(spark, tmp_path, bad):
    schema = make_schema([("n", "int64"), ("t", "string")])
    with pytest.raises(Exception):
        read_csv(spark, write(tmp_path / "t.csv", bad), schema).collect()


def test_written_lines(spark, tmp_path):
    df = spark.createDataFrame([(11, "so, so", 1e22), (-12, 'an "inch"', 1 / 3), (13, "", 0.7 + 0.1), (14, "x\ny", 123456789.0)], "id long, name string, x double").coalesce(1)
    want = ['11,"so, so",1e+22', '-12,"an ""inch""",0.333333333333333', '13,"",0.8', '14,"x\ny",123456789']
    assert [r["value"] for r in lines(df).collect()] == want
    write_csv_file(df, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_text() == "\n".join(want) + "\n"


def test_round_trip_of_all_types(spark, tmp_path):
    text = '1,2,3,"é ""q""","v","c","2013-07-01 01:02:03","2013-07-01",1.5\n-1,-2,-3,"","","x","1999-12-31 23:59:59","1999-12-31",-2.25\n'
    source, schema = write(tmp_path / "in.csv", text), write(tmp_path / "s.csv", "\n".join(",".join(x) for x in ALL) + "\n")
    store, out = str(tmp_path / "store"), str(tmp_path / "out.csv")
    convert(spark, source, schema, store)
    export(spark, store, out)
    assert (tmp_path / "out.csv").read_text(encoding="utf-8") == text
    meta = inspect(store)
    assert meta["rows"] == 2 and meta["columns"] == [x[0] for x in ALL]
    assert (meta["row_groups"][0]["chunks"]["a"]["min"], meta["row_groups"][0]["chunks"]["a"]["max"]) == (-1, 1)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], make_schema([("a", "int64"), ("t", "TEXT")]))
    write_columnar(df, str(tmp_path / "e"))
    assert read_columnar(spark, str(tmp_path / "e")).count() == 0


def test_command_line(spark, tmp_path, capsys):
    assert main([]) == 1 and "convert" in capsys.readouterr().err
    assert main(["query", "nowhere", "1x", "out"]) == 1
    with pytest.raises(ValueError, match="Invalid query id"):
        query_number("1x")
    store = str(tmp_path / "h")
    spark.createDataFrame([(10,), (11,), (10,)], "ClientIP int").write.parquet(store)
    assert main(["query", store, "36", str(tmp_path / "o.csv")]) == 0
    assert (tmp_path / "o.csv").read_text() == "10,9,8,7,2\n11,10,9,8,1\n"
    assert main(["query", store, "44", str(tmp_path / "p.csv")]) == 1
