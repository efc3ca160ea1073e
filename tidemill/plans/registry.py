"""The registered queries: the 43 over ``hits`` and one entry per operator over the test data's own tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import byte_length, contains, domain, minute_floor, minute_of, not_contains, widened_plus
from ..operators.aggregates import avg, count, count_distinct, global_agg, group_agg, max_, min_, sum_
from ..operators.rows import compute, keep, limit, ordered_limit, project, scan, settled, sort, top_k
from ..schema import make_schema
from ..sources.columnar import read_columnar, write_columnar
from ..sources.csv_files import read_csv, write_csv
from . import oracle
from .clickbench import PLANS, build_query
from .hits import hits

#: So that results over small data are not empty.
HAVING_MIN, OFFSET = 10, 10


def _query(k: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _dates_as_text(build_query(hits(spark, sf_dir), k, HAVING_MIN, OFFSET if k >= 39 else None, settle=True))


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Engines hand out dates in different ways; for comparison they are written out."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str, where=None) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", columns or None, where)


def _all_aggs(column: str, distinct: str) -> list:
    return [count("n"), sum_(column, "sum_x"), avg(column, "avg_x"), min_(column, "min_x"), max_(column, "max_x"), count_distinct(distinct, "n_distinct")]


def _new_path(spark: SparkSession, label: str) -> str:
    """In the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/tidemill-{label}-{uuid.uuid4().hex[:12]}"


def _through_csv(rows: DataFrame, schema) -> DataFrame:
    """Written as CSV and read again."""
    path = _new_path(rows.sparkSession, "csv")
    write_csv(rows, path)
    return read_csv(rows.sparkSession, path, schema)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", "n_regionkey")
    return _through_csv(rows, make_schema([("n_nationkey", "INTEGER"), ("n_name", "TEXT"), ("n_regionkey", "INTEGER")]))


_TYPED = {"key": ("BIGINT", "o_orderkey"), "small": ("SMALLINT", "CAST(o_orderkey % 100 - 50 AS smallint)"), "status": ("CHAR", "o_orderstatus"), "priority": ("VARCHAR(255)", "concat(o_orderpriority, '\"', chr(10), ',')"), "price": ("DOUBLE", "CAST(o_totalprice AS double)"), "day": ("DATE", "CAST(o_orderdate AS date)"), "moment": ("TIMESTAMP", "CAST(o_orderdate AS {timestamp})")}


def _typed(spark: SparkSession, sf_dir: str, through) -> DataFrame:
    """Columns of all types, with quotes and line ends, on a way out and back; dates and times as text."""
    rows = _table(spark, sf_dir, "orders").selectExpr(*[f"{x.format(timestamp='timestamp_ntz')} AS {c}" for c, (_, x) in _TYPED.items()])
    back = through(rows, make_schema([(c, kind) for c, (kind, _) in _TYPED.items()]))
    return back.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "moment": F.date_format("moment", "yyyy-MM-dd HH:mm:ss")})


def _through_store(rows: DataFrame, schema) -> DataFrame:
    """To CSV, to the columnar store, and read from there."""
    path = _new_path(rows.sparkSession, "store")
    write_columnar(_through_csv(rows, schema), path)
    return read_columnar(rows.sparkSession, path)


_TYPED_SQL = "SELECT " + ", ".join(f"strftime({x.format(timestamp='timestamp')}, '{'%Y-%m-%d' if c == 'day' else '%Y-%m-%d %H:%M:%S'}') AS {c}" if c in ("day", "moment") else f"{x} AS {c}" for c, (_, x) in _TYPED.items()) + " FROM orders"


def _block_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compute(_table(spark, sf_dir, "events", "event_id"), {"block": F.floor(F.col("event_id") / 1000).cast("bigint")})
    return group_agg(rows, ["block"], count("n"), min_("event_id", "lo"), max_("event_id", "hi"))


_LINE = ("l_orderkey", "l_linenumber", "l_quantity")
_ORDER = ("o_orderkey", "o_orderpriority", "o_totalprice")

#: Entry to (plan, DuckDB SQL).
OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "op_scan_project": (lambda s, d: project(_table(s, d, "lineitem"), ["l_quantity", "l_linenumber", "l_orderkey"]), "SELECT l_quantity, l_linenumber, l_orderkey FROM lineitem"),
    "op_scan_no_columns": (lambda s, d: global_agg(_table(s, d, "lineitem"), count()), "SELECT count(*) AS count FROM lineitem"),
    "op_filter_cmp": (
        lambda s, d: keep(_table(s, d, "lineitem", *_LINE), (F.col("l_quantity") >= 10) & (F.col("l_quantity") <= 20) & (F.col("l_linenumber") != 3) & (F.col("l_quantity") != 15)),
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_linenumber <> 3 AND l_quantity <> 15",
    ),
    "op_filter_contains": (lambda s, d: keep(_table(s, d, "pages", "page_id", "url"), contains("url", "1")), "SELECT page_id, url FROM pages WHERE contains(url, '1')"),
    "op_filter_not_contains": (lambda s, d: keep(_table(s, d, "pages", "page_id", "url"), not_contains("url", "1")), "SELECT page_id, url FROM pages WHERE NOT contains(url, '1')"),
    "op_filter_in": (lambda s, d: keep(_table(s, d, "lineitem", *_LINE), F.col("l_linenumber").isin(2, 5)), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber IN (2, 5)"),
    "op_compute_arith": (
        lambda s, d: compute(_table(s, d, "lineitem", "l_orderkey", "l_linenumber"), {"minus_two": F.col("l_linenumber") - F.lit(2), "plus_seven": widened_plus("l_linenumber", 7)}),
        "SELECT l_orderkey, l_linenumber, l_linenumber - 2 AS minus_two, CAST(l_linenumber AS BIGINT) + 7 AS plus_seven FROM lineitem",
    ),
    "op_compute_const": (lambda s, d: compute(_table(s, d, "orders", "o_orderkey"), {"one": F.lit(1).cast("bigint")}), "SELECT o_orderkey, CAST(1 AS BIGINT) AS one FROM orders"),
    "op_compute_case": (
        lambda s, d: compute(_table(s, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), {"src": F.when((F.col("o_orderstatus") == "O"), F.col("o_orderpriority")).otherwise("")}),
        "SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '' END AS src FROM orders",
    ),
    "op_str_octet_length": (lambda s, d: _table(s, d, "documents", "doc_id", "text").select("doc_id", byte_length("text").alias("n_bytes")), "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents"),
    "op_domain": (
        lambda s, d: _table(s, d, "pages", "page_id", "url").select("page_id", domain("url").alias("host")),
        "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://(?:www\\.)?([^/]*)/') THEN regexp_extract(url, '^https?://(?:www\\.)?([^/]*)/', 1) ELSE url END AS host FROM pages",
    ),
    "op_minute": (lambda s, d: _table(s, d, "events", "event_id", "ts").select("event_id", minute_of("ts").alias("m")), "SELECT event_id, extract(minute FROM ts) AS m FROM events"),
    "op_trunc_minute": (lambda s, d: _table(s, d, "events", "event_id", "ts").select("event_id", minute_floor("ts").alias("M")), "SELECT event_id, date_trunc('minute', ts) AS M FROM events"),
    "op_global_agg_all": (
        lambda s, d: global_agg(_table(s, d, "lineitem", "l_linenumber", "l_suppkey"), *_all_aggs("l_linenumber", "l_suppkey")),
        "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS sum_x, avg(l_linenumber) AS avg_x, min(l_linenumber) AS min_x, max(l_linenumber) AS max_x, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem",
    ),
    "op_global_agg_empty": (
        lambda s, d: global_agg(keep(_table(s, d, "lineitem", "l_linenumber"), F.col("l_linenumber") <= -1), count("n"), sum_("l_linenumber", "sum_x"), avg("l_linenumber", "avg_x"), min_("l_linenumber", "min_x"), count_distinct("l_linenumber", "n_distinct")),
        "SELECT count(*) AS n, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS sum_x, coalesce(avg(l_linenumber), 0.0) AS avg_x, min(l_linenumber) AS min_x, count(DISTINCT l_linenumber) AS n_distinct FROM lineitem WHERE l_linenumber <= -1",
    ),
    "op_group_agg_all": (
        lambda s, d: group_agg(_table(s, d, "lineitem", "l_returnflag", "l_linenumber", "l_suppkey"), ["l_returnflag"], *_all_aggs("l_linenumber", "l_suppkey")),
        "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS sum_x, avg(l_linenumber) AS avg_x, min(l_linenumber) AS min_x, max(l_linenumber) AS max_x, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem GROUP BY 1",
    ),
    "op_group_multi_key": (lambda s, d: group_agg(_table(s, d, "lineitem", "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"], count("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "op_group_distinct_keys": (lambda s, d: group_agg(_table(s, d, "orders"), ["o_orderpriority"]), "SELECT DISTINCT o_orderpriority FROM orders"),
    "op_having": (lambda s, d: keep(group_agg(_table(s, d, "orders", "o_custkey"), ["o_custkey"], count("n")), F.col("n") >= 12), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12"),
    "op_sort_multi": (lambda s, d: sort(_table(s, d, "part", "p_partkey", "p_brand", "p_size"), F.desc("p_brand"), F.asc("p_size"), F.asc("p_partkey")), "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey"),
    "op_topk": (lambda s, d: top_k(_table(s, d, "orders", *_ORDER), 25, F.desc("o_totalprice"), "o_orderkey"), "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "op_topk_gt_input": (lambda s, d: top_k(_table(s, d, "region"), 1000, "r_name"), "SELECT * FROM region ORDER BY r_name LIMIT 1000"),
    "op_limit_zero": (lambda s, d: limit(_table(s, d, "region"), 0), "SELECT * FROM region LIMIT 0"),
    "op_offset_limit": (lambda s, d: ordered_limit(df := _table(s, d, "orders", *_ORDER), 20, *settled(df, "o_orderpriority"), offset=40), "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_orderkey, o_totalprice LIMIT 20 OFFSET 40"),
    "op_offset_past_end": (lambda s, d: ordered_limit(_table(s, d, "region"), 5, "r_name", offset=100), "SELECT * FROM region ORDER BY r_name LIMIT 5 OFFSET 100"),
    "op_block_min_max": (_block_min_max, "SELECT CAST(floor(event_id / 1000) AS BIGINT) AS block, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1"),
    "op_prune_eq": (lambda s, d: _table(s, d, "events", "event_id", "user_id", where=F.col("event_id") == 77), "SELECT event_id, user_id FROM events WHERE event_id = 77"),
    "op_prune_between": (lambda s, d: _table(s, d, "events", "event_id", "user_id", where=F.col("event_id").between(100, 199)), "SELECT event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 199"),
    "op_prune_ne": (lambda s, d: _table(s, d, "events", "event_id", "user_id", where=F.col("user_id") != 7), "SELECT event_id, user_id FROM events WHERE user_id <> 7"),
    "op_csv_round_trip": (_csv_round_trip, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "op_csv_typed": (lambda s, d: _typed(s, d, _through_csv), _TYPED_SQL),
    "op_store_typed": (lambda s, d: _typed(s, d, _through_store), _TYPED_SQL),
    "op_keep_function": (
        lambda s, d: keep(_table(s, d, "part", "p_partkey", "p_size"), lambda row: row["p_size"] % 7 == 3),
        "SELECT p_partkey, p_size FROM part WHERE p_size % 7 = 3",
    ),
    "op_compute_function": (
        lambda s, d: compute(_table(s, d, "part", "p_partkey", "p_size"), {"both": (lambda row: row["p_partkey"] * 100 + row["p_size"], "long")}),
        "SELECT p_partkey, p_size, CAST(p_partkey AS BIGINT) * 100 + p_size AS both FROM part",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"q{k:02d}": _query(k) for k in PLANS} | {k: v[0] for k, v in OPERATORS.items()}
ORACLE_SQL: dict[str, str] = oracle.statements(HAVING_MIN, OFFSET) | {k: v[1] for k, v in OPERATORS.items()}
