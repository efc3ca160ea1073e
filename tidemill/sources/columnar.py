"""The columnar store: Parquet with row-group statistics."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import declared, field, load_schema
from .csv_files import read_csv, write_csv_file

ROW_GROUP_BYTES = 64 << 20


def write_columnar(df: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, codec: str = "zstd", mode: str = "error") -> None:
    """Version-2 pages, so whole numbers and dates are delta-coded and texts dictionary-coded where that pays."""
    df.write.mode(mode).option("compression", codec).option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes).parquet(path)


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    for f in df.schema.fields:
        declared(f)
    return df


def all_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def inspect(path: str) -> dict:
    """Row count, columns and row groups with the statistics of each column, from the footers of a local store."""
    import pyarrow.parquet as pq

    files = [path] if Path(path).is_file() else sorted(str(p) for p in Path(path).glob("*.parquet"))
    rows, columns, groups = 0, [], []
    for file in files:
        meta = pq.ParquetFile(file).metadata
        rows += meta.num_rows
        columns = columns or [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            chunks = {}
            for i in range(group.num_columns):
                c = group.column(i)
                s = c.statistics
                known = bool(s and s.has_min_max)
                chunks[c.path_in_schema] = {"compressed": c.total_compressed_size, "uncompressed": c.total_uncompressed_size, "encodings": c.encodings, "compression": c.compression, "min": s.min if known else None, "max": s.max if known else None}
            groups.append({"file": file, "rows": group.num_rows, "chunks": chunks})
    return {"rows": rows, "columns": columns, "row_groups": groups}


def convert(spark: SparkSession, csv_path: str, schema_path: str, out: str) -> None:
    """CSV to the columnar store."""
    write_columnar(read_csv(spark, csv_path, load_schema(schema_path)), out)


def export(spark: SparkSession, path: str, csv_path: str) -> None:
    """The columnar store to one CSV file."""
    write_csv_file(read_columnar(spark, path), csv_path)


__all__ = ["ROW_GROUP_BYTES", "all_columns", "convert", "export", "field", "inspect", "read_columnar", "write_columnar"]
