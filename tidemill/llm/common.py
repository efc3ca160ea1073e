"""What the operators of this subpackage share: tables, the shared folder, word rules."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the word rule, as a regex class body (Java, RE2 and Python read it alike).
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


#: Bytes of an Arrow batch that goes to a Python worker, unless the session says otherwise: batches are held several times at once, in the
#: executor and in its workers, and by default have 64 MB.
BATCH_BYTES = 4 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once in a session's life, so that workers need no installed copy, and bounds the session's Arrow batches."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(sc, "_tidemill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    to = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="tidemill-"), f"{package.name}.zip"))
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(to)
    sc._tidemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.
    Only where that is unset (single-machine tests) a temporary folder takes its place."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = sc._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else "file://" + tempfile.mkdtemp(prefix="tidemill-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemill-{label}-{uuid.uuid4().hex[:12]}"


#: Of tables that are written only to be read again: a task holds a block, and its executor one for each core.
BLOCK_BYTES = 16 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: it cuts lineage, is computed once,
    survives lost executors, and gives rows the same order and partition each time they are read."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder, for workers that read or write binary files there."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes) -> None:
    """Writes a file under a name of its own, then renames it, so that a retried or speculative task
    never leaves a half-written file behind."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def text_of(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; null counts as none.  Each word with the space around it becomes one letter, of a text that ends with a word more: unlike
    ``regexp_count``, which makes an array of all matches of a text, this leaves little for the JVM to clear away."""
    letters = F.regexp_replace(F.concat(text_of(text), F.lit(" w")), F.lit(rf"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+"), F.lit("w"))
    return (F.length(letters) - 1).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows that a join by row key broadcasts, at most (24 bytes each); more go through a shuffle.
BROADCAST_ROWS = 1 << 20
_PLAIN = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def addressed(docs: DataFrame, *columns: Column) -> tuple[DataFrame, DataFrame]:
    """(docs, slim): the rows of ``docs``, and ``columns`` of them next to the row's address, ``file`` (a hash of its path) and ``at`` (its place in it).
    Rows of files have an address as they are; other rows, which may come in another order when they are worked out again, are stored first."""

    def plain(node) -> bool:
        below = node.children()
        return node.getClass().getSimpleName() in _PLAIN and all(plain(below.apply(i)) for i in range(below.size()))

    def read(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select(*columns, F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))

    if plain(docs._jdf.queryExecution().analyzed()):
        try:
            return docs, read(docs)
        except AnalysisException:  # files of another format, which don't number their rows
            pass
    docs = stored(docs, "rows")
    return docs, read(docs)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (as ``addressed`` returned them) whose address is not in the stored table ``gone`` (file, at).  The rows that
    stay aren't moved while those that go are few."""
    return docs if gone.isEmpty() else located(docs, gone, "left_anti")


def located(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` (as ``addressed`` returned them) joined with the stored table ``rows`` (file, at and more) by address."""
    few = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    place = docs.metadataColumn("_metadata")
    return docs.join(few, (F.xxhash64(place["file_path"]) == few["file"]) & (place["row_index"] == few["at"]), how)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, which gives back its memory when a task is done: Python workers live on from task to task and from one operator to the next."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect(0)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


class Remembered(dict):
    """Word to what ``make`` makes of it, remembered; emptied when it takes more than ``limit`` bytes, however long the words are."""

    def __init__(self, make, limit: int = 20 << 20):
        super().__init__()
        self.make, self.limit, self.bytes = make, limit, 0

    def __missing__(self, word):
        made = self.make(word)
        cost = 2 * len(word) + 200  # with the value and the table's slots
        if cost > self.limit >> 8:
            return made
        if self.bytes > self.limit:
            self.clear()
            self.bytes = 0
        self.bytes += cost
        self[word] = made
        return made
