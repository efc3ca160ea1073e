"""WARC archives: writer with revisit records, normaliser of monolithic gzip, reader by offset index.

``write`` puts pages into WARC files that are compressed as one gzip stream each, as many crawlers leave them: nothing
inside can be reached without inflating all before it.  ``normalise`` inflates such a stream once, as it is read, rewrites
every record as a gzip member of its own, and writes a sidecar index (one JSON line per record: offset, length, type, id,
target, digest).  ``read`` then opens single members by offset, in any order and in parallel.

All three stream: a task holds one record and a buffer, whatever the archive's size.  Files go to the shared folder under
names that are unique to the attempt and are renamed when whole; what counts is the manifest that the tasks return, so a
task that is run again, or twice at once, does no harm.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the smallest id is the response, the others are
revisit records without a payload, which name it.  Digests are compared by grouping with a combiner on the map side.  What comes back to the
pages are the addresses of those that revisit others; payloads stay where they are while these are few (``common.BROADCAST_ROWS``).

Defined results: a null payload is empty; a null or odd URL is written percent-encoded; a null id stays null, and such a row is never
the one that others refer to; rows that repeat the response's own id are responses too; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import addressed, filesystem, lean, located, new_path, stored

MIN_REVISIT = 100
#: Bytes of records after which a writer starts another archive.
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 20
URN, DATE = "urn:tidemill:page:", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
INDEX = "archive string, offset long, length long, type string, record_id string, target string, digest string"


def record(page_id, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to=None) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def inflate(source) -> Iterator[bytes]:
    """The content of a gzip file as it is read; members that follow one another are one stream."""
    z = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            out = z.decompress(data, CHUNK)
            if out:
                yield out
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    if rest := z.flush():
        yield rest


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of records."""
    buffer = bytearray()

    def more() -> bool:
        part = next(chunks, None)
        if part is None:
            return False
        buffer.extend(part)
        return True

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        head = headers(bytes(buffer[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(buffer[:size])
        del buffer[:size]


def payload_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; their stored manifest."""
    payload = payload_of(F.col(payload_col))
    pages, slim = addressed(pages, F.col(id_col).alias("id"), F.octet_length(payload).alias("size"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    slim = stored(slim.filter(F.col("size") >= MIN_REVISIT).select("id", "digest", "file", "at"), "digests")
    same = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    same = stored(same.select("digest", "first"), "payloads")
    again = stored(slim.join(same, "digest").filter(~F.col("id").eqNullSafe(F.col("first"))).select("file", "at", "first"), "revisits")
    rows = located(pages, again, "left").select(pages[id_col].alias("id"), pages[url_col].alias("url"), payload_of(pages[payload_col]).alias("payload"), again["first"].alias("refers_to"))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out = None

        def close() -> None:
            nonlocal out
            if out:
                out.close()
                raw.close()
                files.move(f"{root}/{name}.tmp", f"{root}/{name}")
                done.append((name, count, size))
                out = None

        for b in batches:
            for page_id, url, text, digest, refers_to in zip(*b.columns, strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    raw = files.open_output_stream(f"{root}/{name}.tmp")
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=4, mtime=0)
                data = text.as_py().encode("utf-8", "surrogatepass")
                whole = record(page_id.as_py(), url.as_py(), data, digest.as_py(), len(data), refers_to.as_py())
                out.write(whole)
                count, size = count + 1, size + len(whole)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return stored(rows.mapInArrow(lean(run), MANIFEST), "manifest")


def spread(df: DataFrame) -> DataFrame:
    """One archive a task."""
    return df.repartition(max(1, df.count()))


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each archive of the manifest, from one folder to another; the stored index of all records.  Next to each archive
    lies its own index, ``.idx``, for readers that have nothing but the folder (``index_of``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, root), (there, to) = filesystem(source), filesystem(target)
        there.create_dir(to, recursive=True)
        for b in batches:
            for name in b.column("archive").to_pylist():
                mark, at, lines = uuid.uuid4().hex[:8], 0, []
                with (
                    files.open_input_stream(f"{root}/{name}", compression=None) as raw,
                    there.open_output_stream(f"{to}/{name}.{mark}", compression=None) as out,
                    there.open_output_stream(f"{to}/{name}.idx.{mark}", compression=None) as idx,
                ):
                    for head, whole in records(inflate(raw)):
                        member = gzip.compress(whole, 4, mtime=0)
                        out.write(member)
                        line = (name, at, len(member), head["warc-type"], head["warc-record-id"].strip("<>"), head.get("warc-target-uri", ""), head.get("warc-payload-digest", ""))
                        idx.write((json.dumps(dict(zip(FIELDS[1:], line[1:], strict=True))) + "\n").encode())
                        lines.append(line)
                        at += len(member)
                        if len(lines) == 1000:
                            yield batch(lines)
                            lines = []
                for end in ("", ".idx"):
                    there.move(f"{to}/{name}{end}.{mark}", f"{to}/{name}{end}")
                if lines:
                    yield batch(lines)

    return stored(spread(manifest).mapInArrow(lean(run), INDEX), "index")


FIELDS = [x.split()[0] for x in INDEX.split(", ")]


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a folder of normalised archives, from the ``.idx`` files in it; one row per record, as ``normalise`` returned them."""
    lines = spark.read.schema(INDEX).json(f"{folder}/*.idx")
    return lines.select(F.regexp_replace("_metadata.file_name", r"\.idx$", "").alias("archive"), *FIELDS[1:])


def batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], FIELDS)


def read(index: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per record of the index, read by its offset alone: id, target, type, refers_to, payload_bytes, digest, payload (null in
    revisits).  The digest of a payload that is there is worked out anew and must agree with the header."""
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(id_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        name, source = None, None
        for b in batches:
            for part in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                rows = []
                for archive, offset, length in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    if archive != name:
                        if source:
                            source.close()
                        name, source = archive, files.open_input_file(f"{root}/{archive}")
                    source.seek(offset)
                    whole = gzip.decompress(source.read(length))
                    end = whole.index(b"\r\n\r\n")
                    head, block = headers(whole[:end]), whole[end + 4 : -4]
                    cut = block.index(b"\r\n\r\n")
                    http, payload = headers(block[:cut]), block[cut + 4 :]
                    revisit = head["warc-type"] == "revisit"
                    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
                    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{archive} at {offset}: the payload's digest or length is not that of its headers")
                    ids = [head[k].strip("<>").removeprefix(URN) if k in head else "" for k in ("warc-record-id", "warc-refers-to")]
                    rows.append((ids[0] or None, head.get("warc-target-uri"), head["warc-type"], ids[1] or None, size, digest, None if revisit else payload))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.string()).cast(kind) if k in (0, 3) else pa.array(c, t) for k, (c, t) in enumerate(zip(columns, [None, pa.string(), pa.string(), None, pa.int64(), pa.string(), pa.binary()], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "target", "type", "refers_to", "payload_bytes", "digest", "payload"])
        if source:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(lean(run), f"id {id_type}, target string, type string, refers_to {id_type}, payload_bytes long, digest string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes, normalises and reads back."""
    spark = pages.sparkSession
    whole, members = new_path(spark, "warc-monolithic"), new_path(spark, "warc")
    index = normalise(write(pages, whole, id_col, url_col, payload_col), whole, members)
    return read(index, members, pages.schema[id_col].dataType.simpleString())
