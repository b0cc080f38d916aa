"""WARC archives with a two-level capture index.

Writing: pages become gzip-member WARC records (one file a task) in the shared folder. Of
records with equal payloads of at least `min_revisit_bytes`, the one with the largest id is
a `response`, the others `revisit` records that refer to it and carry no payload; smaller
payloads are all responses. The manifest of where each record lies is a written table, so a
file left by a lost task attempt is simply never referred to.

Index: rows (reversed-host URL key, id, file, offset, length) are sorted by range, cut into
blocks of `BLOCK_ROWS` lines and compressed; a sparse directory keeps the first key of every
block. The lower level of the directory is one small file an index part, its upper level the
first key of each part. A lookup binary-searches both, range-reads one block, finds its line
and range-reads one record.

Files go through pyarrow's file systems, so the shared folder may be any store that these
open. Defined results: null html is the empty payload; a null URL is the key `)` and the
empty target; a null id sorts before all others, so it is referred to only if a payload has
no other; rows with the same id and payload are all responses if that id is the largest.
Empty tables give empty archives.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, small_batches, work_path, written

BLOCK_ROWS = 1000
MIN_REVISIT_BYTES = 1000
#: Archive bytes that one task reads back, and index blocks that one task writes.
READ_BYTES, INDEX_BLOCKS = 8 << 20, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The engine reads no clock; archives carry this date unless told another.
WARC_DATE = "1970-01-01T00:00:00Z"
#: Between key and id in index lines; URL keys are percent-encoded and hold no spaces.
_SEP = " "


def payload_digest(html: Column) -> Column:
    """Bare lower-case hexadecimal SHA-1 of the UTF-8 bytes."""
    return F.sha1(F.encode(html, "UTF-8"))


def record_id(page_id: int | None) -> str:
    """The record's URN, from nothing but the id."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'tidemill:page:{page_id}')}"


def clean_uri(url: str | None) -> str:
    """The URL as a header may hold it: spaces, controls and non-ASCII percent-encoded."""
    return quote(url or "", safe="%/:=&?~#+!$,;'@()*[]|")


def url_key(url: str | None) -> str:
    """Reversed host labels, `)`, then everything after the host."""
    _, found, rest = clean_uri(url).partition("://")
    if not found:
        return ")" + clean_uri(url)
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def write_record(page_id: int | None, url: str | None, html: bytes, digest: str, refers: int | None, revisit: bool, size: int, date: str) -> bytes:
    """One gzip member. A revisit holds the HTTP head, whose Content-Length tells the payload's size."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        body += html
    hashed = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean_uri(url)}",
        f"WARC-Payload-Digest: sha1:{hashed}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"Page-ID: {json.dumps(page_id)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers)}>", f"Refers-To-Page-ID: {json.dumps(refers)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


@dataclass(frozen=True)
class Record:
    """What one record says."""

    page_id: int | None
    kind: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None


def read_record(data: bytes) -> Record:
    """Parses one gzip member; raises if a response's payload is not what its header says."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, page = fields["WARC-Type"], json.loads(fields["Page-ID"])
    if kind == "revisit":
        return Record(page, kind, json.loads(fields["Refers-To-Page-ID"]), digest, size, None)
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record of page {page}")
    return Record(page, kind, None, digest, size, payload)


def planned(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, size, winner): winner is the id to refer to, null for responses.

    The winner of each digest is a partial aggregate. The join is outer on the digest, which
    Spark splits where one payload holds a large share of the pages.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), payload_digest(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    keys = pages.select(F.col(id_col).alias("page_id"), payload_digest(html).alias("key"), F.octet_length(html).alias("size"))
    best = keys.where(F.col("size") >= min_revisit_bytes).groupBy("key").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(best.select("key", "best"), rows["digest"] == F.col("key"), "left")
    lost = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", F.when(lost, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", "size", F.when(lost, F.col("best")).alias("winner"))


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = WARC_DATE) -> DataFrame:
    """Writes the archives; gives the manifest (key, page_id, file, offset, length), a written table."""
    spark = pages.sparkSession
    small_batches(spark)
    base = work_path(spark, "warc")
    plan = planned(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit_bytes=min_revisit_bytes)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"  # an attempt's own name
        for b in batches:
            if out is None:
                store, path = pafs.FileSystem.from_uri(base)
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            ids, offsets, lengths = b.column(0).to_pylist(), [], []
            urls = b.column(1).to_pylist()
            for page, url, html, digest, size, winner in zip(ids, urls, *(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                data = write_record(page, url, html.encode(), digest, winner, winner is not None, size, date)
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(map(url_key, urls), pa.string()), pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=schema.names)
        if out is not None:
            out.close()

    files = written(plan.mapInArrow(run, schema), "warc-manifest")
    return files.withColumn("file", F.concat(F.lit(base + "/"), "file"))


def _line(key: str, page_id: int | None) -> str:
    """Sortable text of a key and an id: bytes order is (key, id) order."""
    return f"{key}{_SEP}{'' if page_id is None else format(page_id + (1 << 63), '020d')}"


@dataclass(frozen=True)
class Index:
    """Upper directory level: first line and name of each index part, in order; bounded by the part count."""

    base: str
    firsts: tuple[str, ...]
    parts: tuple[str, ...]


def build_index(manifest: DataFrame, block_rows: int = BLOCK_ROWS) -> Index:
    """Sorts the manifest by range and writes blocks and directories to the shared folder."""
    spark = manifest.sparkSession
    base = work_path(spark, "capture-index")
    # numbers of tasks are given, for Spark would merge these small rows into one
    tasks = 1 + manifest.count() // (INDEX_BLOCKS * block_rows)
    ordered = manifest.repartitionByRange(tasks, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    schema = T.StructType([T.StructField("first", T.StringType()), T.StructField("part", T.StringType()), T.StructField("blocks", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, p, f"{_line(k, p)}\t{f.rpartition('/')[2]}\t{o}\t{n}") for b in batches for k, p, f, o, n in zip(*(b.column(i).to_pylist() for i in range(5))))
        name, at, directory, store = uuid.uuid4().hex, 0, [], None
        while block := list(itertools.islice(rows, block_rows)):
            if store is None:
                store, path = pafs.FileSystem.from_uri(base)
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}.blocks", compression=None)
            data = zlib.compress("\n".join(x[2] for x in block).encode(), 6)
            out.write(data)
            directory.append((_line(*block[0][:2]), at, len(data)))
            at += len(data)
        if store is None:
            return
        out.close()
        with store.open_output_stream(f"{path}/{name}.directory", compression=None) as f:
            f.write(zlib.compress(json.dumps(directory).encode()))
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name]), pa.array([len(directory)], pa.int64())], names=schema.names)

    parts = sorted((r["first"], r["part"]) for r in written(ordered.mapInArrow(run, schema), "index-parts").collect())
    return Index(base, tuple(x for x, _ in parts), tuple(x for _, x in parts))


class Reader:
    """Binary search over both directory levels, then range reads; keeps the last few files open."""

    def __init__(self, index: Index, archive: str, open_files: int = 32):
        self.index, self.archive, self.most = index, archive, open_files
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.part = self.block = ("", None)
        self.reads = 0

    def _range(self, path: str, at: int, n: int) -> bytes:
        f = self.files.pop(path, None)
        if f is None:
            store, local = pafs.FileSystem.from_uri(path)
            f = store.open_input_file(local)
            if len(self.files) >= self.most:
                self.files.popitem(last=False)[1].close()
        self.files[path] = f
        self.reads += 1
        return f.read_at(n, at)

    def _directory(self, part: str) -> list:
        if self.part[0] != part:
            store, path = pafs.FileSystem.from_uri(f"{self.index.base}/{part}.directory")
            with store.open_input_stream(path, compression=None) as f:
                rows = json.loads(zlib.decompress(f.read()))
            self.part = (part, ([r[0] for r in rows], rows))
        return self.part[1]

    def _block(self, part: str, at: int, n: int) -> list[str]:
        if self.block[0] != (part, at):
            self.block = ((part, at), zlib.decompress(self._range(f"{self.index.base}/{part}.blocks", at, n)).decode().split("\n"))
        return self.block[1]

    def captures(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture of this key and id, in index order.

        A capture repeated over block or part borders is followed to its last line.
        """
        want, found = _line(key, page_id), []
        p = max(0, bisect.bisect_left(self.index.firsts, want) - 1)
        for part in self.index.parts[p:]:
            firsts, rows = self._directory(part)
            if firsts[0] > want:
                return found
            for _, at, n in rows[max(0, bisect.bisect_left(firsts, want) - 1) :]:
                lines = self._block(part, at, n)
                i = bisect.bisect_left(lines, want + "\t")
                if i < len(lines) and lines[i] > want + "\n":
                    return found
                for line in lines[i:]:
                    head, name, at_, n_ = line.split("\t")
                    if head != want:
                        return found
                    found.append((f"{self.archive}/{name}", int(at_), int(n_)))
        return found

    def record(self, capture: tuple[str, int, int]) -> Record:
        """The record at a capture."""
        return read_record(self._range(*capture))


def read_pages(wanted: DataFrame, index: Index, archive: str, *, id_col: str = "page_id", url_col: str = "url", tasks: int | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each wanted row's capture.

    Wanted rows are sorted by range like the index, so neighbours share blocks, into as many
    tasks as given: each row costs a range read. Repeats of one (url, id) take its captures in turn.
    """
    keys = wanted.select(F.col(url_col).alias("url"), F.col(id_col).cast("long").alias("page_id"))
    keys = map_arrow(keys, lambda: lambda b: pa.RecordBatch.from_arrays([pa.array(map(url_key, b.column(0).to_pylist()), pa.string()), b.column(1)], names=["key", "page_id"]), T.StructType([T.StructField("key", T.StringType()), T.StructField("page_id", T.LongType())]))
    counted = keys.groupBy("key", "page_id").agg(F.count("*").alias("n"))
    ranges = ("key", "page_id") if tasks is None else (tasks, "key", "page_id")
    ordered = counted.repartitionByRange(*ranges).sortWithinPartitions("key", "page_id")
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])

    def make():
        reader = Reader(index, archive)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = []
            for key, page, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                captures = reader.captures(key, page)
                if len(captures) < n:
                    raise LookupError(f"page {page}: {n} captures wanted, {len(captures)} in the index")
                got += [reader.record(c) for c in captures[:n]]
            rows = [(r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to) for r in got]
            return pa.RecordBatch.from_arrays([pa.array(list(x), f) for x, f in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=schema.names)

        return step

    return map_arrow(ordered, make, schema)


def archive_and_read(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes pages' archives and their index, then reads every page back through the index."""
    manifest = write_archive(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit_bytes=min_revisit_bytes)
    size = manifest.agg(F.min("file").alias("file"), F.sum("length").alias("n")).head()
    if size["file"] is None:
        return read_pages(pages.limit(0), Index("", (), ()), "", id_col=id_col, url_col=url_col)
    return read_pages(pages, build_index(manifest), size["file"].rpartition("/")[0], id_col=id_col, url_col=url_col, tasks=1 + size["n"] // READ_BYTES)
