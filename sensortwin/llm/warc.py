"""WARC archives with a two-level capture index.

Write: pages become WARC 1.1 records, one gzip member per record, one archive file per task, in the
folder the caller names (any store that ``pyarrow.fs`` opens).  Of records with equal payloads the
one of the smallest page id is the response, the others are revisits that refer to it.

Index: one line per record - reversed-host URL key, page id, file, offset, length - sorted over the
whole archive.  Each index file holds gzip blocks of ``BLOCK_LINES`` sorted lines and ends with its
sparse directory (first key, offset and length of every block).  The master table has one row per
index file with its first key.

Look up: every task takes a range of the wanted keys in order.  It reads the master once (one line per index
file, written as one sorted file beside the index), bisects it for each key, then the directory of the file found,
fetches only the block, and the record is read by its byte range.

Files are written under a name of the task attempt's own and become part of the archive only by the
rows the finished task returns, so a lost executor or a second attempt leaves no half record behind.

Nulls and edge cases: null html is an empty payload, a null url an empty target whose key is empty;
rows without a page id are written too, order after all others and are never the response while an
id exists; repeated rows are records of their own (of equal ids and payloads one is the response, which one
is decided by url and then by order, the others revisit that id); pages of an empty table give an archive without files.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensortwin.llm.common import join_path, map_rows, ship, stored

BLOCK_LINES = 3000
_DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time; a fixed one keeps archives reproducible
_LOCATION = "file string, offset long, length long"


# -- storage ----------------------------------------------------------------------------------
def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, by URI or local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def read_range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def payload_of(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


# -- records ----------------------------------------------------------------------------------
def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query (``com,example,www)/a?b``)."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:  # a malformed port or address: the URL stands for itself
        return ")" + url.strip()
    if not host:
        return ")" + url.strip()
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + rest


def _header(value: str) -> str:
    return " ".join(value.split())  # no line break may end a header early


def record(kind: str, record_id: str, url: str, payload: bytes, digest: str, headers: dict[str, str]) -> bytes:
    """One WARC record.  A revisit has no block; its payload is the one of the record it refers to."""
    block = payload if kind == "response" else b""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _DATE, "WARC-Target-URI": _header(url),
             "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "text/html; charset=utf-8", **headers,
             "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    return headers, rest[: int(headers["Content-Length"])]


# -- writing ----------------------------------------------------------------------------------
def plan_records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, first): what each record will be.  Payloads of at
    least ``least`` bytes that are equal share one response.  Only digests and ids are shuffled; a
    hot payload is pre-aggregated in every map task and its rows are matched by a join whose skewed
    side Spark can split."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload_of(F.col(html_col)).alias("payload"))
    key = F.struct(F.sha1("payload").alias("d"), F.length("payload").alias("n"))
    # of repeated rows with the smallest id one is the response; the row number tells them apart
    narrow = stored(rows.select("page_id", key.alias("k")), "warc-digests").withColumn("d", F.col("k.d")).withColumn("n", F.col("k.n"))
    groups = narrow.where(F.col("n") >= least).groupBy("d", "n").agg(
        F.min("page_id").alias("response"), F.count("*").alias("m")).where("m > 1")
    narrow = narrow.select("page_id", "d", "n").distinct()
    owner = narrow.join(groups, ["d", "n"]).select("page_id", "d", "n", "response")
    revisit = owner.where(~F.col("page_id").eqNullSafe(F.col("response"))).select(
        F.col("page_id").alias("rid"), F.col("d").alias("rd"), F.col("n").alias("rn"), "response")
    out = rows.withColumn("d", F.sha1("payload")).withColumn("n", F.length("payload").cast("long"))
    out = out.join(revisit, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("d") == F.col("rd")) & (F.col("n") == F.col("rn")), "left")
    return out.select("page_id", "url", "payload", "n", F.col("response").alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Write all pages below ``folder``; returns the location rows (key, page_id, file, offset, length)."""
    ship(pages.sparkSession)
    plan = plan_records(pages, least, id_col, url_col, html_col)
    again = _repeated(pages, id_col, html_col, least)
    if again is not None:
        plan = plan.join(again, (F.col("page_id") == F.col("aid")) & (F.sha1("payload") == F.col("ad")), "left")
        nth = F.row_number().over(Window.partitionBy("page_id", "ad").orderBy(F.col("url").asc_nulls_last()))
        single = plan.where("aid is null")
        plan = single.select("page_id", "url", "payload", "n", "refers_to").unionByName(
            plan.where("aid is not null").withColumn("nth", nth).select(
                "page_id", "url", "payload", "n", F.when((F.col("nth") > 1) & F.col("refers_to").isNull(), F.col("page_id")).otherwise(
                    F.col("refers_to")).alias("refers_to")))
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, f"pages-{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                rows = []
                for i, url, payload, ref in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    out = out or fs.open_output_stream(join_path(root, name), compression=None)
                    digest, rid = sha1_base32(payload), f"urn:uuid:{uuid.uuid4()}"
                    headers = {"X-Page-Id": "" if i is None else str(i), "X-Payload-Length": str(len(payload))}
                    if ref is not None:
                        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(ref)}
                    member = gzip.compress(record("response" if ref is None else "revisit", rid, url or "", payload, digest, headers), 6, mtime=0)
                    out.write(member)
                    rows.append((url_key(url), i, name, at, len(member)))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        finally:
            if out:
                out.close()

    return stored(plan.mapInArrow(run, f"key string, page_id long, {_LOCATION}"), "warc-locations")


def _repeated(pages: DataFrame, id_col: str, html_col: str, least: int) -> DataFrame | None:
    """Ids and digests of rows that repeat as a whole, none where every id has one row."""
    narrow = pages.select(F.col(id_col).cast("long").alias("aid"), F.sha1(payload_of(F.col(html_col))).alias("ad"), F.length(payload_of(F.col(html_col))).alias("n"))
    twice = narrow.where((F.col("n") >= least) & F.col("aid").isNotNull()).groupBy("aid", "ad").count().where("count > 1").select("aid", "ad")
    twice = stored(twice, "warc-repeated")
    return None if twice.isEmpty() else twice


# -- index ------------------------------------------------------------------------------------
def write_index(locations: DataFrame, folder: str) -> DataFrame:
    """Sort the location rows into index files; returns the master table (first_key, last_key, file,
    directory_offset, directory_length), one row per index file."""
    ship(locations.sparkSession)
    # a hot key (one host, one URL) is spread over files by the id that follows it
    ordered = locations.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()),
                        ("directory_offset", pa.int64()), ("directory_length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name, out, at, lines, directory, last = f"index-{uuid.uuid4().hex}.gz", None, 0, [], [], None

        def flush():
            nonlocal out, at, lines
            out = out or fs.open_output_stream(join_path(root, name), compression=None)
            block = gzip.compress("".join(json.dumps(x) + "\n" for x in lines).encode(), 6, mtime=0)
            out.write(block)
            directory.append((lines[0][0], at, len(block)))
            at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                lines.append(row)
                last = row[0]
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            sparse = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            out.write(sparse)
            out.close()
            yield pa.RecordBatch.from_pydict({"first_key": [directory[0][0]], "last_key": [last], "file": [name],
                                              "directory_offset": [at], "directory_length": [len(sparse)]}, schema=schema)

    return stored(ordered.mapInArrow(run, "first_key string, last_key string, file string, directory_offset long, directory_length long"), "warc-master")


def blocks_for(directory: list, key: str) -> list[tuple[int, int]]:
    """Blocks (offset, length) that may hold ``key``, by bisection of the first keys: the last block
    that starts before the key and those that start with it."""
    a = max(0, bisect.bisect_left(directory, key, key=lambda d: d[0]) - 1)
    return [(o, n) for _, o, n in directory[a : bisect.bisect_right(directory, key, key=lambda d: d[0])]]


def _fetch(fs: pafs.FileSystem, path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    return parse_record(gzip.decompress(read_range(fs, path, offset, length)))


_RECORD = "page_id long, key string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _row(headers: dict[str, str], block: bytes, key: str) -> dict:
    page, ref = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and sha1_base32(block) != digest:
        raise ValueError(f"payload of page {page} does not match its digest")
    return {"page_id": int(page) if page else None, "key": key, "payload_bytes": int(headers["X-Payload-Length"]), "payload_digest": digest,
            "record_type": headers["WARC-Type"], "refers_to": int(ref) if ref else None, "payload": block if headers["WARC-Type"] == "response" else None}


def _master_file(master: DataFrame) -> str | None:
    """The master as one sorted Parquet file, by path; none where there is no index file."""
    one = stored(master.coalesce(1).sortWithinPartitions("first_key", "last_key", "file"), "warc-master-sorted")
    files = one.inputFiles()
    return files[0] if files and not one.isEmpty() else None


class Master:
    """The bounds and directories of all index files, in the order of their first keys."""

    def __init__(self, path: str):
        fs, file = open_store(path)
        with fs.open_input_file(file) as f:
            rows = pq.read_table(f).to_pydict()
        self.first, self.last = rows["first_key"], rows["last_key"]
        self.where = list(zip(rows["file"], rows["directory_offset"], rows["directory_length"], strict=True))

    def files_for(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Index files that may hold ``key``, by bisection: the last that starts at or before it, and those before
        that one which end with it."""
        at = bisect.bisect_right(self.first, key) - 1
        while at >= 0 and self.last[at] >= key:
            yield self.where[at]
            at -= 1


def locate(spark: SparkSession, folder: str, master: DataFrame, keys: DataFrame) -> DataFrame:
    """Index lines of the wanted ``key`` values; tasks take ranges of keys in order, so each opens few index files and reads
    each block it needs once."""
    ship(spark)
    wanted = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    top = _master_file(master)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        files = Master(top) if top else None
        directory, of, block, lines, at = None, None, [], [], None
        for batch in batches if files else ():
            hits = []
            for key in batch.column("key").to_pylist():
                for file, off, n in files.files_for(key):
                    path = join_path(root, file)
                    if of != file:
                        directory, of, at = json.loads(gzip.decompress(read_range(fs, path, off, n))), file, None
                    for place in blocks_for(directory, key):
                        if at != place:
                            block = [json.loads(x) for x in gzip.decompress(read_range(fs, path, *place)).splitlines()]
                            lines, at = [x[0] for x in block], place
                        hits += block[bisect.bisect_left(lines, key) : bisect.bisect_right(lines, key)]
                if len(hits) >= BLOCK_LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), types, strict=True)], names)
                    hits = []
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), types, strict=True)], names)

    names, types = ["key", "page_id", "file", "offset", "length"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return wanted.mapInArrow(run, f"key string, page_id long, {_LOCATION}")


def lookup(spark: SparkSession, folder: str, master: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of the wanted ``key`` values: index lines by bisection, then range reads."""
    return _fetched(folder, locate(spark, folder, master, keys))


def _records(fs, root, hits: list) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for key, _, file, off, n in hits:
        rows.append(_row(*_fetch(fs, join_path(root, file), off, n), key))
        size += len(rows[-1]["payload"] or b"")
        if size > 8 << 20 or len(rows) >= 2000:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)


def _fetched(folder: str, found: DataFrame) -> DataFrame:
    """The records of index lines, each by its byte range, in the order of the archive files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            hits = list(zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True))
            hits.sort(key=lambda h: (h[2], h[3]))
            yield from _records(fs, root, hits)

    # ranges of a file stay together, large files are shared by tasks
    return found.repartitionByRange("file", "offset").mapInArrow(run, _RECORD)


def read_index_blocks(spark: SparkSession, folder: str, master: DataFrame) -> DataFrame:
    """Every (index file, block offset, block length) by the files' directories."""

    def run(batch):
        fs, root = open_store(folder)
        out = {"file": [], "offset": [], "length": []}
        for file, off, n in zip(*(batch.column(c).to_pylist() for c in ("file", "directory_offset", "directory_length")), strict=True):
            for _, o, length in json.loads(gzip.decompress(read_range(fs, join_path(root, file), off, n))):
                out["file"].append(file)
                out["offset"].append(o)
                out["length"].append(length)
        return out

    return map_rows(master, run, _LOCATION)


def read_archive(spark: SparkSession, folder: str, master: DataFrame) -> DataFrame:
    """All records, read back through the index: blocks first, then each record by its byte range,
    in the order of the archive files."""
    ship(spark)

    def lines(batch):
        fs, root = open_store(folder)
        rows = [json.loads(x) for f, o, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
                for x in gzip.decompress(read_range(fs, join_path(root, f), o, n)).splitlines()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        return dict(zip(("key", "page_id", "file", "offset", "length"), cols, strict=True))

    found = map_rows(read_index_blocks(spark, folder, master).repartition("file", "offset"), lines, f"key string, page_id long, {_LOCATION}")
    return _fetched(folder, found)
