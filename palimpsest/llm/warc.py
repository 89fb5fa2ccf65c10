"""WARC archives with a two-level capture index (operator 5).

Each task writes one archive of its records, every record a gzip member of its own, and returns their places.  The
index sorts captures by reversed-host URL key into compressed blocks; each index file ends with its part of the sparse
block directory (each block's first key and place), and a root row per file names its key range.  A lookup picks the
files by their range, binary-searches the directory and then the block, and reads only that block and those records.
Reading everything back takes the same way: blocks are dealt to tasks, which read their lines and then the records by
range, neighbours in an archive at once.

Defined results: null or empty html is an empty payload; a very long payload is one record, whole; a null or malformed
url is indexed under its text as it is; a null ``page_id`` is never the record that others refer to; rows that share the
largest ``page_id`` of equal payloads are all responses; repeated rows are records of their own; an empty table has no
archives; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import few, map_batches, materialize, new_folder, open_fs

#: Payloads of fewer bytes are always stored; lines of an index block; gzip level of records.
LEAST_SHARED, BLOCK_LINES, LEVEL = 1000, 1000, 2
#: Bytes between two records of an archive, and in all, that are still one read; tasks that read everything back.
GAP, AT_ONCE, MOST_TASKS = 64 << 10, 8 << 20, 100_000
#: Digests of repeated payloads that are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 300_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The host's labels in reverse, a bracket, then path and query: captures of a domain sort together."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{i}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or "about:blank"))
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if original is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(original)}", f"X-Refers-To-Page: {original}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


RECORDS = "page_id long, url_key string, archive string, offset long, length long, record_type string"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page; the places of all records."""
    size: Column = F.coalesce(F.octet_length("html"), F.lit(0))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    shared = rows.where(size >= LEAST_SHARED).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("of", "original")
    shared = materialize(shared, "warc-shared")
    shared = few(shared, BROADCAST_DIGESTS) or shared
    typed = rows.join(shared, (F.col("digest") == F.col("of")) & (size >= LEAST_SHARED), "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = open_fs(folder)
        uri, out, at = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                found = []
                for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        fs.create_dir(inner, recursive=True)
                        out = fs.open_output_stream(open_fs(uri)[1], compression=None)
                    member = _gzip(_record(page_id, url, (html or "").encode(), digest, first))
                    out.write(member)
                    found.append((page_id, url_key(url), uri, at, len(member), "response" if first is None else "revisit"))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)] if found else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())], [x.split()[0] for x in RECORDS.split(", ")])
        finally:
            if out:
                out.close()

    return materialize(map_batches(typed.select("page_id", "url", "html", "digest", original.alias("original")), run, RECORDS), "warc-records")


ROOT = "first_key string, last_key string, index_file string, offset long, length long, blocks long, n long"


def _lines(rows: list) -> bytes:
    return _gzip("\n".join(json.dumps(row) for row in rows).encode())


def build_index(records: DataFrame, folder: str) -> DataFrame:
    """Sorted compressed blocks of index lines in ``folder``, and after them their directory; a row per index file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at, lines, n = f"{folder}/part-{uuid.uuid4().hex}.idx.gz", None, 0, [], 0
        directory: list[tuple[str, int, int, int]] = []
        last = None

        def close_block() -> None:
            nonlocal out, at, n, last
            if out is None:
                fs, inner = open_fs(folder)
                fs.create_dir(inner, recursive=True)
                out = fs.open_output_stream(open_fs(uri)[1], compression=None)
            block = _lines(lines)
            out.write(block)
            directory.append((lines[0][0], at, len(block), len(lines)))
            at, n, last = at + len(block), n + len(lines), lines[-1][0]
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    close_block()
        if lines:
            close_block()
        if out:
            tail = _lines(directory)
            out.write(tail)
            out.close()
            row = {"first_key": directory[0][0], "last_key": last, "index_file": uri, "offset": at, "length": len(tail), "blocks": len(directory), "n": n}
            kinds = [("first_key", pa.string()), ("last_key", pa.string()), ("index_file", pa.string()), *((x, pa.int64()) for x in ("offset", "length", "blocks", "n"))]
            yield pa.RecordBatch.from_pylist([row], pa.schema(kinds))

    key = ["url_key", F.col("page_id").asc_nulls_first()]
    dealt = records.select("url_key", "page_id", "archive", "offset", "length", "record_type").repartitionByRange(*key).sortWithinPartitions(*key)
    return materialize(map_batches(dealt, run, ROOT), "warc-root")


def _range(uri: str, offset: int, length: int) -> bytes:
    fs, inner = open_fs(uri)
    with fs.open_input_file(inner) as f:
        return zlib.decompress(f.read_at(length, offset), 31)


def _read_lines(uri: str, offset: int, length: int) -> list:
    return [json.loads(x) for x in _range(uri, offset, length).decode().split("\n")]


def lookup(root: DataFrame, url: str) -> list[tuple[dict[str, str], bytes]]:
    """All captures of a url, by page: headers and block."""
    key = url_key(url)
    files = sorted(root.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("first_key", "index_file", "offset", "length").collect())
    found = []
    for part in files:  # more than one only where one url's captures fill files
        directory = _read_lines(part.index_file, part.offset, part.length)
        firsts = [x[0] for x in directory]
        for _, offset, length, _ in directory[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
            lines = _read_lines(part.index_file, offset, length)
            keys = [x[0] for x in lines]
            for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                found.append(parse_record(_range(line[2], line[3], line[4])))
    return found


def blocks(root: DataFrame) -> DataFrame:
    """index_file, offset, length, n of every index block, from the directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _read_lines(uri, offset, length)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found)), *(pa.array([x[i] for x in found], pa.int64()) for i in (1, 2, 3))], ["index_file", "offset", "length", "n"])

    return map_batches(root.select("index_file", "offset", "length"), run, "index_file string, offset long, length long, n long")


def _records(lines: list) -> Iterator[bytes]:
    """The uncompressed records of index lines, archive by archive; neighbours are read at once."""
    places = sorted((line[2], line[3], line[4]) for line in lines)
    i = 0
    while i < len(places):
        uri = places[i][0]
        fs, inner = open_fs(uri)
        with fs.open_input_file(inner) as f:
            while i < len(places) and places[i][0] == uri:
                start, j, end = places[i][1], i, places[i][1]
                while j < len(places) and places[j][0] == uri and places[j][1] - end <= GAP and (j == i or places[j][1] + places[j][2] - start <= AT_ONCE):
                    end = places[j][1] + places[j][2]
                    j += 1
                data = f.read_at(end - start, start)
                for _, offset, length in places[i:j]:
                    yield zlib.decompress(data[offset - start : offset - start + length], 31)
                i = j


def read_archives(root: DataFrame) -> DataFrame:
    """Per record, from index and archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for data in _records(_read_lines(uri, offset, length)):
                    head, block = parse_record(data)
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"{uri}: the payload of {head['WARC-Record-ID']} is damaged")
                    number = lambda name, head=head: int(head[name]) if head.get(name) else None
                    rows.append((number("X-Page-Id"), size, digest, head["WARC-Type"], number("X-Refers-To-Page")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = root.agg(F.sum("blocks")).first()[0] or 1
    places = blocks(root).select("index_file", "offset", "length")
    if n > 1:  # a set number of tasks, which is not coalesced
        places = places.repartition(min(n, MOST_TASKS))
    return map_batches(places, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archives and index of ``pages``: (places of the records, root of the index)."""
    folder = new_folder(spark, "warc")
    records = write_archives(pages, f"{folder}/archive")
    return records, build_index(records, f"{folder}/index")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(archive(spark, pages)[1])
