"""Operator 1: WARC archives with a two-level capture index.

Writing: pages are dealt out with their payload digests; each task writes one
archive of gzipped records to the shared folder. Of records with equal
payloads of at least 1000 bytes the one with the largest page_id is the
response, the others are revisits that name it; a revisit's block is its HTTP
header alone. File names carry the task attempt, and the manifest, a staged
table, has the rows of the attempts that Spark committed, so a lost executor
or a second attempt leaves only files that nothing names.

Index: captures are range-sorted by reversed-host key and written by each task
as one file of compressed blocks followed by the sparse directory of the
blocks' first keys. The list of files with their first keys is the upper
level; its length is the number of tasks.

Reading: requests are dealt out by the same key, each task binary-searches the
upper level, then the directory, range-reads and inflates one block, searches
it, and so gets archive, offset and length. Requests are then dealt out by
archive and read in the order of offsets, each with one range read.

Behaviour: a null url has an empty key; null html is an empty payload; repeated
page_ids are records of their own, each read back once; a row without page_id
is a response with no number (its key in the index ends in U+0000) and is no
copy's original; payloads of any length are one record each; batches of pages
are bounded by bytes; a table without rows gives no archive and no result;
only ``page_id``, ``url`` and ``html`` are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch

#: Payloads shorter than this are always written in full.
LEAST = 1000
#: Captures in one compressed block of the index.
BLOCK = 512
WARC_DATE = "1970-01-01T00:00:00Z"


def surt(url: Column) -> Column:
    """Reversed-host key: ``com,example,www)/path?query``, lower-case host, without scheme and fragment."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), path)


def capture(pages: DataFrame) -> dict[str, Column]:
    """``key`` and ``number`` of pages in the index."""
    key, number = surt(F.coalesce(pages["url"].cast("string"), F.lit(""))), pages["page_id"].cast("long")
    return {"key": F.when(number.isNull(), F.concat(key, F.lit("\0"))).otherwise(key), "number": F.coalesce(number, F.lit(0))}


def _header(first: str, fields: list[tuple[str, str]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response or revisit record."""
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    body = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_header("WARC/1.1", fields) + body + b"\r\n\r\n") + pack.flush()


def _fields(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}, rest


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None, str]:
    """page_id, payload bytes, payload digest (hex), record type, refers-to, url; a response's payload is checked."""
    raw = zlib.decompress(member, 31)
    warc, rest = _fields(raw)
    body = rest[: int(warc["content-length"])]
    http, payload = _fields(body)
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    bare = lambda v: v.removeprefix("<urn:page:").removesuffix(">")
    number = lambda v: None if bare(v) == "none" else int(bare(v))
    page, size = number(warc["warc-record-id"]), int(http["content-length"])
    if warc["warc-type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record of page {page} is damaged")
        return page, size, digest, "response", None, warc["warc-target-uri"]
    return page, size, digest, "revisit", number(warc["warc-refers-to"]), warc["warc-target-uri"]


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where, path


def _attempt() -> str:
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}"


def write_archives(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write all pages; the staged manifest ``(key, number, archive, start, length)``."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    copies = base.where(F.col("size") >= LEAST).groupBy("digest", "size").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "newest")
    # only payloads with copies have a partner; a page_id that repeats is no revisit of itself
    marked = base.join(copies, ["digest", "size"], "left").select("page_id", "url", *(c.alias(k) for k, c in capture(base).items()), "html", "digest", F.when(F.col("page_id") < F.col("newest"), F.col("newest")).alias("refers_to"))
    folder = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        where.create_dir(path, recursive=True)
        name, at, out = f"{_attempt()}.warc.gz", 0, None
        try:
            for b in batches:
                rows, starts, sizes = b.to_pydict(), [], []
                for page, url, html, digest, ref in zip(rows["page_id"], rows["url"], rows["html"], rows["digest"], rows["refers_to"], strict=True):
                    if out is None:
                        out = where.open_output_stream(f"{path}/{name}", compression=None)
                    member = record(page, url, html.encode("utf-8", "surrogatepass"), digest, ref)
                    out.write(member)
                    starts.append(at)
                    sizes.append(len(member))
                    at += len(member)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("number"), pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["key", "number", "archive", "start", "length"])
        finally:
            if out is not None:
                out.close()

    return scratch.stage(marked.mapInArrow(run, "key string, number long, archive string, start long, length long"), "manifest")


def write_index(manifest: DataFrame, scratch: Scratch, files: int) -> DataFrame:
    """Write the sorted capture index; the staged upper level ``(first, file, directory_at, directory_length)``."""
    folder = scratch.path("index")
    ordered = manifest.repartitionByRange(files, "key", "number", "archive", "start").sortWithinPartitions("key", "number", "archive", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        where.create_dir(path, recursive=True)
        name = f"{path}/{_attempt()}.cdx"
        out, at, lines, directory = None, 0, [], []

        def flush() -> None:
            nonlocal at, lines
            data = zlib.compress(json.dumps(lines, ensure_ascii=True).encode(), 6)
            out.write(data)
            directory.append((lines[0][0], lines[0][1], at, len(data)))
            at += len(data)
            lines = []

        try:
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("key", "number", "archive", "start", "length")), strict=True):
                    if out is None:
                        out = where.open_output_stream(name, compression=None)
                    lines.append(row)
                    if len(lines) >= BLOCK:
                        flush()
            if lines:
                flush()
            if out is not None:
                data = zlib.compress(json.dumps(directory).encode(), 6)
                out.write(data)
        finally:
            if out is not None:
                out.close()
        if directory:
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]]), pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([at]), pa.array([len(data)])], ["first", "first_id", "file", "directory_at", "directory_length"])

    return scratch.stage(ordered.mapInArrow(run, "first string, first_id long, file string, directory_at long, directory_length long"), "upper")


class Captures:
    """Binary search in the index: upper level, directory of a file, block."""

    def __init__(self, upper: list[tuple[str, int, str, int, int]]) -> None:
        self.upper = sorted(upper)
        self.firsts = [(u[0], u[1]) for u in self.upper]
        self.at, self.directory, self.block_at, self.lines = -1, [], None, []
        self.file = None

    def _read(self, start: int, length: int):
        self.file.seek(start)
        return json.loads(zlib.decompress(self.file.read(length)))

    def find(self, key: str, number: int) -> list[tuple[str, int, int]]:
        """``(archive, start, length)`` of all captures of a page at a key."""
        want, out = (key, number), []
        # equal keys may begin in the file and the block before
        for f in range(max(0, bisect.bisect_left(self.firsts, want) - 1), bisect.bisect_right(self.firsts, want)):
            if f != self.at:
                if self.file is not None:
                    self.file.close()
                where, path = _open(self.upper[f][2])
                self.file = where.open_input_file(path)
                self.at, self.block_at = f, None
                self.directory = [tuple(d) for d in self._read(*self.upper[f][3:5])]
            firsts = [(d[0], d[1]) for d in self.directory]
            for k in range(max(0, bisect.bisect_left(firsts, want) - 1), bisect.bisect_right(firsts, want)):
                if self.block_at != k:
                    self.lines = [tuple(x) for x in self._read(*self.directory[k][2:4])]
                    self.block_at = k
                i = bisect.bisect_left(self.lines, want)
                while i < len(self.lines) and self.lines[i][:2] == want:
                    out.append((self.lines[i][2], self.lines[i][3], self.lines[i][4]))
                    i += 1
        return out


def read_back(requests: DataFrame, upper: DataFrame, files: int) -> DataFrame:
    """Records of ``requests(key, number)`` through the index, a row per record."""
    # bounded: one row per index file, and there are ``files`` of them
    level = requests.sparkSession.sparkContext.broadcast([tuple(r) for r in upper.select("first", "first_id", "file", "directory_at", "directory_length").collect()])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures = Captures(level.value)
        for b in batches:
            got = [c for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c in captures.find(key, page)]
            cols = list(zip(*got, strict=True)) if got else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["archive", "start", "length"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            rows = []
            for archive, start, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    where, path = _open(archive)
                    file, name = where.open_input_file(path), archive
                file.seek(start)
                rows.append(parse(file.read(length)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if file is not None:
            file.close()

    asked = requests.distinct().repartitionByRange(files, "key", "number").sortWithinPartitions("key", "number")
    places = asked.mapInArrow(look, "archive string, start long, length long")
    # stretches of an archive go to one task each, so that an archive of any size is read by many
    near = places.repartitionByRange(files, "archive", "start").sortWithinPartitions("archive", "start")
    return near.mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch = Scratch(spark)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = write_archives(pages, scratch)
    upper = write_index(manifest, scratch, files)
    requests = pages.select(*(c.alias(k) for k, c in capture(pages).items()))
    return read_back(requests, upper, files).drop("url")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS newest FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id < m.newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < m.newest THEN m.newest END AS refers_to
FROM p LEFT JOIN m USING (d)
"""
