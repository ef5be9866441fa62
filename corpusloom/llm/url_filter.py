"""Operator 6: URL filters by a sorted digest array.

The rules' 64-bit xxhash keys are sorted into one binary file in the shared
folder, beside their full strings and verdicts. Workers memory-map the file
(or read it, where the shared folder is not a file system of the machine),
hash every candidate of a batch (each host suffix with each rule-path length
that occurs), probe by one vectorised binary search and confirm hits on the
stored strings, so colliding digests can never decide.

Behaviour: the longest fitting rule (host and path together) wins, ties by the
string; where a rule is listed twice the first listing counts; no rule: the
verdict is ``allow``. A url that is null or has no ``://`` has an empty host
and path and fits no rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch, bounded

RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
DEFAULT = "allow"
_MAGIC = b"URLRULE1"


def build(rules: list[tuple[str, str]]) -> bytes:
    """The index file: header, sorted keys, string offsets, verdicts, path lengths, strings."""
    import xxhash

    seen: dict[str, str] = {}
    for verdict, rule in rules:
        if rule:
            seen.setdefault(rule, verdict)
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in seen.items())
    paths = sorted({len(r[r.find(b"/") :]) if b"/" in r else 0 for _, r, _ in rows})
    keys = np.array([k for k, _, _ in rows], "<u8")
    ends = np.cumsum([0, *(len(r) for _, r, _ in rows)]).astype("<u8")
    block = np.array([v == "block" for _, _, v in rows], "u1")
    head = np.array([len(rows), len(paths)], "<u8")
    return b"".join([_MAGIC, head.tobytes(), np.array(paths, "<u8").tobytes(), keys.tobytes(), ends.tobytes(), block.tobytes(), *(r for _, r, _ in rows)])


class Index:
    """A read-only view of an index file."""

    def __init__(self, data: np.ndarray) -> None:
        if data[:8].tobytes() != _MAGIC:
            raise ValueError("not a rule index")
        n, p = (int(x) for x in data[8:24].view("<u8"))
        at = 24
        self.paths = data[at : at + 8 * p].view("<u8").tolist()
        at += 8 * p
        self.keys = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = data[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.block = data[at : at + n]
        self.strings = data[at + n :]

    @classmethod
    def open(cls, uri: str) -> Index:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        if isinstance(where, fs.LocalFileSystem):
            return cls(np.memmap(path, np.uint8, "r"))
        with where.open_input_file(path) as f:
            return cls(np.frombuffer(f.read(), np.uint8))

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Row of each candidate in the index, or -1."""
        import xxhash

        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        probe = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, probe)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probe))
        for k in hit:
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == probe[k]:  # equal digests stand together
                if self.string(i) == candidates[k]:
                    out[k] = i
                    break
                i += 1
        return out


def judge(index: Index, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
    found: list[bytes | None] = [None] * len(hosts)
    verdicts = [DEFAULT] * len(hosts)
    cands, owner = [], []
    for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        if not host:
            continue
        labels, tail = host.encode().split(b"."), path.encode()
        heads = [tail[:n] for n in index.paths if n <= len(tail)]
        for i in range(len(labels)):
            suffix = b".".join(labels[i:])
            cands.extend(suffix + h for h in heads)
            owner.extend([k] * len(heads))
    for j, i in enumerate(index.find(cands)):
        k = owner[j]
        if i >= 0 and (found[k] is None or (len(cands[j]), cands[j]) > (len(found[k]), found[k])):
            found[k] = cands[j]
            verdicts[k] = "block" if index.block[i] else "allow"
    return [None if f is None else f.decode() for f in found], verdicts


def split_url(url: str = "url") -> dict[str, F.Column]:
    """Host and path columns, JVM-side."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(lower, F.lit("")), "path": F.coalesce(path, F.lit(""))}


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """``page_id`` with host, path, rule and verdict."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    bounded(spark)
    uri = write_index(spark, scratch, build(list(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.open(uri)
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            rule, verdict = judge(index, hosts, paths)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    parts = split_url(url)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), parts["host"].alias("host"), parts["path"].alias("path"))
    return slim.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def write_index(spark: SparkSession, scratch: Scratch, data: bytes) -> str:
    """Put the index file in the shared folder, through Hadoop's file systems."""
    jvm, at = spark._jvm, scratch.path("rules.idx")
    path = jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()
    return at


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


OP6_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM u JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
      GROUP BY page_id)
SELECT u.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)
"""
