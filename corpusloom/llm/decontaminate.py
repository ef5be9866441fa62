"""Operator 5: benchmark decontamination with one Aho-Corasick automaton.

Texts are reduced to lower-case words (runs of digits, ASCII letters and
non-ASCII characters) joined by single spaces. All windows of ten consecutive
words of all benchmark items, or the whole of a shorter item, are the patterns
of one automaton, each framed by spaces so that matches start and end at word
borders. Each document is scanned once; ends of matches map to word numbers by
the places of the spaces, and words map to byte offsets of the original.

The automaton is bounded by ``BLOCK_BYTES`` of benchmark text, the part of it
that is broadcast. A benchmark beyond that is dealt into blocks, each with an
automaton of its own that is built once a task; every block scans the
documents once, and hits are united by word number.

Behaviour: null and empty texts have no words and hit nothing; items without
words have no window; windows shared by items count for each of them; items
without an id count together as one, which no digest names; item ids are of
any type that sorts; repeated rows give repeated results, rows without doc_id
one each; very long texts are scanned whole; an empty benchmark contaminates
nothing, an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.scratch import bounded
from corpusloom.llm.textcore import Hasher, encode, not_alnum

WINDOW = 10
#: Bytes of benchmark text in one automaton (each word stands in ten windows, so about 500 MB of nodes).
BLOCK_BYTES = 1 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(_FOLD).split())


def windows(text: str | None, width: int) -> set[bytes]:
    words = normal(encode(text)).split()
    if not words:
        return set()
    if len(words) < width:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class Scanner:
    """The automaton over ``(item_id, text)`` rows."""

    def __init__(self, items: list[tuple[int, str | None]], width: int) -> None:
        import ahocorasick

        owners: dict[bytes, list[int]] = {}
        for item, text in items:
            for w in windows(text, width):
                owners.setdefault(w, []).append(item)
        self.owners: list[list[int]] = []
        self.machine = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.machine.add_word(f" {w.decode('latin-1')} ", (len(self.owners), w.count(b" ") + 1))
            self.owners.append(ids)
        if owners:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, a mask of hit words, items found."""
        flat = normal(text)
        if not flat:
            return 0, np.zeros(0, bool), set()
        n = flat.count(b" ") + 1
        found = list(self.machine.iter(f" {flat.decode('latin-1')} ")) if self.owners else []
        if not found:
            return n, np.zeros(n, bool), set()
        # a match ends on the space after its last word
        gaps = np.append(np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) + 1, len(flat) + 1)
        last = np.searchsorted(gaps, np.array([at for at, _ in found]))
        width = np.array([w for _, (_, w) in found])
        turns = np.zeros(n + 1, np.int64)
        np.add.at(turns, last - width + 1, 1)
        np.add.at(turns, last + 1, -1)
        return n, np.cumsum(turns[:-1]) > 0, {i for k in {p for _, (p, _) in found} for i in self.owners[k]}


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def _kind(item: T.DataType) -> T.StructType:
    long, span = T.LongType(), T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
    return T.StructType([T.StructField("doc_id", long), T.StructField("key", T.StringType()), T.StructField("n_words", long), T.StructField("n_hit", long), T.StructField("item_ids", T.ArrayType(item)), T.StructField("spans", T.ArrayType(span))])


def blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """Benchmark rows in blocks of bounded size; the driver holds one block at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "") + 64
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    yield rows


def _scan(texts: DataFrame, block: list, width: int, item: T.DataType) -> DataFrame:
    """All rows of ``texts(doc_id, text, key)`` against one block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared, kind = texts.sparkSession.sparkContext.broadcast(block), _kind(item)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, offsets = Scanner(shared.value, width), Hasher(not_alnum())
        for batch in batches:
            out: dict[str, list] = {k: [] for k in arrow.names}
            for doc, text, key in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "key")), strict=True):
                raw = encode(text)
                n, mask, got = scanner.scan(raw)
                spans = []
                if got:
                    starts, ends = offsets.spans(raw)
                    spans = [{"first": a, "last": b, "start_byte": int(starts[a]), "end_byte": int(ends[b - 1])} for a, b in _runs(mask)]
                for k, v in (("doc_id", doc), ("key", key), ("n_words", n), ("n_hit", int(mask.sum())), ("item_ids", sorted(got, key=lambda i: (i is None, i))), ("spans", spans)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return texts.mapInArrow(run, kind)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: word counts, items found, spans of hit words (numbers, the last excluded, and bytes of the original)."""
    spark = docs.sparkSession
    bounded(spark)
    item = benchmark.schema["item_id"].dataType
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = blocks(spark, benchmark, block_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _scan(texts.withColumn("key", F.lit(None).cast("string")), first, width, item).drop("key")
    # rows are told apart by id and text where hits of several blocks meet
    scans = [_scan(texts.withColumn("key", F.sha2("text", 256)), block, width, item) for block in itertools.chain([first, second], parts)]
    hits = functools.reduce(DataFrame.unionAll, scans).where("n_hit > 0").groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    hits = _united(hits, item)
    same = scans[0]["doc_id"].eqNullSafe(hits["doc_id"]) & scans[0]["key"].eqNullSafe(hits["key"])
    none = {"item_ids": F.array().cast(T.ArrayType(item)), "spans": F.array().cast(_kind(item)["spans"].dataType), "n_hit": F.lit(0).cast("long")}
    return scans[0].select("doc_id", "key", "n_words").join(hits, same, "left").select(scans[0]["doc_id"], "n_words", *(F.coalesce(hits[c], none[c]).alias(c) for c in ("n_hit", "item_ids", "spans")))


def _united(hits: DataFrame, item: T.DataType) -> DataFrame:
    """Overlapping and touching spans of ``hits(doc_id, key, item_ids, spans)`` as one, with the number of their words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([f for f in _kind(item) if f.name != "n_words"])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                out: list[dict] = []
                for s in sorted(r["spans"], key=lambda s: s["first"]):
                    if out and s["first"] <= out[-1]["last"]:
                        if s["last"] > out[-1]["last"]:
                            out[-1] |= {"last": s["last"], "end_byte": s["end_byte"]}
                    else:
                        out.append(dict(s))
                r["spans"], r["n_hit"] = out, sum(s["last"] - s["first"] for s in out)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return hits.mapInArrow(run, kind)


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM dg d JOIN win ON d.n = win.n AND d.g = win.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
