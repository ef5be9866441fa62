"""Operator 3: near-duplicates by MinHash, banding and sequential Bayesian verification.

1. Each text becomes the set of its five-word shingles (64-bit hashes), a
   digest of the set, and a signature of minima. Texts with equal sets are one
   class; only its smallest id goes on.
2. Signatures are cut into bands. Classes that agree on a band are in a
   bucket; a bucket pairs each member with ``LEADERS`` leaders, the members that
   come first by a hash of the id, so n members give LEADERS x n pairs at most,
   and buckets of the same documents give the same ones.
3. Each pair's signatures are compared batch by batch. After n hashes with m
   agreements a pair is dropped when, under the Beta posterior of a uniform
   prior, P(similarity >= threshold) is below ``miss``. Survivors are checked
   on their full sets.
4. Components of the confirmed links are found. Buckets whose members are all
   in one component are done: more links can't change anything.
5. What is left are mostly documents near a large component but not of it. For
   each the shingles that another component has too are counted, in 32 classes
   of the shingle's hash. Two sets can't share more than the sum over classes
   of the smaller counts, so a pair whose bound stays below the threshold has
   no link. All other pairs of members of different components go through
   step 3, each once. The bound is exact: no link is lost by it. Members of a
   bucket's largest component are only paired with the bucket's others.

Behaviour: null and empty texts and those without words have empty sets and
link with nothing; texts of fewer than five words have one shingle, the whole
sequence; very long texts are read whole; repeated rows give a row each; equal
doc_ids are one document, of whose texts that of the smallest digest is linked;
a row without doc_id names no component: it gets that of documents with equal
text, else null; an empty table gives no rows. Only ``doc_id`` and ``text`` are
read, so further columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.scratch import Scratch
from corpusloom.llm.textcore import Hasher, ascii_space, encode, mix, sets, shingles

HASHES, BANDS, BATCH = 128, 32, 32
#: Chance at which a pair is given up before its exact check, for a pair at the threshold.
MISS = 1e-6
#: Members of a bucket that all others are compared with first.
LEADERS = 4
#: Classes of shingles in which the bound on an intersection is summed.
CLASSES = 32
#: As many document ids are broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


@cache
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(values: np.ndarray, begin: np.ndarray, n: int = HASHES) -> np.ndarray:
    """Minima of ``n`` hash functions over each non-empty slice, as (slices, n) uint32."""
    out = np.empty((n, len(begin) - 1), np.uint32)
    mul, add = _family(n)
    fold = (values >> np.uint64(32)).astype(np.uint32)
    at = begin[:-1]
    # blocks that stay in cache, cut at slice borders
    cuts = [0]
    while cuts[-1] < len(at):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + 65536, "right")) - 1))
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            b = min(b, len(at))
            own, own_at = fold[begin[a] : begin[b]], at[a:b] - begin[a]
            for k in range(n):
                out[k, a:b] = np.minimum.reduceat(own * mul[k] + add[k], own_at)
    return np.ascontiguousarray(out.T)


def set_digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, digest, signature)``; digest and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_space())
        for b in batches:
            found = sets(*shingles(*hasher.words([encode(t) for t in b.column(1).to_pylist()]), width))
            n = np.array([len(s) for s in found], np.int64)
            full = np.flatnonzero(n)
            signed: list[bytes | None] = [None] * len(found)
            if len(full):
                begin = np.concatenate([[0], np.cumsum(n[full])])
                for k, row in zip(full, signatures(np.concatenate([found[k] for k in full]), begin), strict=True):
                    signed[k] = row.tobytes()
            digest = [set_digest(s) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, digest, items)``: the sorted shingle hashes of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_space())
        for b in batches:
            found = sets(*shingles(*hasher.words([encode(t) for t in b.column(1).to_pylist()]), width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "digest", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, digest binary, items binary")


def least_agreements(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> dict[int, int]:
    """For each number of compared hashes, the fewest agreements with which a pair stays."""
    out = {}
    for n in range(batch, hashes + 1, batch):
        # P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)
        total, m = 0.0, -1
        while total < miss and m <= n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def survivors(pairs: DataFrame, nodes: DataFrame, threshold: float, miss: float, least: dict[int, int] | None = None) -> DataFrame:
    """Those of ``pairs(a, b)`` whose signatures leave the threshold possible."""
    bar = least or least_agreements(threshold, miss)

    @F.pandas_udf("boolean")
    def possible(x: pd.Series, y: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(x), np.uint32).reshape(len(x), HASHES)
        b = np.frombuffer(b"".join(y), np.uint32).reshape(len(y), HASHES)
        live, agree, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, least_m in bar.items():
            agree[live] += (a[live, at:n] == b[live, at:n]).sum(axis=1)
            live, at = live[agree[live] >= least_m], n
        out = np.zeros(len(x), bool)
        out[live] = True
        return pd.Series(out)

    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(possible("sa", "sb")).select("a", "b")


def confirmed(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                out.append(False)
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    left = items.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = items.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    return pairs.join(left, "a").join(right, "b").where(linked("ia", "ib")).select("a", "b")


def outside_counts(rest: DataFrame, items: DataFrame) -> DataFrame:
    """``(node, size, c0, c1, ...)``: of each node of ``rest(node, component)`` the shingles that another component has too, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, component, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(np.full(len(own), component)), pa.array(own)], ["node", "component", "shingle"])

    each = rest.join(items, "node").select("node", "component", "items").mapInArrow(run, "node long, component long, shingle long")
    common = each.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    kind = F.pmod(F.shiftright("shingle", 7), F.lit(CLASSES))
    counts = each.join(common, "shingle").groupBy("node").agg(*(F.count_if(kind == k).cast("int").alias(f"c{k}") for k in range(CLASSES)))
    return counts.join(items.select("node", (F.length("items") / 8).cast("int").alias("size")), "node")


def open_pairs(rest: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """``(node, other)``: pairs in a bucket of ``rest(band, node, component)``, of different components, that the bound doesn't exclude."""
    own = counts.withColumn("shared", sum((F.col(f"c{k}") for k in range(1, CLASSES)), F.col("c0"))).where(100 * F.col("shared") >= percent * F.col("size"))
    bands = rest.groupBy("node").agg(F.collect_set("band").alias("bands"))
    rows = rest.join(own, "node").join(bands, "node")
    most = rest.groupBy("band", "component").count().groupBy("band").agg(F.max(F.struct("count", "component")).alias("most")).select("band", F.col("most.component").alias("main"))
    rows = rows.join(most, "band")
    a, b = rows.alias("a"), rows.where("component <> main").alias("b")
    bound = sum((F.least(f"a.c{k}", f"b.c{k}") for k in range(1, CLASSES)), F.least("a.c0", "b.c0"))
    enough = lambda n: (100 + percent) * n >= percent * (F.col("a.size") + F.col("b.size"))
    once = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.band")
    which = (F.col("a.band") == F.col("b.band")) & (F.col("a.component") != F.col("b.component")) & ((F.col("a.component") == F.col("a.main")) | (F.col("a.node") > F.col("b.node")))
    return a.join(b, which & enough(F.least("a.shared", "b.shared")) & enough(bound) & once).select(F.col("a.node").alias("node"), F.col("b.node").alias("other"))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, miss: float = MISS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row per input row; one without doc_id names no component, it only has that of equal texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    threshold = percent / 100
    least = least_agreements(threshold, miss)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    sketched = scratch.stage(sketch(texts, width), "sketch")
    nodes = scratch.stage(
        sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "signature")).alias("s")).select("digest", F.col("s.doc_id").alias("node"), F.col("s.signature").alias("signature")),
        "nodes",
    )
    per_band = HASHES // BANDS
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("signature", 4 * per_band * k + 1, 4 * per_band)) for k in range(BANDS)))
    bands = nodes.select("node", F.explode(keys).alias("band"))
    first = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)), "node"))["node"]
    leaders = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.array_distinct(F.array(*(first(k) for k in range(LEADERS)))).alias("leaders")).where("lo < hi").select("band", "leaders")
    members = scratch.stage(bands.join(leaders, "band"), "members")  # only buckets with more than one class

    wanted = scratch.stage(members.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    known = nodes.select(F.col("node").alias("doc_id"), "digest")
    own = shingle_sets(texts.join(ids, "doc_id", "left_semi"), width).join(known, ["doc_id", "digest"], "left_semi")
    items = scratch.stage(own.dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("node"), "items"), "sets")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        return scratch.stage(confirmed(survivors(pairs, nodes, threshold, miss, least), items, percent), "links")

    tried = scratch.stage(ordered(members.select("node", F.explode("leaders").alias("other")).where("node <> other")), "pairs")
    links = linked(tried)
    found = scratch.stage(connected_components(links, scratch), "components")

    # whatever is left, unless the bound excludes it
    labelled = scratch.stage(members.select("band", "node").join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "labelled")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    rest = scratch.stage(labelled.join(mixed, "band", "left_semi"), "mixed")
    counts = scratch.stage(outside_counts(rest.select("node", "component").distinct(), items), "counts")
    more = linked(scratch.stage(ordered(open_pairs(rest, counts, percent)).join(tried, ["a", "b"], "left_anti"), "open"))
    if not more.isEmpty():
        found = scratch.stage(connected_components(links.unionAll(more), scratch), "components")

    label = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(label, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g, least(len(w), 5) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT g, k FROM s GROUP BY g, k HAVING count(*) > 1),
c AS MATERIALIZED (SELECT doc_id, g, k FROM s SEMI JOIN common USING (g, k)),
l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM c x JOIN c y ON x.g = y.g AND x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
      JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a) m USING (doc_id)
"""
