"""Operator 7: sharding by weighted rendezvous hashing (DataFrame functions only).

Each record key gets a score on every shard, ``-weight / ln(u)`` with ``u`` a
uniform number from a hash of key and shard, and goes to the shard of the
highest score. A new shard takes only the records on which it scores highest;
no record moves between old shards.

Slots (gapless numbers within a shard) come from counts of (shard, bucket)
groups: rows are numbered inside a bucket and shifted by the sizes of the
buckets before it, so no task sees a whole shard.

Behaviour: null texts have no bytes and the checksum of the empty text; rows
that repeat a key share its shard and get slots of their own; a null key is
placed as the empty string is; ties of scores go to the smaller shard number;
an empty table gives no rows; columns named ``shard``, ``grown_shard`` or
``slot`` are replaced, all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.digests import utf8_len
from corpusloom.llm.scratch import Scratch

#: Buckets a shard's rows are numbered in; the table of their sizes has shards x buckets rows.
BUCKETS = 256


def _unit(key: Column, salt: int) -> Column:
    """A uniform number in (0, 1) from 52 bits of md5(key:salt); any SQL engine can repeat it."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(salt)))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def scores(key: Column, weights: Sequence[float]) -> list[Column]:
    return [F.lit(-float(w)) / F.log(_unit(key, s)) for s, w in enumerate(weights)]


def assign(docs: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (with one more shard)."""
    *old, new = scores(F.col(key), [*(weights or [1.0] * shards), new_weight])
    best = F.array_max(F.array(*(F.struct(c.alias("score"), F.lit(-s).alias("order")) for s, c in enumerate(old))))
    chosen = docs.withColumns({"__best": best, "__new": new})
    shard = (-F.col("__best.order")).cast("int")
    return chosen.withColumns({"shard": shard, "grown_shard": F.when(F.col("__new") > F.col("__best.score"), F.lit(shards)).otherwise(shard).cast("int")}).drop("__best", "__new")


def with_slots(docs: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``slot``, gapless from 0 within ``shard``, in the order of (bucket, key)."""
    spread = docs.withColumn("__bucket", F.coalesce(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int"), F.lit(0)) % buckets)
    sizes = spread.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    own = Window.partitionBy("shard", "__bucket").orderBy(F.col(key).asc_nulls_first())
    numbered = spread.withColumn("__at", F.row_number().over(own) - 1)
    # bounded: shards x buckets rows
    return numbered.join(F.broadcast(shift), ["shard", "__bucket"]).withColumn("slot", (F.col("__at") + F.col("__shift")).cast("long")).drop("__bucket", "__at", "__shift")


def op7_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (utf8_len(F.col("text")) + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = with_slots(Scratch(spark).stage(assign(docs, "doc_id", shards), "placed"), "doc_id")  # read twice, scored once
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP7_SQL = r"""
WITH RECURSIVE tbl(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM tbl WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tbl WHERE k = 8),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
             xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
      FROM documents, crc),
u AS (SELECT doc_id, s, -1.0 / ln((CAST('0x' || substr(md5(doc_id || ':' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE) AS score FROM documents, range(25) r(s)),
g AS (SELECT doc_id, arg_max(s, {'v': score, 'o': -s}) FILTER (WHERE s < 24) AS shard, arg_max(s, {'v': score, 'o': -s}) AS grown FROM u GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 256, doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN g USING (doc_id)
"""
