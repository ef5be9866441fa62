"""Centroids, similar voices, verification, cameos, acoustic prints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import alias_fold, beat_band, duration_tag, reliable_pitch, tone_shape, voice_from_pitch
from corpusloom.plans.catalogue import Catalogue, table

VOICES = Catalogue()


def centroids(prints: DataFrame, author: str, vector: str) -> DataFrame:
    """Unit mean of each author's vectors, in long form ``(author, i, x)``; zero sums give nothing."""
    long = prints.select(F.col(author).alias("author"), F.posexplode(vector).alias("i", "x"))
    summed = long.groupBy("author", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    norm = summed.groupBy("author").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    return summed.join(norm, "author").select("author", "i", (F.col("x") / F.col("norm")).alias("x"))


_CENT = "s AS (SELECT label AS author, i, sum(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), n AS (SELECT author, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1), c AS (SELECT author, i, x / norm AS x FROM s JOIN n USING (author))"


@VOICES.query("centroids", f"WITH {_CENT} SELECT author, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM c")
def q_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids(table(spark, d, "embeddings"), "label", "embedding").select("author", "i", F.round("x", 6).alias("x"))


def author_scores(c: DataFrame) -> DataFrame:
    """Cosines of all pairs of authors, as an equi-join on the component (no product of whole sides)."""
    a, b = c.select(F.col("author").alias("a"), "i", F.col("x").alias("p")), c.select(F.col("author").alias("b"), "i", F.col("x").alias("q"))
    return a.join(b, "i").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("p") * F.col("q")).alias("score"))


@VOICES.query("similar_voices", f"WITH {_CENT}, p AS (SELECT x.author AS a, y.author AS b, sum(x.x * y.x) AS s FROM c x JOIN c y ON x.i = y.i AND x.author <> y.author GROUP BY 1, 2) SELECT a, b, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS r FROM p) WHERE r <= 8")
def q_similar(spark: SparkSession, d: str) -> DataFrame:
    s = author_scores(centroids(table(spark, d, "embeddings"), "label", "embedding"))
    w = Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("a", "b", F.round("score", 6).alias("score"), "rank")


def item_scores(prints: DataFrame, c: DataFrame) -> DataFrame:
    """Dot products of each item with every author's centroid."""
    arr = c.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))
    # one row an author: broadcast where Spark's own size check allows
    return prints.join(arr).select("vec_id", "label", "author", F.aggregate(F.zip_with("embedding", "v", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x).alias("score"))


@VOICES.query("voice_attribution", f"WITH {_CENT}, t AS (SELECT vec_id, label, author, sum(embedding[i]::DOUBLE * x) AS s FROM embeddings, c GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, author) AS k FROM t) SELECT vec_id, max(author) FILTER (k = 1) AS best, round(max(s) FILTER (k = 1), 6) AS score, round(max(s) FILTER (k = 1) - max(s) FILTER (k = 2), 5) AS margin FROM r GROUP BY 1")
def q_attribution(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    s = item_scores(e, centroids(e, "label", "embedding"))
    w = Window.partitionBy("vec_id").orderBy(F.desc(F.round("score", 9)), "author")
    k = s.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("vec_id")
    first, second = F.max(F.when(F.col("k") == 1, F.col("score"))), F.max(F.when(F.col("k") == 2, F.col("score")))
    return k.agg(F.max(F.when(F.col("k") == 1, F.col("author"))).alias("best"), F.round(first, 6).alias("score"), F.round(first - second, 5).alias("margin"))


@VOICES.query("voice_verify", f"WITH {_CENT}, t AS (SELECT vec_id, label, author, sum(embedding[i]::DOUBLE * x) AS s FROM embeddings, c GROUP BY 1, 2, 3) SELECT vec_id, round(max(s) FILTER (author = label), 6) AS own, round(max(s) FILTER (author <> label), 6) AS rival, max(s) FILTER (author <> label) > max(s) FILTER (author = label) AS disputed FROM t GROUP BY 1")
def q_verify(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    s = item_scores(e, centroids(e, "label", "embedding"))
    own, rival = F.max(F.when(F.col("author") == F.col("label"), F.col("score"))), F.max(F.when(F.col("author") != F.col("label"), F.col("score")))
    return s.groupBy("vec_id").agg(F.round(own, 6).alias("own"), F.round(rival, 6).alias("rival"), (rival > own).alias("disputed"))


@VOICES.query("cameo_windows", f"WITH {_CENT}, t AS (SELECT vec_id, label, author, sum(embedding[i]::DOUBLE * x) AS s FROM embeddings, c GROUP BY 1, 2, 3), g AS (SELECT vec_id // 10 AS item, author, vec_id % 10 AS w FROM t WHERE author <> label AND s >= 0.1), o AS (SELECT *, row_number() OVER (PARTITION BY item, author ORDER BY w) AS r FROM g) SELECT item, author, count(*) AS windows, string_agg(CAST(w * 20 AS VARCHAR), ',' ORDER BY w) FILTER (r <= 6) AS offsets FROM o GROUP BY 1, 2 HAVING count(*) >= 2")
def q_cameos(spark: SparkSession, d: str) -> DataFrame:
    """Guests: authors that at least two windows of an item sound like, with the first six offsets."""
    e = table(spark, d, "embeddings")
    s = item_scores(e, centroids(e, "label", "embedding")).where("author <> label AND score >= 0.1")
    g = s.select(F.expr("vec_id div 10").alias("item"), "author", (F.col("vec_id") % 10).alias("w"))
    at = F.slice(F.array_sort(F.collect_list("w")), 1, 6)
    return g.groupBy("item", "author").agg(F.count("*").alias("windows"), F.array_join(F.transform(at, lambda w: (w * 20).cast("string")), ",").alias("offsets")).where("windows >= 2")


_BITS = "list_reduce(list_prepend(0::BIGINT, list_transform(range({0}, {1}), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - {0}) ELSE 0 END)), lambda a, x: a | x)"


@VOICES.query(
    "acoustic_fingerprint_match",
    f"""WITH b AS (SELECT vec_id, {_BITS.format(1, 33)} AS lo, {_BITS.format(33, 65)} AS hi FROM embeddings),
r AS (SELECT n.vec_id AS needle, b.vec_id, bit_count(xor(n.lo, b.lo)) + bit_count(xor(n.hi, b.hi)) AS d FROM b JOIN b n ON n.vec_id % 50 = 0 AND b.vec_id <> n.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY d, vec_id) AS k FROM r)
SELECT needle, CAST(max(d) FILTER (k = 1) AS INTEGER) AS distance, max(vec_id) FILTER (k = 1) AS found, CAST(coalesce(max(d) FILTER (k = 2), 32) - max(d) FILTER (k = 1) AS INTEGER) AS margin FROM k WHERE k <= 2 GROUP BY 1""",
)
def q_print(spark: SparkSession, d: str) -> DataFrame:
    """The print (all components, two words) with the fewest differing bits for each needle, and how far the runner-up is. Needles: every row whose id is divisible by 50, against all rows in blocks."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest_prints(rows, rows.where("vec_id % 50 = 0"))


def nearest_prints(rows: DataFrame, needles: DataFrame, block: int = 4096) -> DataFrame:
    """``(needle, distance, found, margin)``; needles are read in blocks of bounded size, each is broadcast and meets every row once."""
    import numpy as np
    import pandas as pd

    def bits(vectors: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(v, np.float32) for v in vectors]) > 0
        return np.packbits(np.pad(x, ((0, 0), (0, -x.shape[1] % 64))), axis=1, bitorder="little").view("<u8")

    spark, parts, held = rows.sparkSession, [], []

    def flush() -> None:
        ids, words = np.array([h[0] for h in held]), bits(pd.Series([h[1] for h in held]))
        shared = spark.sparkContext.broadcast((ids, words))
        held.clear()

        def run(batches):
            asked, own = shared.value
            for b in batches:
                have, at = bits(b["embedding"]), b["vec_id"].to_numpy()
                order = np.argsort(at, kind="stable")
                have, at = have[order], at[order]
                for k in range(0, len(asked), 256):
                    apart = np.bitwise_count(own[k : k + 256, None, :] ^ have[None, :, :]).sum(axis=2).astype(np.int32)
                    apart[asked[k : k + 256, None] == at[None, :]] = 1 << 30
                    best = np.argsort(apart, axis=1, kind="stable")[:, :2]
                    d = np.take_along_axis(apart, best, axis=1)
                    out = pd.DataFrame({"needle": np.repeat(asked[k : k + 256], best.shape[1]), "d": d.ravel(), "vec_id": at[best].ravel()})
                    yield out[out.d < 1 << 30]

        parts.append(rows.mapInPandas(run, "needle long, d int, vec_id long"))

    for r in needles.select("vec_id", "embedding").toLocalIterator():
        held.append((r["vec_id"], r["embedding"]))
        if len(held) == block:
            flush()
    if held or not parts:
        if not held:
            return spark.createDataFrame([], "needle long, distance int, found long, margin int")
        flush()
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    two = found.withColumn("k", F.row_number().over(Window.partitionBy("needle").orderBy("d", "vec_id"))).where("k <= 2").groupBy("needle")
    first, second = F.max(F.when(F.col("k") == 1, F.col("d"))), F.max(F.when(F.col("k") == 2, F.col("d")))
    return two.agg(first.alias("distance"), F.max(F.when(F.col("k") == 1, F.col("vec_id"))).alias("found"), (F.coalesce(second, F.lit(32)) - first).alias("margin"))


@VOICES.query("duration_tags", "SELECT event_id, CASE WHEN s = 0 THEN '' WHEN s / 60 < 10 THEN 'Duration: <10' WHEN s / 60 >= 120 THEN 'Duration: 120+' ELSE printf('Duration: %d-%d', (floor(s / 600) * 10)::INT, (floor(s / 600) * 10)::INT + 10) END AS tag FROM (SELECT event_id, floor(value * 100) AS s FROM events)")
def q_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", duration_tag(F.floor(F.col("value") * 100).cast("double")).alias("tag"))


@VOICES.query("pitch_class", "SELECT event_id, CASE WHEN f0 <= 0 OR NOT ok THEN '' WHEN f0 < 135 THEN 'masc' WHEN f0 > 175 THEN 'fem' ELSE '' END AS voice, ok FROM (SELECT event_id, f0, sp <= greatest(40.0, 0.35 * f0) AND sp >= 8 AND f0 >= 69 AND f0 <= 360 AS ok FROM (SELECT event_id, value * 3 AS f0, (event_id % 90)::DOUBLE AS sp FROM events))")
def q_pitch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("value") * 3).alias("f0"), (F.col("event_id") % 90).cast("double").alias("sp")).withColumn("ok", reliable_pitch("f0", "sp"))
    return e.select("event_id", voice_from_pitch("f0", F.col("ok")).alias("voice"), "ok")


@VOICES.query("tone_shape", "SELECT event_id, CASE WHEN beat < 0.3 THEN '' WHEN beat < 4 THEN 'delta' WHEN beat < 8 THEN 'theta' WHEN beat < 13 THEN 'alpha' WHEN beat < 30 THEN 'beta' ELSE 'gamma' END AS band, CASE WHEN tonal AND beat >= 0.5 AND beat <= 40 AND steady THEN 'binaural pair' WHEN tonal AND beat < 0.5 THEN 'single tone' WHEN tonal THEN 'tonal' WHEN pur >= 0.15 THEN 'layered tones' WHEN hi > 0.15 THEN 'broadband' ELSE 'low-frequency wash' END AS shape FROM (SELECT event_id, pur, hi, beat, steady, pur >= 0.35 AND 0.5 + mid > 0.9 AS tonal FROM (SELECT event_id, (event_id % 10) / 10.0::DOUBLE AS pur, (event_id % 7) / 10.0::DOUBLE AS mid, (event_id % 4) / 10.0::DOUBLE AS hi, (event_id % 45)::DOUBLE AS beat, event_id % 2 = 0 AS steady FROM events))")
def q_shape(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    share = lambda n: (i % n) / F.lit(10.0)
    beat = (i % 45).cast("double")
    return table(spark, d, "events").select("event_id", beat_band(beat).alias("band"), tone_shape(share(10), F.lit(0.5), share(7), share(4), beat, i % 2 == 0).alias("shape"))


@VOICES.query("alias_folding", "SELECT event_id, CASE WHEN p > 50 THEN 100 - p ELSE p END AS hz FROM (SELECT event_id, (event_id * 3 % 100)::DOUBLE AS p FROM events)")
def q_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", alias_fold((F.col("event_id") * 3).cast("double"), 100.0).alias("hz"))


@VOICES.query("percentile_stats", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def q_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.round(F.avg("value"), 6).alias("mean"))
