"""Duplicate groups, survivors and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE_RE2, base_of, casefold, squeeze, stem_of
from corpusloom.plans.catalogue import Catalogue, table

DEDUPE = Catalogue()
_KEY = f"md5(lower(trim(regexp_replace(text, '{SPACE_RE2}', ' ', 'g'))))"


def text_key(text: str = "text") -> F.Column:
    return F.md5(F.lower(squeeze(text)))


def duplicate_groups(items: DataFrame, key: F.Column, author: str, base: F.Column) -> DataFrame:
    """Groups of two or more by ``key`` with their kind: cross-creator, same-title or same-creator."""
    g = items.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.count_distinct(F.col(author)).alias("authors"), F.count_distinct(base).alias("bases"))
    kind = F.when(F.col("authors") > 1, "cross-creator").when(F.col("bases") == 1, "same-title").otherwise("same-creator")
    return g.where("n >= 2").select("key", "n", "authors", kind.alias("kind"))


def ranked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labels, grouped by text key, as aggregates over the survivor ranking."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rank = F.struct(F.coalesce("quality", F.lit(-1)).alias("q"), F.col("n_chars"), (-F.col("doc_id")).alias("o"))
    return docs.withColumns({"key": text_key(), "rank": rank})


@DEDUPE.query("duplicate_groups", f"SELECT key, n, authors, CASE WHEN authors > 1 THEN 'cross-creator' WHEN bases = 1 THEN 'same-title' ELSE 'same-creator' END AS kind FROM (SELECT {_KEY} AS key, count(*) AS n, count(DISTINCT source) AS authors, count(DISTINCT lang) AS bases FROM documents GROUP BY 1) WHERE n >= 2")
def q_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(table(spark, d, "documents"), text_key(), "source", F.col("lang"))


@DEDUPE.query("duplicate_survivors", f"SELECT key, arg_max(doc_id, {{'q': coalesce(quality, -1), 'n': n_chars, 'o': -doc_id}}) AS survivor, count(*) AS n FROM (SELECT d.*, l.quality, {_KEY} AS key FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY key HAVING count(*) >= 2")
def q_survivors(spark: SparkSession, d: str) -> DataFrame:
    return ranked_groups(spark, d).groupBy("key").agg(F.max_by("doc_id", "rank").alias("survivor"), F.count("*").alias("n")).where("n >= 2")


@DEDUPE.query(
    "duplicate_merge",
    f"""SELECT key, arg_max(doc_id, rk) AS survivor, coalesce(arg_max(quality, rk) FILTER (quality IS NOT NULL), -1) AS quality,
    array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
    (SELECT string_agg(x, ',' ORDER BY x::BIGINT) FROM unnest(list_filter(list(CAST(doc_id AS VARCHAR)), lambda y: y <> CAST(arg_max(doc_id, rk) AS VARCHAR))) t(x)) AS absorbed
    FROM (SELECT d.*, l.quality, {_KEY} AS key, {{'q': coalesce(l.quality, -1), 'n': n_chars, 'o': -d.doc_id}} AS rk FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY key HAVING count(*) >= 2""",
)
def q_merge(spark: SparkSession, d: str) -> DataFrame:
    g = ranked_groups(spark, d).groupBy("key").agg(
        F.max_by("doc_id", "rank").alias("survivor"),
        F.max_by("quality", F.when(F.col("quality").isNotNull(), F.col("rank"))).alias("quality"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.array_sort(F.collect_list("doc_id")).alias("ids"),
        F.count("*").alias("n"),
    )
    absorbed = F.array_join(F.array_remove("ids", F.col("survivor")).cast("array<string>"), ",")
    return g.where("n >= 2").select("key", "survivor", F.coalesce("quality", F.lit(-1)).alias("quality"), "sources", absorbed.alias("absorbed"))


@DEDUPE.query(
    "merge_lineage_flags",
    f"""SELECT key, bool_and(quality = 1) FILTER (quality IS NOT NULL) AS all_marked, bool_or(quality IS NOT NULL) AS contributed
    FROM (SELECT d.doc_id, l.quality, {_KEY} AS key FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY key HAVING count(*) >= 2""",
)
def q_lineage(spark: SparkSession, d: str) -> DataFrame:
    g = ranked_groups(spark, d).groupBy("key").agg(
        F.bool_and(F.col("quality") == 1).alias("all_marked"),
        F.bool_or(F.col("quality").isNotNull()).alias("contributed"),
        F.count("*").alias("n"),
    )
    return g.where("n >= 2").drop("n")


@DEDUPE.query("transcript_key", f"SELECT doc_id, {_KEY} AS text_key FROM documents")
def q_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text_key().alias("text_key"))


@DEDUPE.query("blake_keys")
def q_blake(spark: SparkSession, d: str) -> DataFrame:
    """Content keys: BLAKE2b-128 of case-folded, single-spaced text (no built-in digest of that kind)."""

    def digest(texts: pd.Series) -> pd.Series:
        import hashlib

        return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest())

    return table(spark, d, "documents").select("doc_id", F.pandas_udf(digest, "string")(casefold(squeeze("text"))).alias("content_key"))


def ranked_in_groups(rows: DataFrame, group: str, coarse: list[F.Column], fine: list[F.Column]) -> DataFrame:
    """``rows`` with ``rank`` in their group by ``coarse`` then ``fine``. Rows are numbered inside a (group, coarse) bucket and shifted by the buckets before it, so no task sorts a whole group."""
    keys = [f"__k{i}" for i in range(len(coarse))]
    spread = rows.withColumns(dict(zip(keys, coarse, strict=True)))
    sizes = spread.groupBy(group, *keys).agg(F.count("*").alias("__n"))
    shift = sizes.select(F.col(group).alias("__g"), *(F.col(k).alias(f"{k}s") for k in keys), (F.sum("__n").over(Window.partitionBy(group).orderBy(*keys)) - F.col("__n")).alias("__shift"))
    same = F.col(group).eqNullSafe(F.col("__g"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}s"))
    numbered = spread.withColumn("__at", F.row_number().over(Window.partitionBy(group, *keys).orderBy(*fine)))
    return numbered.join(shift, same).withColumn("rank", (F.col("__at") + F.col("__shift")).cast("int")).drop("__at", "__shift", "__g", *keys, *(f"{k}s" for k in keys))


@DEDUPE.query(
    "richness_rank",
    "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, 0) DESC, coalesce(toxic, 0) DESC, length(text) DESC, doc_id) AS INTEGER) AS rank FROM documents LEFT JOIN labels USING (doc_id)",
)
def q_richness(spark: SparkSession, d: str) -> DataFrame:
    """The rank of every document in its source."""
    j = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")).join(table(spark, d, "labels"), "doc_id", "left")
    coarse = [-F.coalesce("quality", F.lit(0)), -F.coalesce("toxic", F.lit(0)), -F.floor(F.col("n") / 64)]
    return ranked_in_groups(j, "source", coarse, [F.desc("n"), F.col("doc_id")]).select("doc_id", "source", "rank")


@DEDUPE.query("stem_bases", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', ''), '-[0-9]+$', '') AS base FROM pages")
def q_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", stem_of("url").alias("stem"), base_of(stem_of("url")).alias("base"))
