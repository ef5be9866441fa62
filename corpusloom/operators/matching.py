"""Source and item matching, orphans, provenance, exports and other audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import first_line, portable, prose, slug, squash, strip_controls, squeeze, tidy_case, title_parts, unrun, machine_made, not_a_title, SPACE_RE2
from corpusloom.functions.titles import tidy_title
from corpusloom.plans.catalogue import Catalogue, table

MATCHING = Catalogue()


def match_sources(sources: DataFrame, items: DataFrame, merged: DataFrame) -> DataFrame:
    """``sources(author, key, print, stem)`` to ``items(item, author, key, print)``: by key, then by fingerprint, else new.

    The first item by name wins a key. Sources whose key an item has absorbed
    (``merged(key)``) are left out.
    """
    by_key = items.groupBy("author", "key").agg(F.min("item").alias("k_item"))
    by_print = items.where("print <> ''").groupBy("author", "print").agg(F.min("item").alias("p_item"))
    s = sources.join(merged, "key", "left_anti").join(by_key, ["author", "key"], "left").join(by_print, ["author", "print"], "left")
    return s.select("author", "key", F.coalesce("k_item", "p_item", "stem").alias("item"), F.when(F.col("k_item").isNotNull(), "key").when(F.col("p_item").isNotNull(), "fingerprint").otherwise("new").alias("how"))


@MATCHING.query(
    "source_item_match",
    """WITH items AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS item, l_suppkey % 10 AS author, CAST(l_partkey AS VARCHAR) AS key, l_shipmode AS print FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey % 50 AS VARCHAR) ELSE '' END AS l_shipmode FROM lineitem)),
src AS (SELECT p_partkey % 10 AS author, CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS VARCHAR) AS print, p_name AS stem FROM part),
k AS (SELECT author, key, min(item) AS k_item FROM items GROUP BY 1, 2), p AS (SELECT author, print, min(item) AS p_item FROM items WHERE print <> '' GROUP BY 1, 2)
SELECT author, key, coalesce(k_item, p_item, stem) AS item, CASE WHEN k_item IS NOT NULL THEN 'key' WHEN p_item IS NOT NULL THEN 'fingerprint' ELSE 'new' END AS how
FROM src ANTI JOIN (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'P') m USING (key) LEFT JOIN k USING (author, key) LEFT JOIN p USING (author, print)""",
)
def q_match(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    items = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("item"), (F.col("l_suppkey") % 10).alias("author"), F.col("l_partkey").cast("string").alias("key"), F.when(F.col("l_partkey") % 3 == 0, (F.col("l_partkey") % 50).cast("string")).otherwise("").alias("print"))
    src = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("author"), F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("string").alias("print"), F.col("p_name").alias("stem"))
    merged = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("key")).distinct()
    return match_sources(src, items, merged)


@MATCHING.query(
    "orphans",
    """SELECT 'supplier without items' AS kind, CAST(s_suppkey AS BIGINT) AS id FROM supplier ANTI JOIN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') l ON l_suppkey = s_suppkey
UNION ALL SELECT 'item without source', p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') l ON l_partkey = p_partkey
UNION ALL SELECT 'author without items', c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT 'transcript without item', doc_id FROM documents ANTI JOIN labels USING (doc_id)""",
)
def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Four anti-joins: what nothing refers to any more."""
    t = lambda n: table(spark, d, n)

    def lost(kind: str, left: DataFrame, key: str, right: DataFrame) -> DataFrame:
        return left.select(F.col(key).cast("long").alias("id")).join(right.select(F.col(right.columns[0]).cast("long").alias("id")), "id", "left_anti").select(F.lit(kind).alias("kind"), "id")

    return (
        lost("supplier without items", t("supplier"), "s_suppkey", t("lineitem").where("l_returnflag = 'R'").select("l_suppkey"))
        .unionByName(lost("item without source", t("part"), "p_partkey", t("lineitem").where("l_returnflag = 'A'").select("l_partkey")))
        .unionByName(lost("author without items", t("customer"), "c_custkey", t("orders").select("o_custkey")))
        .unionByName(lost("transcript without item", t("documents"), "doc_id", t("labels").select("doc_id")))
    )


@MATCHING.query(
    "infer_generated",
    "SELECT d.doc_id, concat_ws(',', CASE WHEN lang <> 'en' THEN 'description' END, CASE WHEN l.doc_id IS NULL THEN 'summary' END, CASE WHEN n_chars > 2000 THEN 'tags' END) AS generated FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def q_generated(spark: SparkSession, d: str) -> DataFrame:
    """Names of the fields that an item has and its source lacks."""
    j = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    fields = F.array_compact(F.array(F.when(F.col("lang") != "en", "description"), F.when(F.col("has").isNull(), "summary"), F.when(F.col("n_chars") > 2000, "tags")))
    return j.select("doc_id", F.array_join(fields, ",").alias("generated"))


@MATCHING.query("export_projection", "SELECT source, lang, doc_id, CASE WHEN n_chars > 1000 THEN n_chars ELSE 0 END AS duration, array_to_string(list_filter(string_split(lang || ',' || source || ',added', ','), lambda x: x <> 'added'), ',') AS tags FROM documents")
def q_export(spark: SparkSession, d: str) -> DataFrame:
    """What is published of an item: without generated fields and added tags."""
    tags = F.array_except(F.array("lang", "source", F.lit("added")), F.array(F.lit("added")))
    return table(spark, d, "documents").select("source", "lang", "doc_id", F.when(F.col("n_chars") > 1000, F.col("n_chars")).otherwise(0).alias("duration"), F.array_join(tags, ",").alias("tags"))


@MATCHING.query("portable_paths", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS path, starts_with(url, 'https://') AS changed FROM pages")
def q_paths(spark: SparkSession, d: str) -> DataFrame:
    p = portable("url", "https://")
    return table(spark, d, "pages").select("page_id", p.alias("path"), (p != F.col("url")).alias("changed"))


@MATCHING.query("needs_fields", "SELECT d.doc_id, concat_ws(',', CASE WHEN l.quality IS NULL THEN 'quality' END, CASE WHEN coalesce(toxic, 0) = 0 THEN 'review' END, CASE WHEN n_chars = 0 THEN 'text' END) AS needs, l.quality IS NOT NULL AND coalesce(toxic, 0) <> 0 AS complete FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_needs(spark: SparkSession, d: str) -> DataFrame:
    """Curated fields that are still empty."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    toxic = F.coalesce("toxic", F.lit(0))
    needs = F.array_compact(F.array(F.when(F.col("quality").isNull(), "quality"), F.when(toxic == 0, "review"), F.when(F.col("n_chars") == 0, "text")))
    return j.select("doc_id", F.array_join(needs, ",").alias("needs"), (F.col("quality").isNotNull() & (toxic != 0)).alias("complete"))


@MATCHING.query(
    "author_body_of_work",
    """WITH t AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), f AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS titles FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20 GROUP BY 1)
SELECT source, items, top_tag, titles FROM (SELECT source, sum(n)::BIGINT AS items, arg_max(lang, {'n': n, 'l': -ascii(lang) * 1000 - ascii(lang[2])}) AS top_tag FROM t GROUP BY 1) JOIN f USING (source)""",
)
def q_work(spark: SparkSession, d: str) -> DataFrame:
    """Items of an author, their commonest tag (ties by name) and first twenty titles."""
    docs = table(spark, d, "documents").select("source", "lang", "doc_id")
    tags = docs.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("items"), F.min_by("lang", F.struct((-F.col("n")).alias("m"), "lang")).alias("top_tag"))
    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("r <= 20")
    return tags.join(first.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("titles")), "source").select("source", "items", "top_tag", "titles")


@MATCHING.query("synopsis_stale", "SELECT source, now, was, abs(now - was) >= greatest(5, was // 10) AS stale FROM (SELECT source, count(*) AS now, count(*) FILTER (doc_id % 2 = 0) AS was FROM documents GROUP BY 1)")
def q_stale(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("now"), F.count_if(F.col("doc_id") % 2 == 0).alias("was"))
    return g.withColumn("stale", F.abs(F.col("now") - F.col("was")) >= F.greatest(F.lit(5), F.expr("was div 10")))


@MATCHING.query("html_prose", f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{SPACE_RE2}', ' ', 'g')) AS prose FROM pages")
def q_prose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", prose("html").alias("prose"))


@MATCHING.query("strip_controls", r"SELECT doc_id, regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), '[\x00-\x1f\x7f\x{80}-\x{9f}]', '', 'g') AS clean FROM documents")
def q_controls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", strip_controls("text").alias("clean"))


@MATCHING.query("slug_title", r"SELECT p_partkey, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(p_name, '[''`]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'untitled') AS slug FROM part")
def q_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", slug("p_name").alias("slug"))


@MATCHING.query("title_quality_rank", r"SELECT p_brand, arg_max(p_partkey, {'a': (NOT regexp_matches(p_name, '(?i)mixdown|\.com\b'))::INT, 'b': (NOT regexp_matches(p_name, '(?i)^[a-z0-9]{10,}$'))::INT, 'c': contains(p_name, ' ')::INT, 'd': (NOT contains(p_name, '_'))::INT, 'e': length(p_name), 'f': -p_partkey}) AS best FROM part GROUP BY 1")
def q_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(*(p.alias(n) for p, n in zip(title_parts("p_name"), "abcde", strict=True)), (-F.col("p_partkey")).alias("f"))).alias("best"))


@MATCHING.query("tidy_title", f"SELECT doc_id, list_reduce(list_transform(string_split(trim(regexp_replace(split_part(text, chr(10), 1), '{SPACE_RE2}', ' ', 'g')), ' '), lambda w, i: CASE WHEN i > 1 AND i < len(string_split(trim(regexp_replace(split_part(text, chr(10), 1), '{SPACE_RE2}', ' ', 'g')), ' ')) AND list_contains(['a','an','and','as','at','but','by','for','from','in','into','nor','of','on','onto','or','over','the','to','up','with'], lower(w)) THEN lower(w) ELSE w END), lambda a, b: a || ' ' || b) AS title FROM documents")
def q_tidy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tidy_case(first_line("text")).alias("title"))


@MATCHING.query(
    "title_cleanup",
    "SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS script_by, CASE WHEN p_partkey % 2 = 1 THEN '720p' ELSE '' END AS variant FROM part",
)
def q_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts come back out of titles with codes, credits, lengths and traces of encoding around them."""
    credited = F.concat(F.lit("[F4M] "), "p_name", F.lit(" (script by u/"), "p_type", F.lit(") [12:30]"))
    titled = F.when(F.col("p_partkey") % 2 == 0, credited).otherwise(F.concat(F.lit("example.net: "), "p_name", F.lit("_720p.mp3")))
    return table(spark, d, "part").select("p_partkey", tidy_title(titled).alias("t")).select("p_partkey", "t.title", "t.script_by", "t.variant")


@MATCHING.query("title_flags")
def q_flags(spark: SparkSession, d: str) -> DataFrame:
    """Machine-made and run-together titles of page addresses, and their split form (look-around has no RE2 twin)."""
    name = F.regexp_extract("url", "([^/?#]*)[?#]?[^/]*$", 1)
    return table(spark, d, "pages").select("page_id", machine_made(name).alias("machine"), not_a_title(name).alias("no_title"), unrun(name).alias("title"))


@MATCHING.query(
    "incremental_diff",
    "WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'removed' WHEN old.h <> new.h THEN 'changed' END AS change FROM old FULL JOIN new ON old.doc_id = new.doc_id WHERE old.h IS DISTINCT FROM new.h",
)
def q_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a second scan has to parse again: added, changed and removed documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("was"))
    new = docs.where("doc_id % 5 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"))
    return changes(old, new)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old(doc_id, was)`` against ``new(doc_id, now)``; equal rows are left out."""
    j = old.join(new, "doc_id", "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return j.select("doc_id", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


@MATCHING.query("source_report", "SELECT source, count(*) AS sources, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) - count(DISTINCT text) AS repeated FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def q_report(spark: SparkSession, d: str) -> DataFrame:
    """Sources by author, those without audio, repeated records."""
    j = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    g = j.groupBy("source").agg(F.count("*").alias("sources"), F.count_if(F.col("has").isNull()).alias("missing"), F.count_distinct(F.md5("text")).alias("kinds"))
    return g.select("source", "sources", "missing", (F.col("sources") - F.col("kinds")).alias("repeated"))


@MATCHING.query("unique_stems")
def q_stems(spark: SparkSession, d: str) -> DataFrame:
    return unique_stems(table(spark, d, "part").select(F.col("p_brand").alias("author"), F.col("p_partkey").alias("pos"), slug(squeeze("p_name")).alias("stem")))


def unique_stems(wanted: DataFrame, most: int = 1000) -> DataFrame:
    """``(author, pos, stem, unique)``: names in order of ``pos``; taken ones get -0, -1, ... (stateful within an author), up to ``most``."""
    import pandas as pd

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, following, out = set(), {}, []
        for stem in pdf.sort_values("pos").stem:
            got, n = stem, following.get(stem, 0)  # all lower numbers are taken
            while got in taken:
                if n > most:
                    raise ValueError(f"no free name for {stem}")
                got, n = f"{stem}-{n}", n + 1
            following[stem] = n
            taken.add(got)
            out.append(got)
        return pdf.sort_values("pos").assign(unique=out)

    return wanted.groupBy("author").applyInPandas(name, "author string, pos long, stem string, unique string")


@MATCHING.query("squash_titles", "SELECT page_id, trim(regexp_replace(lower(regexp_replace(url, '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9_]+', ' ', 'g')) AS squashed FROM pages WHERE NOT regexp_matches(url, '[^\\x00-\\x7f]')")
def q_squash(spark: SparkSession, d: str) -> DataFrame:
    """Comparison form of ASCII urls."""
    return table(spark, d, "pages").where(~F.col("url").rlike(r"[^\x00-\x7f]")).select("page_id", squash("url").alias("squashed"))
