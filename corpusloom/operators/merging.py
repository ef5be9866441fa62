"""Duplicate groups folded into one record each: ranks, survivors, gap-filling, unions and what was generated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE_RE2, stem_of, title_parts, truthy
from corpusloom.operators.dedupe import text_key
from corpusloom.plans.catalogue import Catalogue, table

MERGING = Catalogue()
#: Lists whose values a survivor takes from the whole group.
UNIONS = ("tags", "categories")
#: Fields that name a record: they are the survivor's own.
OWN = ("id", "title")


def _n(x: str) -> Column:
    return F.coalesce(F.size(x), F.lit(0))


def _len(x: str) -> Column:
    return F.coalesce(F.length(x), F.lit(0))


def richness() -> list[Column]:
    """How much a record tells, most telling part first: address, spoilers, description, tags, summary."""
    return [truthy("source_url").cast("int"), F.greatest(_n("spoilers"), F.lit(0)), _len("description"), F.greatest(_n("tags"), F.lit(0)), _len("summary")]


def resolution() -> list[Column]:
    """How good a survivor a record makes: a specific address, its title, series, any address, an unnumbered name, then what it tells."""
    url = F.coalesce("source_url", F.lit(""))
    slashes = F.length(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "[^/]", ""))
    plain = ~stem_of("path").rlike("-[0-9]+$")
    return [((url != "") & (slashes > 2)).cast("int"), *title_parts(F.coalesce("title", F.lit(""))), truthy("series").cast("int"), (url != "").cast("int"), plain.cast("int"), F.greatest(_n("spoilers"), F.lit(0)), F.greatest(_n("tags"), F.lit(0)), _len("description")]


def _best_first(ranks: Sequence[Column]) -> list[Column]:
    return [(-r.cast("long")).alias(f"r{i}") for i, r in enumerate(ranks)] + [F.col("path").alias("path")]


def survivors(items: DataFrame, group: str = "group", fold: bool = False, chosen: Column | None = None) -> DataFrame:
    """``(group, survivor, n)`` for groups of two or more: the ``path`` of the record that stays.

    It is the first ``chosen`` by path, else the best by ``resolution``. With
    ``fold`` the first whose name has no number comes before both, and
    ``richness`` ranks. Rows without group stay out. Paths are unique.
    """
    ranks = _best_first(richness() if fold else resolution())
    picked = F.lit(False) if chosen is None else F.coalesce(chosen, F.lit(False))
    first = lambda flag, name: [(~flag).alias(name), F.when(flag, F.col("path")).otherwise("").alias(f"{name}_path")]
    plain = ~stem_of("path").rlike("-[0-9]+$") if fold else F.lit(False)
    order = F.struct(*first(plain, "plain"), *first(picked, "picked"), *ranks)
    g = items.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by("path", order).alias("survivor"), F.count("*").alias("n"))
    return g.where("n >= 2")


def lineage(items: DataFrame, kept: DataFrame, group: str = "group") -> DataFrame:
    """``(group, survivor, path, id)`` of every record that a survivor absorbs: a row each, so that no list grows with a group."""
    return items.join(kept.select(group, "survivor"), group).where("path <> survivor").select(group, "survivor", "path", "id")


def merge_groups(items: DataFrame, kept: DataFrame, group: str = "group", fold: bool = False, fields: Sequence[str] = ()) -> DataFrame:
    """One merged record for each row of ``kept`` (from ``survivors``).

    ``items``: ``path``, ``id``, ``title``, ``series``, ``source_url``,
    ``description``, ``summary`` and the further ``fields`` (texts), ``tags``,
    ``categories``, ``spoilers``, ``generated`` (lists of texts),
    ``provenance`` (map of texts). Empty fields are filled from the others,
    best first; ``id`` and ``title`` (without ``fold`` ``series`` and
    ``source_url`` too) are the survivor's. With ``fold`` the richest record
    comes first, else the survivor. Without ``fold`` the longest list of
    spoilers stays. ``also_titled``: the others' titles. A field counts as
    generated if all records that gave its value say so. Lists keep the order
    in which records are merged. All parts are aggregates with partial sums;
    what one task holds of a group are its distinct values.
    """
    texts = ["source_url", "series", "description", "summary", *fields]
    rows = items.join(kept.select(group, "survivor"), group)
    is_kept = F.col("path") == F.col("survivor")
    place = F.struct(*([] if fold else [(~is_kept).alias("other")]), *_best_first(richness() if fold else resolution()))
    told = F.struct((~is_kept).alias("other"), *_best_first(richness()))
    rows = rows.withColumns({"__place": place, "__told": told, "__kept": is_kept})
    filled = lambda f: F.coalesce(F.min_by(f, F.when(truthy(f), F.col("__place"))), F.min_by(f, "__place"))
    mine = lambda f: F.max(F.when(F.col("__kept") & truthy(f), F.col(f)))
    spoilers = F.min_by("spoilers", F.when(_n("spoilers") > 0, F.col("__place") if fold else F.struct((-_n("spoilers")).alias("n"), F.col("__place").alias("p"))))
    base = rows.groupBy(group).agg(
        F.first("survivor").alias("path"),
        *(((F.coalesce(mine(f), F.min_by(f, "__place")) if fold else mine(f)).alias(f)) for f in OWN),
        *((mine(f) if not fold and f in ("series", "source_url") else filled(f)).alias(f) for f in texts),
        spoilers.alias("spoilers"),
        F.min_by("title", "__place").alias("__base_title"),
    )
    named = lambda f: F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(f).alias("field"), v.alias("value"), i.alias("pos")))
    titles = F.array(F.struct(F.lit("also_titled").alias("field"), F.trim("title").alias("value"), F.lit(0).alias("pos")))
    values = rows.select(group, "__place", F.explode(F.concat(*(named(f) for f in UNIONS), titles)).alias("v")).where("v.value <> ''")
    first = values.groupBy(group, "v.field", "v.value").agg(F.min(F.struct("__place", "v.pos")).alias("at"))
    lists = first.groupBy(group).agg(*(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("at", "value")))).alias(f"__{f}") for f in (*UNIONS, "also_titled")))
    facts = _facts(rows, group)
    out = base.join(lists, group, "left").join(facts, group, "left")
    out = out.withColumns({f: F.coalesce(F.col(f"__{f}.value"), F.array().cast("array<string>")) for f in (*UNIONS, "also_titled")})
    out = out.withColumn("also_titled", F.array_remove("also_titled", F.coalesce(F.trim("__base_title"), F.lit(""))))
    marks = _generated(rows, out, group, [*OWN, *texts, "spoilers"])
    keep = [group, "path", *OWN, *texts, "spoilers", *UNIONS, "also_titled", "provenance"]
    return out.select(*keep).join(marks, group, "left")


def _facts(rows: DataFrame, group: str) -> DataFrame:
    """Provenance of each group: the survivor's, filled from the others; where a recording came from is the survivor's alone."""
    pairs = rows.select(group, "__told", "__kept", F.explode("provenance").alias("k", "v")).where("v <> '' AND (__kept OR k NOT IN ('source_key', 'fingerprint'))")
    best = pairs.groupBy(group, "k").agg(F.min_by("v", "__told").alias("v"))
    return best.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("provenance"))


def _generated(rows: DataFrame, out: DataFrame, group: str, alone: Sequence[str]) -> DataFrame:
    """Fields that every record which gave the merged value lists as generated."""
    final = out.select(group, *(F.col(f).alias(f"__m_{f}") for f in alone))
    j = rows.join(final, group)
    marked = []
    for f in (*alone, *UNIONS):
        gave = _n(f) > 0 if f in UNIONS else F.col(f).eqNullSafe(F.col(f"__m_{f}"))
        said = F.coalesce(F.array_contains("generated", f), F.lit(False))
        marked.append(F.when(F.coalesce(F.bool_and(F.when(gave, said)), F.lit(False)), F.lit(f)))
    return j.groupBy(group).agg(F.array_sort(F.array_compact(F.array(*marked))).alias("generated"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records in groups of equal texts."""
    id_, empty = F.col("doc_id"), F.array().cast("array<string>")
    about = F.when(id_ % 3 == 0, "").otherwise(F.concat(F.lit("about "), id_.cast("string")))
    return table(spark, d, "documents").select(
        text_key().alias("group"), F.format_string("%012d", id_).alias("path"), id_.cast("string").alias("id"), F.col("lang").alias("title"), F.lit("").alias("series"), F.lit("").alias("source_url"),
        about.alias("description"), F.lit("").alias("summary"), F.array("lang", "source").alias("tags"), empty.alias("categories"), empty.alias("spoilers"),
        F.when(id_ % 2 == 0, F.array(F.lit("description"))).otherwise(empty).alias("generated"), F.create_map(F.lit("from"), "source").alias("provenance"),
    )


_GROUP = "md5(lower(trim(regexp_replace(text, '{space}', ' ', 'g'))))"


@MERGING.query(
    "duplicate_fold",
    f"""WITH t AS (SELECT {_GROUP.format(space=SPACE_RE2)} AS key, printf('%012d', doc_id) AS path, doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'about ' || doc_id END AS about FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(lang) DESC, length(about) DESC, path) AS place, count(*) OVER (PARTITION BY key) AS n FROM t),
v AS (SELECT key, tag, min(place * 2 + pos) AS first FROM (SELECT key, place, unnest([lang, source]) AS tag, unnest([0, 1]) AS pos FROM r WHERE n >= 2) GROUP BY 1, 2),
g AS (SELECT key, string_agg(tag, '|' ORDER BY first) AS tags FROM v GROUP BY 1),
b AS (SELECT key, max(doc_id) FILTER (place = 1) AS survivor, coalesce(arg_min(about, place) FILTER (about <> ''), '') AS description, max(source) FILTER (place = 1) AS origin FROM r WHERE n >= 2 GROUP BY 1),
m AS (SELECT r.key, bool_and(doc_id % 2 = 0) FILTER (r.about = b.description) AS made FROM r JOIN b USING (key) GROUP BY 1)
SELECT key, survivor, description, tags, origin, coalesce(made, false) AS description_made FROM b JOIN g USING (key) LEFT JOIN m USING (key)""",
)
def q_fold(spark: SparkSession, d: str) -> DataFrame:
    """The merged record of each group of equal documents."""
    docs = _documents(spark, d)
    out = merge_groups(docs, survivors(docs))
    return out.select(F.col("group").alias("key"), F.col("id").cast("long").alias("survivor"), F.coalesce("description", F.lit("")).alias("description"), F.array_join("tags", "|").alias("tags"), F.col("provenance")["from"].alias("origin"), F.array_contains("generated", "description").alias("description_made"))
