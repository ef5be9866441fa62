"""Controlled vocabularies: spellings, resolution, tag counts, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE_RE2, fold, loose_tag, split_tag, word_fold
from corpusloom.functions.titles import NOT_A_TAG, proposal_forms
from corpusloom.plans.catalogue import Catalogue, table

VOCABULARY = Catalogue()
_FOLD = "regexp_replace(lower(replace(replace({}, 'ß', 'ss'), 'ẞ', 'ss')), '[^a-z0-9]+', '', 'g')"


def spelling_index(names: DataFrame) -> DataFrame:
    """``(folded, canonical)``: full names, and bare values that one name alone claims; full names win.

    ``names``: one column ``full``.
    """
    full = names.select(fold("full").alias("folded"), F.col("full").alias("canonical"), F.lit(0).alias("pri"))
    bare = names.select(fold(split_tag("full")[1]).alias("folded"), "full").groupBy("folded").agg(F.min("full").alias("canonical"), F.count_distinct("full").alias("n")).where("n = 1")
    both = full.unionByName(bare.select("folded", "canonical", F.lit(1).alias("pri")))
    return both.groupBy("folded").agg(F.min(F.struct("pri", "canonical")).getField("canonical").alias("canonical"))


def resolve(tags: DataFrame, mapping: DataFrame, spelling: DataFrame) -> DataFrame:
    """``tags(id, tag)`` with ``resolved`` and ``how``: exact mapping row, bare-word row, registry spelling.

    ``mapping(tag, verdict, to)`` has a row per tag. A row that names no
    registered tag answers nothing. Both dimensions are vocabularies; Spark
    broadcasts them where their size allows.
    """
    prefix, value = split_tag("raw")
    t = tags.withColumn("raw", F.trim("tag")).withColumns({"prefix": prefix, "value": value})
    s = spelling
    t = t.join(s.select(F.col("folded").alias("f0"), F.col("canonical").alias("known")), fold("raw") == F.col("f0"), "left").drop("f0")
    t = t.join(s.select(F.col("folded").alias("f1"), F.col("canonical").alias("full_name")), fold(F.concat_ws(": ", "prefix", "value")) == F.col("f1"), "left").drop("f1")
    t = t.join(s.select(F.col("folded").alias("f2"), F.col("canonical").alias("bare_name")), fold("value") == F.col("f2"), "left").drop("f2")
    rows = mapping.join(s.select(F.col("folded").alias("f3"), F.col("canonical").alias("target")), fold("to") == F.col("f3"), "left").select("tag", F.lower("verdict").alias("verdict"), "target")
    t = t.join(rows.select(F.col("tag").alias("m0"), F.col("verdict").alias("v0"), F.col("target").alias("t0")), F.col("raw") == F.col("m0"), "left")
    t = t.join(rows.select(F.col("tag").alias("m1"), F.col("verdict").alias("v1"), F.col("target").alias("t1")), F.col("value") == F.col("m1"), "left")
    verdict = F.when(F.col("m0").isNotNull(), F.col("v0")).when(F.col("known").isNull(), F.col("v1"))
    target = F.when(F.col("m0").isNotNull(), F.col("t0")).when(F.col("known").isNull(), F.col("t1"))
    name = F.coalesce(F.when(F.col("prefix") != "", F.col("full_name")), F.col("bare_name"))
    dropped = (F.col("raw") == "") | F.coalesce(verdict == "drop", F.lit(False))
    return t.select(
        "id",
        "tag",
        F.when(dropped, "").otherwise(F.coalesce(target, name, F.lit(""))).alias("resolved"),
        F.when(dropped, "dropped").when(target.isNotNull(), "mapped").when(name.isNotNull(), "registry").otherwise("unresolved").alias("how"),
    )


def rewrite(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(from, to)`` to ``items(id, tag)`` by folded spelling; an empty ``to`` removes."""
    ch = changes.select(fold("from").alias("k"), F.col("to"))
    out = items.join(ch, fold("tag") == F.col("k"), "left").withColumn("tag", F.when(F.col("k").isNotNull(), F.col("to")).otherwise(F.col("tag")))
    return out.where("tag <> ''").select("id", "tag").distinct()


def _names(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "part").select(F.concat(F.lit("Kind: "), F.col("p_type")).alias("full"))
    return types.unionAll(table(spark, d, "nation").select(F.concat(F.lit("Place: "), F.col("n_name")))).unionAll(table(spark, d, "region").select(F.concat(F.lit("Place: "), F.col("r_name")))).distinct()


_NAMES = "names AS (SELECT DISTINCT full_name FROM (SELECT 'Kind: ' || p_type AS full_name FROM part UNION ALL SELECT 'Place: ' || n_name FROM nation UNION ALL SELECT 'Place: ' || r_name FROM region))"
_F = _FOLD.format("full_name")
_FV = _FOLD.format("trim(regexp_replace(full_name, '^[^:]*:', ''))")
_SPELL = f"""{_NAMES}, alls AS (SELECT {_F} AS folded, full_name AS canonical, 0 AS pri FROM names
UNION ALL SELECT {_FV}, min(full_name), 1 FROM names GROUP BY 1 HAVING count(DISTINCT full_name) = 1),
spelling AS (SELECT folded, arg_min(canonical, {{'p': pri, 'c': canonical}}) AS canonical FROM alls GROUP BY folded)"""


@VOCABULARY.query("spelling_index", f"WITH {_SPELL} SELECT * FROM spelling")
def q_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling_index(_names(spark, d))


_MAP = [("PROMO", "map", "Place: ASIA"), ("STEEL", "drop", ""), ("Kind: SMALL", "map", "Nowhere: none"), ("ECONOMY", "map", "FRANCE")]


@VOCABULARY.query(
    "tag_resolve",
    f"""WITH {_SPELL}, mapping(tag, verdict, target_name) AS (VALUES ('PROMO', 'map', 'Place: ASIA'), ('STEEL', 'drop', ''), ('Kind: SMALL', 'map', 'Nowhere: none'), ('ECONOMY', 'map', 'FRANCE')),
rws AS (SELECT tag, verdict, canonical AS target FROM mapping LEFT JOIN spelling ON folded = {_FOLD.format('target_name')}),
t AS (SELECT p_partkey AS id, unnest([split_part(p_type, ' ', 1), 'Kind: ' || p_type, p_name]) AS tag FROM part),
u AS (SELECT id, tag, trim(tag) AS raw, CASE WHEN contains(tag, ':') THEN trim(split_part(tag, ':', 1)) ELSE '' END AS prefix, CASE WHEN contains(tag, ':') THEN trim(regexp_replace(tag, '^[^:]*:', '')) ELSE trim(tag) END AS value FROM t),
v AS (SELECT u.*, s0.canonical AS known, s1.canonical AS full_n, s2.canonical AS bare_n, m0.tag IS NOT NULL AS has0, m0.verdict AS v0, m0.target AS t0, m1.verdict AS v1, m1.target AS t1 FROM u
  LEFT JOIN spelling s0 ON s0.folded = {_FOLD.format('raw')} LEFT JOIN spelling s1 ON s1.folded = {_FOLD.format("prefix || ': ' || value")} LEFT JOIN spelling s2 ON s2.folded = {_FOLD.format('value')}
  LEFT JOIN rws m0 ON m0.tag = raw LEFT JOIN rws m1 ON m1.tag = value),
w AS (SELECT id, tag, raw = '' OR coalesce(CASE WHEN has0 THEN v0 WHEN known IS NULL THEN v1 END = 'drop', false) AS dropped, CASE WHEN has0 THEN t0 WHEN known IS NULL THEN t1 END AS target, coalesce(CASE WHEN prefix <> '' THEN full_n END, bare_n) AS name FROM v)
SELECT id, tag, CASE WHEN dropped THEN '' ELSE coalesce(target, name, '') END AS resolved, CASE WHEN dropped THEN 'dropped' WHEN target IS NOT NULL THEN 'mapped' WHEN name IS NOT NULL THEN 'registry' ELSE 'unresolved' END AS how FROM w""",
)
def q_resolve(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.substring_index("p_type", " ", 1), F.concat(F.lit("Kind: "), F.col("p_type")), F.col("p_name"))).alias("tag"))
    return resolve(tags, spark.createDataFrame(_MAP, "tag string, verdict string, to string"), spelling_index(_names(spark, d)))


@VOCABULARY.query("dangling_targets", "SELECT o_custkey AS target, count(*) AS n FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') k ON o_custkey = c_custkey GROUP BY 1")
def q_dangling(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("target"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("target")).join(known, "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


@VOCABULARY.query("fold_key", f"SELECT p_partkey, {_FOLD.format('p_name')} AS folded FROM part")
def q_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fold("p_name").alias("folded"))


@VOCABULARY.query("word_fold_key", f"SELECT doc_id, lower(trim(regexp_replace(text, '{SPACE_RE2}', ' ', 'g'))) AS folded FROM documents")
def q_word_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", word_fold("text").alias("folded"))


@VOCABULARY.query("loose_tags", "SELECT l, count(*) AS n FROM (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS l FROM part) GROUP BY l")
def q_loose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(loose_tag("p_name").alias("l")).agg(F.count("*").alias("n"))


@VOCABULARY.query("namespace_of", "SELECT p_partkey, coalesce(CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 'voice' WHEN 'SMALL' THEN 'audience' WHEN 'LARGE' THEN 'induction' END, 'content') AS namespace FROM part")
def q_namespace(spark: SparkSession, d: str) -> DataFrame:
    """The namespace whose prefix a tag has; no known prefix: the one without a prefix."""
    kinds = spark.createDataFrame([("PROMO", "voice"), ("SMALL", "audience"), ("LARGE", "induction")], "prefix string, namespace string")
    tags = table(spark, d, "part").select("p_partkey", F.substring_index("p_type", " ", 1).alias("prefix"))
    return tags.join(F.broadcast(kinds), "prefix", "left").select("p_partkey", F.coalesce("namespace", F.lit("content")).alias("namespace"))


@VOCABULARY.query(
    "tag_order",
    "SELECT s_suppkey, string_agg(tag, ', ' ORDER BY ord, lower(tag), tag) AS tags FROM (SELECT DISTINCT l_suppkey AS s_suppkey, p_type AS tag, CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END AS ord FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1",
)
def q_tag_order(spark: SparkSession, d: str) -> DataFrame:
    """Tags of an item by namespace order, then case-folded name."""
    tags = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), F.col("p_type").alias("tag"))
    head = F.substring_index("tag", " ", 1)
    order = F.when(head == "PROMO", 0).when(head == "SMALL", 1).otherwise(2)
    return tags.groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.lower("tag").alias("l"), F.col("tag").alias("t")))), lambda s: s.t), ", ").alias("tags"))


def expand_code(value: F.Column) -> F.Column:
    """Tags of a speaker-for-listener code such as F4M, bare or behind ``Audience:``; none for anything else."""
    voice = F.create_map(*map(F.lit, "f fem m masc t transfem n androgynous".split()))
    audience = F.create_map(*map(F.lit, "f woman m man t transfem n enby c couple a anyone g man x anyone".split()))
    prefix, bare = split_tag(value)
    v = F.lower(bare)
    said = F.transform(F.split(F.substring_index(v, "4", 1), ""), lambda ch: F.concat(F.lit("Voice: "), F.try_element_at(voice, ch)))
    heard = F.transform(F.split(F.substring_index(v, "4", -1), ""), lambda ch: F.concat(F.lit("Audience: "), F.try_element_at(audience, ch)))
    code = prefix.isin("", "Audience") & bare.rlike("(?i)^[FMTNACGX]{1,4}4[FMTNACGX]{1,4}$")
    return F.when(code, F.array_distinct(F.array_compact(F.concat(said, heard)))).otherwise(F.array().cast("array<string>"))


@VOCABULARY.query(
    "audience_codes",
    """WITH k AS (SELECT p_partkey, ['f4m', 'm4f', 'fm4a', 'tn4c', 'f4g'][CAST(p_partkey % 5 AS INTEGER) + 1] AS code FROM part),
v AS (SELECT p_partkey, list_transform(string_split(split_part(code, '4', 1), ''), lambda x: 'Voice: ' || CASE x WHEN 'f' THEN 'fem' WHEN 'm' THEN 'masc' WHEN 't' THEN 'transfem' WHEN 'n' THEN 'androgynous' END)
 || list_transform(string_split(split_part(code, '4', 2), ''), lambda x: 'Audience: ' || CASE x WHEN 'f' THEN 'woman' WHEN 'm' THEN 'man' WHEN 'c' THEN 'couple' WHEN 'a' THEN 'anyone' WHEN 'g' THEN 'man' END) AS t FROM k)
SELECT p_partkey, array_to_string(t, '|') AS tags FROM v""",
)
def q_codes(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ["F4M", "M4F", "FM4A", "TN4C", "F4G"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(expand_code(code), "|").alias("tags"))


@VOCABULARY.query(
    "fold_proposal",
    "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '\\b(free|new)\\b') THEN '' ELSE trim(regexp_replace(p_name, '(?i)^((light|mild|some) +)+', '')) END AS proposal FROM part",
)
def q_proposal(spark: SparkSession, d: str) -> DataFrame:
    """Proposals without softening words in front; those that describe the upload are refused."""
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.when(F.lower(name).rlike(r"\b(free|new)\b"), "").otherwise(F.trim(F.regexp_replace(name, "(?i)^((light|mild|some) +)+", ""))).alias("proposal"))


@VOCABULARY.query(
    "vocabulary_counts",
    "SELECT author, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, tag) AS r FROM (SELECT author, tag, count(*) AS n FROM (SELECT p_brand AS author, p_type AS tag FROM part UNION ALL SELECT source, lang FROM documents) GROUP BY 1, 2)) WHERE r <= 10",
)
def q_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tags in use by author over sources and items; the ten commonest, ties by name."""
    used = table(spark, d, "part").select(F.col("p_brand").alias("author"), F.col("p_type").alias("tag")).unionByName(table(spark, d, "documents").select(F.col("source").alias("author"), F.col("lang").alias("tag")))
    counted = used.groupBy("author", "tag").agg(F.count("*").alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("n"), "tag"))).where("r <= 10").drop("r")


def fold_proposals(tags: DataFrame, known: DataFrame) -> DataFrame:
    """``tags`` with ``folded`` and ``why``: a registered tag that the proposal only softens or mentions, empty for what describes an upload, else the tag itself.

    ``tags``: any columns, of them ``tag``; ``known``: one column ``full``. Each of the at most four forms meets the registry in a join of its own, so rows aren't multiplied or regrouped; the registry is broadcast where Spark finds it small. A null or blank tag is empty.
    """
    names = known.select(F.col("full").alias("__known")).where("__known IS NOT NULL").distinct()
    out = tags.withColumn("__t", F.trim(F.coalesce("tag", F.lit("")))).withColumn("__forms", proposal_forms("__t"))
    hits = []
    for i in range(4):
        form = F.try_element_at("__forms", F.lit(i + 1))
        out = out.withColumn(f"__f{i}", form["form"]).join(names.withColumnRenamed("__known", f"__k{i}"), F.col(f"__f{i}") == F.col(f"__k{i}"), "left")
        hits.append(F.when(F.col(f"__k{i}").isNotNull(), F.struct(form["form"].alias("form"), form["why"].alias("why"))))
    plain = F.struct(F.col("__t").alias("form"), F.lit("").alias("why"))
    refused = F.when(F.col("__t") == "", "empty").when(F.col("__t").rlike(NOT_A_TAG), "not a tag: describes the upload, not the recording")
    got = F.when(refused.isNotNull(), F.struct(F.lit("").alias("form"), refused.alias("why"))).otherwise(F.coalesce(*hits, plain))
    return out.withColumn("__got", got).select(*tags.columns, F.col("__got.form").alias("folded"), F.col("__got.why").alias("why"))


@VOCABULARY.query(
    "fold_known_proposals",
    """WITH names AS (SELECT DISTINCT p_name AS n FROM part WHERE p_size < 25),
t AS (SELECT p_partkey, p_partkey % 4 AS k, p_name, ['some slight ', 'hint of ', 'part 3 of 4 ', ''][CAST(p_partkey % 4 AS INTEGER) + 1] || p_name AS tag FROM part)
SELECT p_partkey, CASE WHEN k = 2 THEN '' WHEN k IN (0, 1) AND n IS NOT NULL THEN CASE k WHEN 1 THEN 'CW: ' ELSE '' END || p_name ELSE tag END AS folded,
CASE WHEN k = 2 THEN 'not a tag: describes the upload, not the recording' WHEN n IS NULL OR k = 3 THEN '' WHEN k = 1 THEN 'mentioned rather than featured' ELSE 'a qualifier that only softens' END AS why
FROM t LEFT JOIN names ON n = p_name""",
)
def q_known_proposals(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    lead = F.element_at(F.array(*map(F.lit, ["some slight ", "hint of ", "part 3 of 4 ", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))
    names = part.where("p_size < 25").select(F.explode(F.array("p_name", F.concat(F.lit("CW: "), "p_name"))).alias("full"))
    return fold_proposals(part.select("p_partkey", F.concat(lead, "p_name").alias("tag")), names).select("p_partkey", "folded", "why")


_CHANGES = [("promo burnished copper", "Shiny copper"), ("STEEL", ""), ("Economy Anodized Steel", "Shiny copper")]


@VOCABULARY.query(
    "bulk_edit_rewrite",
    f"WITH ch(a, b) AS (VALUES ('promoburnishedcopper', 'Shiny copper'), ('steel', ''), ('economyanodizedsteel', 'Shiny copper')), t AS (SELECT p_partkey AS id, unnest([p_type, split_part(p_name, ' ', 1)]) AS tag FROM part) SELECT DISTINCT id, CASE WHEN a IS NOT NULL THEN b ELSE tag END AS tag FROM t LEFT JOIN ch ON a = {_FOLD.format('tag')} WHERE CASE WHEN a IS NOT NULL THEN b ELSE tag END <> ''",
)
def q_bulk(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array("p_type", F.substring_index("p_name", " ", 1))).alias("tag"))
    return rewrite(tags, spark.createDataFrame(_CHANGES, "from string, to string"))
