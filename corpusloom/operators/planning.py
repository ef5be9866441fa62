"""Artefact plans, dependency order, blocked work, samples."""

from __future__ import annotations

import random
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.dedupe import ranked_in_groups
from corpusloom.plans.catalogue import Catalogue, table

PLANNING = Catalogue()
#: A small stand-in for the artefact graph: each step and what it needs.
STEPS = {"media": [], "transcript": ["media"], "acoustic": ["media"], "analysis": ["transcript"], "review": ["analysis", "acoustic"], "entry": ["review"]}


def order(graph: dict[str, list[str]]) -> list[str]:
    """Steps after all they need, first listed first; unknown needs and cycles are errors."""
    unknown = sorted({n for needs in graph.values() for n in needs} - graph.keys())
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError(f"cycle: {' -> '.join(e.args[1])}") from e


def levels(spark: SparkSession, graph: dict[str, list[str]]) -> DataFrame:
    """``(step, level)``: the longest chain of needs below each step."""
    depth: dict[str, int] = {}
    for s in order(graph):
        depth[s] = 1 + max((depth[n] for n in graph[s]), default=-1)
    return spark.createDataFrame(sorted(depth.items()), "step string, level int")


@PLANNING.query("topological_order", "WITH RECURSIVE e(a, b) AS (VALUES ('media', 'transcript'), ('media', 'acoustic'), ('transcript', 'analysis'), ('analysis', 'review'), ('acoustic', 'review'), ('review', 'entry')), r(step, level) AS (SELECT 'media', 0 UNION ALL SELECT b, level + 1 FROM r JOIN e ON step = a) SELECT step, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY 1")
def q_order(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, STEPS)


def _state(spark: SparkSession, d: str) -> DataFrame:
    """Per document which artefacts exist."""
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", (F.col("n_chars") > 500).alias("media"), F.col("quality").isNotNull().alias("review"), (F.coalesce("toxic", F.lit(0)) == 1).alias("entry"))


@PLANNING.query("artefact_plan", "WITH s AS (SELECT d.doc_id, n_chars > 500 AS media, quality IS NOT NULL AS review, coalesce(toxic, 0) = 1 AS entry FROM documents d LEFT JOIN labels l USING (doc_id)), u AS (SELECT 'media' AS artefact, media AS there FROM s UNION ALL SELECT 'review', review FROM s UNION ALL SELECT 'entry', entry FROM s) SELECT artefact, count(*) FILTER (NOT there) AS outstanding, count(*) FILTER (there) AS finished, ceil(count(*) FILTER (NOT there) / 150.0)::BIGINT AS batches FROM u GROUP BY 1")
def q_plan(spark: SparkSession, d: str) -> DataFrame:
    """Outstanding and finished artefacts, and submissions of 150."""
    u = _state(spark, d).unpivot("doc_id", ["media", "review", "entry"], "artefact", "there")
    g = u.groupBy("artefact").agg(F.count_if(~F.col("there")).alias("outstanding"), F.count_if("there").alias("finished"))
    return g.withColumn("batches", F.ceil(F.col("outstanding") / 150.0).cast("long"))


@PLANNING.query("blocked_propagation", "SELECT d.doc_id, step FROM documents d, (VALUES ('transcript'), ('acoustic'), ('analysis'), ('review'), ('entry')) t(step) WHERE n_chars <= 500")
def q_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Steps that can't run because something they need, directly or not, has failed."""
    above: dict[str, set[str]] = {}
    for s in order(STEPS):
        above[s] = set(STEPS[s]).union(*(above[n] for n in STEPS[s]))
    blocked = sorted(s for s, needs in above.items() if "media" in needs)
    return _state(spark, d).where(~F.col("media")).select("doc_id", F.explode(F.array(*map(F.lit, blocked))).alias("step"))


def shuffled(n: int, seed: int) -> list[int]:
    """Places of ``range(n)`` after a seeded shuffle (Mersenne Twister, Fisher-Yates)."""
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


@PLANNING.query("balanced_sample")
def q_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most two documents of an author, in seeded order."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    n = 4096  # the shuffle is of slots, so its size doesn't follow the table
    ranks = spark.createDataFrame(list(enumerate(shuffled(n, 11))), "slot long, rank long")
    keyed = docs.withColumn("slot", F.col("doc_id") % n).join(F.broadcast(ranks), "slot")
    return keyed.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("rank", "doc_id"))).where("r <= 2").select("source", "doc_id", "r")


@PLANNING.query("review_chunks", "SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS chunk, doc_id FROM documents")
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Submissions of one hundred of each language; numbering is by (range, place), so no task sees all rows."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return ranked_in_groups(docs, "lang", [F.expr("doc_id div 1024")], [F.col("doc_id")]).select("lang", F.expr("(rank - 1) div 100").alias("chunk"), "doc_id")


@PLANNING.query("review_routes", "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND length(text) >= 40 THEN 'solo' WHEN lang = 'en' THEN 'wordless' ELSE 'skip' END AS route FROM documents LEFT JOIN labels l USING (doc_id)")
def q_routes(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("heard")), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("heard").isNotNull() & (F.length("text") >= 40), "solo").when(F.col("lang") == "en", "wordless").otherwise("skip").alias("route"))
