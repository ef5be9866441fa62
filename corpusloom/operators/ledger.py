"""The append-only decision ledger and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.catalogue import Catalogue, table

LEDGER = Catalogue()


def standing(rulings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest ruling of each key."""
    rest = [c for c in rulings.columns if c != key]
    return rulings.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "value")


@LEDGER.query("ledger_standing", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS verdict, round_even(arg_max(value, event_id) * 10, 0) / 10 AS value FROM events GROUP BY 1")
def q_standing(spark: SparkSession, d: str) -> DataFrame:
    return standing(_events(spark, d), "user_id", ["event_id"]).select("user_id", "event_id", F.col("event_type").alias("verdict"), (F.rint(F.col("value") * 10) / 10).alias("value"))


@LEDGER.query(
    "worth_revisiting",
    """SELECT user_id, now, was, now - was AS growth FROM (SELECT user_id, count(*) AS now, count(*) FILTER (event_id % 3 = 0) AS was FROM events GROUP BY 1) WHERE now >= 4 AND now >= 2 * was""",
)
def q_revisit(spark: SparkSession, d: str) -> DataFrame:
    """Refused tags asked for at least four times and at least twice as often as when refused."""
    g = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("now"), F.count_if(F.col("event_id") % 3 == 0).alias("was"))
    return g.where("now >= 4 AND now >= 2 * was").withColumn("growth", F.col("now") - F.col("was"))


@LEDGER.query(
    "pending_tags",
    """SELECT tag, n, recordings, examples FROM (SELECT event_type AS tag, count(*) AS n, count(DISTINCT user_id) AS recordings FROM events GROUP BY 1) JOIN
    (SELECT event_type AS tag, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS examples FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 6 GROUP BY 1) USING (tag)""",
)
def q_pending(spark: SparkSession, d: str) -> DataFrame:
    """Unsettled tags with counts, recordings and the first six examples."""
    e = _events(spark, d)
    first = e.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).where("r <= 6")
    few = first.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("examples"))
    total = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("recordings"))
    return total.join(few, "event_type").select(F.col("event_type").alias("tag"), "n", "recordings", "examples")


@LEDGER.query(
    "backfill_tags",
    """WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1)
SELECT d.doc_id, s.verdict AS tag FROM documents d JOIN s ON d.doc_id % 97 = s.user_id % 97 AND d.doc_id % 20 = s.user_id % 20 WHERE s.verdict <> 'error' GROUP BY ALL""",
)
def q_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Granted tags reach the recordings that asked for them; refusals are never backfilled."""
    s = standing(_events(spark, d), "user_id", ["event_id"]).where("event_type <> 'error'").select((F.col("user_id") % 97).alias("a"), (F.col("user_id") % 20).alias("b"), F.col("event_type").alias("tag"))
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 97).alias("a"), (F.col("doc_id") % 20).alias("b"))
    return docs.join(s, ["a", "b"]).select("doc_id", "tag").distinct()


@LEDGER.query("refused_tags", "SELECT user_id, verdict FROM (SELECT user_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1) WHERE verdict IN ('error', 'view') AND user_id NOT IN (SELECT n_nationkey FROM nation)")
def q_refused(spark: SparkSession, d: str) -> DataFrame:
    now = standing(_events(spark, d), "user_id", ["event_id"]).where(F.col("event_type").isin("error", "view"))
    return now.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("user_id")), "user_id", "left_anti").select("user_id", F.col("event_type").alias("verdict"))


@LEDGER.query("usage_by_model", "SELECT event_type AS model, count(*) AS calls, round(sum(coalesce(nullif(value, 0), 0.5)), 4) AS cost FROM events GROUP BY 1")
def q_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and cost by model; what was billed, else the estimate."""
    return _events(spark, d).groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(0.5))), 4).alias("cost"))
