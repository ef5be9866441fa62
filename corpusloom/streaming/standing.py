"""The ledger as a stream: current rulings kept up to date from appended rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.catalogue import Catalogue

STREAMING = Catalogue()


def standing_stream(rulings: DataFrame, key: str, seq: str, verdict: str) -> DataFrame:
    """A streaming aggregation: the verdict with the largest sequence number of each key."""
    return rulings.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(verdict, seq).alias("verdict"))


@STREAMING.query("streaming_standing", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1")
def q_standing(spark: SparkSession, d: str) -> DataFrame:
    """Drains the file stream once and returns the folded state."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    name = f"standing_{uuid.uuid4().hex[:8]}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    q = standing_stream(stream, "user_id", "event_id", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
