"""Connected components of an undirected graph, as alternating star contractions.

Each round replaces links by links to the smallest neighbour (large star: from
larger neighbours; small star: from smaller ones) with a partially aggregated
minimum and one join, so no vertex's neighbours ever meet in one task. Rounds
stop when the links no longer change; every round is staged in the shared
folder. The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch


def _print(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0)).alias("h")).first()
    return int(r["n"]), int(r["h"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # every link has its larger end in ``u``, so larger neighbours of a vertex are found from its ``v`` side
    return edges.join(least.withColumnRenamed("u", "v"), "v").where(F.col("u") > F.col("m")).select("u", F.col("m").alias("v"))  # repeats go in the small star


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every vertex that has a link; component: the smallest vertex reachable.

    ``edges``: two columns ``a`` and ``b``; loops, nulls and repeats are ignored.
    """
    now = scratch.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    was = _print(now)
    for _ in range(rounds):
        if was[0] == 0:
            break
        after = scratch.stage(_small(_large(now)), "links")
        scratch.drop(now)
        now, seen = after, _print(after)
        if seen == was:
            break
        was = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
