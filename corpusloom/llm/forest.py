"""Operator 4: nearest neighbours by a forest of sorted hash strings.

Distinct vectors (each with its smallest ids, which are all that can be among
the nearest) get a long hash string per tree: signs of random projections,
after a coordinate is added that makes inner products and angles agree. As one
very long vector would make all others look alike, vectors are parted by the
power of two of their norm, and each part is a forest of its own.

A tree is one sorted array of all strings of a part, cut at quantiles into
cells of bounded size. A query goes to the cell of each tree where its string
stands, so what is shuffled is trees x rows, once for the strings and once
with the vectors; no vector meets a query outside its cells. In a cell the
query descends to its longest matching prefix by binary search and the sizes
of all prefixes' ranges are counted (beyond the cell: estimated from borders);
the counts of all trees are added, and all trees ascend together to the
longest length at which they hold enough matches. The query then goes to the
cells of that prefix, mostly the same ones, its matches are scored exactly, in
double precision, and the best of all trees are merged.

How many are enough is calibrated on at most ``SAMPLE`` distinct queries whose
true neighbours are found by brute force over all rows; every row is indexed.

Behaviour: vectors that are null, empty, zero, of another length than most (of
equally common lengths the smallest is taken), or hold null or non-finite
components take no part, neither as query nor as candidate; ties go to the
smaller id; rows that repeat an id with the same vector count once, a null id
takes no part; fewer candidates than asked: all that are found; empty tables
give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch, bounded

TREES, BITS = 16, 32
#: Rows of a cell, about.
CELL_ROWS = 8192
#: Queries on which the depth is calibrated, and the recall wanted there.
SAMPLE, RECALL = 64, 0.98
NEAREST = 20


class Planes(NamedTuple):
    """Random projections, and the largest norm of each part."""

    sides: np.ndarray
    reach: dict[int, float]

    def strings(self, x: np.ndarray, part: int) -> np.ndarray:
        """Hash strings of vectors of a part, (rows, trees)."""
        spare = np.sqrt(np.maximum(self.reach[part] ** 2 - (x * x).sum(axis=1), 0))
        return self._signs(np.hstack([x, spare[:, None]]))

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Hash strings of queries, the same in all parts."""
        return self._signs(np.hstack([q, np.zeros((len(q), 1))]))

    def _signs(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), TREES), np.int64)
        value = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for t in range(TREES):  # a tree at a time bounds the memory
            out[:, t] = (x @ self.sides[:, t * BITS : (t + 1) * BITS] > 0) @ value
        return out


def planes(size: int, reach: dict[int, float], seed: int = 7) -> Planes:
    return Planes(np.random.default_rng(seed).standard_normal((size + 1, TREES * BITS)), reach)


class Cells(NamedTuple):
    """Where the sorted arrays are cut: borders by part and tree."""

    borders: dict[tuple[int, int], np.ndarray]
    first: dict[tuple[int, int], int]

    def range(self, part: int, tree: int, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell in which each string may stand."""
        cut, at = self.borders[part, tree], self.first[part, tree]
        return at + np.searchsorted(cut, strings, "left"), at + np.searchsorted(cut, strings, "right")


def cells(borders: dict[tuple[int, int], np.ndarray]) -> Cells:
    first, at = {}, 0
    for k in sorted(borders):
        first[k], at = at, at + len(borders[k]) + 1
    return Cells(borders, first)


def _rows(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _best(rows: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` largest, and all that tie with the last of them: ids decide later."""
    if len(rows) > n:
        keep = score >= np.partition(score, len(rows) - n)[len(rows) - n]
        return rows[keep], score[keep]
    return rows, score


def _inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; each row's sum doesn't depend on what else is in ``x``."""
    return (x * q).sum(axis=1)


def _ranges(strings: np.ndarray, asked: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, in sorted ``strings``, of the matches of each query's prefix."""
    low, high = _prefix(asked, length)
    return np.searchsorted(strings, low, "left"), np.searchsorted(strings, high, "right")


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part, ``v`` in double precision."""
    v = F.col("embedding")
    fine = F.when(v.isNotNull(), (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)).otherwise(False)
    # -0.0 and 0.0 are one value
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


def _packed(rows: DataFrame) -> DataFrame:
    """The vectors as bytes, with their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("v").to_pylist(), np.float64).reshape(b.num_rows, -1)
            norm = np.sqrt((x * x).sum(axis=1))
            part = np.frexp(np.maximum(norm, np.finfo(float).tiny))[1]
            yield pa.RecordBatch.from_arrays([b.column("ids"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(part, pa.int32()), pa.array(norm)], ["ids", "raw", "part", "norm"])

    return rows.select("ids", "v").mapInArrow(run, "ids array<long>, raw binary, part int, norm double")


def _dealt(rows: DataFrame, where: Cells, by: Planes, whole: bool) -> DataFrame:
    """Vectors dealt to their cell of each tree: ``(cell, string)``, with ids and vectors if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, parts = _rows(b.column("raw")), b.column("part").to_numpy()
            for part in np.unique(parts):
                own = np.flatnonzero(parts == part)
                strings = by.strings(x[own], int(part))
                for t in range(TREES):
                    lo, hi = where.range(int(part), t, strings[:, t])
                    cell = lo + own % (hi - lo + 1)  # one string in many cells: spread
                    cols = [pa.array(cell), pa.array(strings[:, t])]
                    if whole:
                        cols += [b.column("ids").take(pa.array(own)), b.column("raw").take(pa.array(own))]
                    yield pa.RecordBatch.from_arrays(cols, ["cell", "string", "ids", "raw"][: len(cols)])

    return rows.mapInArrow(run, "cell long, string long" + (", ids array<long>, raw binary" if whole else ""))


def _prefix(strings: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """First and last string that begin with each string's prefix."""
    shift = BITS - np.asarray(length, np.int64)
    low = (strings >> shift) << shift
    return low, low + (np.int64(1) << shift) - 1


def _sent(asks: DataFrame, where: Cells, by: Planes, cell_rows: int) -> DataFrame:
    """Queries ``asks(q, raw)`` dealt to the cells of their strings, or ``asks(q, raw, part, level)`` to those of their prefixes.

    Without a level the first row of a query in a tree has ``more``: by length
    of prefix, about how many matches stand in other cells than these.
    """
    ready = "level" in asks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings, own_part = by.asked(_rows(b.column("raw"))), b.column("part").to_numpy() if ready else None
            for part, t in where.borders:
                own = np.flatnonzero(own_part == part) if ready else np.arange(b.num_rows)
                if not len(own):
                    continue
                mine = strings[own, t]
                low, high = _prefix(mine, b.column("level").to_numpy()[own] if ready else BITS)
                lo, hi = where.range(part, t, low)[0], where.range(part, t, high)[1]
                wide = hi - lo + 1
                which = np.repeat(np.arange(len(own)), wide)
                cell = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(wide) - wide, wide)
                take = pa.array(own[which])
                cols = [b.column("q").take(take), pa.array(np.full(len(which), part, np.int32)), pa.array(cell), pa.array(mine[which])]
                if ready:
                    cols += [b.column("raw").take(take), b.column("level").take(take)]
                else:
                    more = np.empty((len(own), BITS + 1), np.int64)
                    for length in range(BITS + 1):
                        low, high = _prefix(mine, length)
                        more[:, length] = (where.range(part, t, high)[1] - where.range(part, t, low)[0] + 1 - wide) * cell_rows // 2
                    cols.append(pa.array([more[k].tolist() if first else None for k, first in zip(which, cell == lo[which], strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["q", "part", "cell", "string", *(("raw", "level") if ready else ("more",))])

    return asks.mapInArrow(run, "q long, part int, cell long, string long, " + ("raw binary, level int" if ready else "more array<long>"))


def _reach(data: DataFrame, asks: DataFrame) -> DataFrame:
    """``(q, part, reach)``: matches of each query over all trees, by length of prefix from 0, estimated beyond its own cells."""

    def run(key, data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asks):
            return pd.DataFrame(columns=["q", "part", "reach"], dtype=object)
        strings, q = np.sort(data["string"].to_numpy()), asks["string"].to_numpy()
        counts = np.empty((len(q), BITS + 1), np.int64)
        for length in range(BITS + 1):
            lo, hi = _ranges(strings, q, length)
            counts[:, length] = hi - lo
        for k, more in enumerate(asks["more"]):
            if more is not None:
                counts[k] += more
        return pd.DataFrame({"q": asks["q"], "part": asks["part"], "reach": list(counts)})

    each = data.groupBy("cell").cogroup(asks.groupBy("cell")).applyInPandas(run, "q long, part int, reach array<long>")
    return each.groupBy("q", "part").agg(F.array(*(F.sum(F.col("reach")[k]) for k in range(BITS + 1))).alias("reach"))


def _found(data: DataFrame, asks: DataFrame, n: int) -> DataFrame:
    """``(q, best)``: the ``n`` best matches of each query in each of its cells."""

    def run(key, data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asks):
            data = data.sort_values("string", kind="stable")
            strings, ids = data["string"].to_numpy(), data["ids"].to_list()
            x = np.frombuffer(b"".join(data["raw"]), np.float64).reshape(len(data), -1)
            lo, hi = _ranges(strings, asks["string"].to_numpy(), asks["level"].to_numpy())
            for q, raw, a, b in zip(asks["q"], asks["raw"], lo, hi, strict=True):
                rows, score = _best(np.arange(a, b), _inner(x[a:b], np.frombuffer(raw, np.float64)), n)
                pairs = sorted((-s, i) for r, s in zip(rows, score, strict=True) for i in ids[r])[:n]
                if pairs:
                    out.append((q, [{"neg": float(s), "i": int(i)} for s, i in pairs]))
        return pd.DataFrame(out, columns=["q", "best"], dtype=object)

    return data.groupBy("cell").cogroup(asks.groupBy("cell")).applyInPandas(run, "q long, best array<struct<neg: double, i: bigint>>")


def _truth(rows: DataFrame, sample: list[tuple[int, bytes]], n: int) -> dict[int, list[tuple[int, bytes]]]:
    """The true ``n`` nearest distinct vectors of each sampled query, with their parts: at most ``len(sample) * n`` rows come to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(np.stack([np.frombuffer(r, np.float64) for _, r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, part = b.column("raw"), b.column("part")
            x = _rows(raw)
            for k, q in enumerate(shared.value):
                at, score = _best(np.arange(len(x)), _inner(x, q), n)
                at, score = at[:n], score[:n]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(score), part.take(pa.array(at)), raw.take(pa.array(at))], ["k", "score", "part", "raw"])

    best = Window.partitionBy("k").orderBy(F.desc("score"), "raw")
    top = rows.select("raw", "part").mapInArrow(run, "k long, score double, part int, raw binary").withColumn("r", F.row_number().over(best)).where(F.col("r") <= n)
    out: dict[int, list[tuple[int, bytes]]] = {}
    for r in top.select("k", "part", "raw").collect():
        out.setdefault(sample[r["k"]][0], []).append((r["part"], bytes(r["raw"])))
    return out


def calibrated(sample: list[tuple[int, bytes]], truth: dict[int, list[tuple[int, bytes]]], reach: dict[tuple[int, int], list[int]], by: Planes, most: int, wanted: float) -> float:
    """Matches over all trees at which the sampled queries find the wanted share of their true neighbours."""
    met: list[tuple[int, int, int]] = []  # query, part, longest prefix that a true neighbour has in common in some tree
    for q, raw in sample:
        asked = by.asked(np.frombuffer(raw, np.float64)[None, :])[0]
        for part, other in truth.get(q, []):
            apart = asked ^ by.strings(np.frombuffer(other, np.float64)[None, :], part)[0]
            met.append((q, part, BITS - min(int(a).bit_length() for a in apart)))
    enough = float(NEAREST)
    while enough < most:
        level = {k: max((i for i, c in enumerate(counts) if c >= enough), default=0) for k, counts in reach.items()}
        if sum(common >= level[q, part] for q, part, common in met) >= wanted * len(met):
            break
        enough *= 1.3
    return enough


def nearest(vectors: DataFrame, queries: DataFrame, n: int = NEAREST, cell_rows: int = CELL_ROWS, sample: int = SAMPLE, wanted: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``n`` nearest vectors found for each query but itself."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    bounded(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = usable(vectors)
    size = clean.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return empty
    clean, asking = clean.where(F.size("v") == size["size"]), usable(queries).where(F.size("v") == size["size"])
    few = Window.partitionBy("v").orderBy("vec_id")
    # the n + 1 smallest ids of a vector: Spark keeps no more of a group before the shuffle either
    ranked = clean.distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= n + 1)
    rows = scratch.stage(_packed(ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))), "rows")
    asked = scratch.stage(asking.select("vec_id", F.xxhash64("v").alias("q"), "v").distinct(), "asked")
    ways = scratch.stage(_packed(asked.groupBy("v").agg(F.array(F.min("q")).alias("ids"))).select(F.col("ids")[0].alias("q"), "raw"), "ways")

    parts = {r["part"]: (r["n"], r["norm"]) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()}  # as many as powers of two among the norms
    by = planes(size["size"], {p: norm for p, (_, norm) in parts.items()})
    where = _cut(rows, by, parts, cell_rows)
    reach = scratch.stage(_reach(_dealt(rows, where, by, False), _sent(ways, where, by, cell_rows)), "reach")

    picked = [(r["q"], bytes(r["raw"])) for r in ways.orderBy(F.xxhash64("q"), "q").limit(sample).collect()]
    if not picked:
        return empty
    known = {(r["q"], r["part"]): r["reach"] for r in reach.join(F.broadcast(spark.createDataFrame([(q,) for q, _ in picked], "q long")), "q").collect()}
    enough = calibrated(picked, _truth(rows, picked, n + 1), known, by, TREES * sum(c for c, _ in parts.values()), wanted)

    level = F.array_max(F.transform("reach", lambda c, i: F.when(c >= enough, i).otherwise(0))).cast("int")
    asks = ways.join(reach.select("q", "part", level.alias("level")), "q")
    found = _found(_dealt(rows, where, by, True), _sent(asks, where, by, cell_rows), n + 1)
    # at most n + 1 of each of the query's cells
    lists = found.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, n + 1).alias("best"))
    own = asked.join(lists, "q").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b.i != F.col("vec_id")), 1, n).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.neg")).alias("score"))


def _cut(rows: DataFrame, by: Planes, parts: dict[int, tuple[int, float]], cell_rows: int) -> Cells:
    """Borders of the cells at quantiles of the strings; the driver gets as many numbers as there are cells."""
    most = max(-(-c // cell_rows) for c, _ in parts.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = _rows(b.column("raw")), b.column("part").to_numpy()
            for part in np.unique(own):
                at = np.flatnonzero(own == part)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), *(pa.array(s) for s in by.strings(x[at], int(part)).T)], ["part", *(f"s{t}" for t in range(TREES))])

    borders = {(p, t): np.zeros(0, np.int64) for p in parts for t in range(TREES)}
    if most > 1:
        strings = rows.select("raw", "part").mapInArrow(run, "part int, " + ", ".join(f"s{t} long" for t in range(TREES)))
        share = [k / most for k in range(1, most)]
        for r in strings.groupBy("part").agg(*(F.percentile_approx(f"s{t}", share, max(10_000, 20 * most)).alias(f"s{t}") for t in range(TREES))).collect():
            own = -(-parts[r["part"]][0] // cell_rows)
            for t in range(TREES):
                borders[r["part"], t] = np.array([r[f"s{t}"][round(k * most / own) - 1] for k in range(1, own)], np.int64)
    return cells(borders)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
