"""The hash-prefix forest against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import forest, suite


def found_by(df, **more):
    got = defaultdict(list)
    for r in forest.nearest(df, df.where("vec_id % 20 = 0"), **more).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall(got, ids, x, asked, n):
    hit = want = 0
    for q in asked:
        s = x @ x[ids.index(q)]
        true = [ids[k] for k in np.lexsort((np.array(ids), -s)) if ids[k] != q][:n]
        assert all(abs(s[ids.index(i)] - v) < 1e-9 * max(1, abs(v)) for i, v in got[q]) and [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
        hit += len(set(true) & {i for i, _ in got[q]})
        want += len(true)
    return hit / want


def test_hostile_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[100:140] = x[0]
    x[7] *= 1e6  # one very long vector must not make all others look alike
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(700, None, 1.0), (720, [0.0] * 8, 1.0), (740, [float("nan")] * 8, 1.0), (760, [], 1.0), (780, [1.0, None], 1.0), (20, x[20].tolist(), 1.0), (None, [1.0] * 8, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = found_by(df, n=5, cell_rows=200)
    assert set(got) == set(range(0, 600, 20)) and all(len(f) == 5 for f in got.values())
    assert recall(got, list(range(600)), x.astype(float), list(range(0, 600, 20)), 5) >= 0.9
    assert [i for i, _ in got[100]][:1] == ([7] if x[7].astype(float) @ x[0].astype(float) > 0 else [0])


def test_other_lengths_than_most(spark):
    """Half of the queries have two components; the others lose nothing by it."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + 20 * k, [1.0, 2.0]) for k in range(19)]
    for order in (rows, rows[::-1]):
        got = found_by(spark.createDataFrame(order, "vec_id long, embedding array<float>"))
        assert set(got) == set(range(0, 400, 20)) and recall(got, list(range(400)), x.astype(float), list(got), 20) >= 0.95


def test_strings_that_fill_cells(spark):
    """Vectors too much alike for their strings to differ stand in several cells."""
    rng = np.random.default_rng(6)
    x = np.ones((900, 6)) + 1e-9 * rng.standard_normal((900, 6))
    x[:100] = rng.standard_normal((100, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found_by(df, n=4, cell_rows=100)
    assert set(got) == set(range(0, 900, 20)) and recall(got, list(range(900)), x, list(got), 4) >= 0.9


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 0.0])], [(1, [1.0, 0.0])], [(20, None)], [(20, [1.0, 0.0]), (21, [0.0, -1.0])]])
def test_few_vectors(spark, rows):
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert dict(got) == ({20: [(21, 0.0)]} if len(rows) == 2 else {})


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = defaultdict(list)
    for r in suite.QUERIES["op4_nearest"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 20 == 0]
    assert all(len(got[q]) == 20 for q in asked) and recall(got, ids, x, asked, 20) >= 0.95
