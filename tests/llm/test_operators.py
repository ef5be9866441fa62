"""The ten operators on small hostile tables and against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, minhash, passages, quality, sharding, suite, token_counts, url_filter, warc
from corpusloom.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = words(300, 1), words(80, 2)
    edited = base[:100] + ["new"] + base[101:]
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(edited)), (4, None), (5, ""), (6, " \n\t"), (7, "two words"), (8, "Two WORDS"),
        (9, " ".join(words(150, 3) + passage + words(90, 4))), (10, " ".join(words(60, 5) + passage)), (11, "x" * 300_000), (12, " ".join(words(30_000, 6))), (7, "two words"), (13, "é ▁ 日本\x00 <s>"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.0, 0) for i, t in rows], DOCS)


def test_near_duplicates(docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == 14 and [g for g in got if g[0] == 7] == [(7, 1, 7)] * 2
    assert by[1][1] == by[2][1] == by[3][1] == 1 and by[8] == (1, 7) and by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (0, 6) and by[9][1] == 9 and by[10][1] == 10


def test_near_duplicates_of_copies(spark):
    """A large group of near copies against exact components."""
    r = random.Random(9)
    base = words(120, 7)
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(r.randrange(0, 7)):
            t[r.randrange(len(t))] = f"e{r.randrange(40)}"
        texts.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert {q["doc_id"]: q["component_id"] for q in minhash.near_duplicates(df).collect()} == {i: find(i) for i in range(len(texts))}


def test_passages(docs):
    found = passages.find_passages(docs).collect()
    pairs = {(r["doc_id"], r["ref_doc_id"]) for r in found}
    assert (10, 9) in pairs and (2, 1) in pairs and (3, 1) in pairs and all(a > b for a, b in pairs) and not {i for p in pairs for i in p} & {4, 5, 6, 7, 8, 11, 12, 13}
    r = next(r for r in found if (r["doc_id"], r["ref_doc_id"]) == (10, 9))
    assert (r["start_word"], r["end_word"], r["ref_start_word"]) == (60, 140, 150) and r["similarity"] == 1.0
    left = {q["doc_id"]: q["text"] for q in passages.cut(docs, passages.find_passages(docs)).select("doc_id", "text").collect()}
    assert left[10] == " ".join(words(60, 5)) and 2 not in left and left[4] is None and left[1]


def test_rows_without_doc_id(spark):
    a, b = " ".join(words(120, 71)), " ".join(words(120, 72))
    rows = spark.createDataFrame([(None, a), (5, a), (6, a), (None, b), (8, "x y z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (6, 5), (None, None), (8, 8)], key=str)
    assert {(r["doc_id"], r["ref_doc_id"]) for r in passages.find_passages(rows).collect()} == {(6, 5)}


@pytest.mark.parametrize("top", [3, 12, 10**9])
def test_compact_windows(top):
    rng = np.random.default_rng(top)
    for _ in range(60):
        begin = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 4))])
        v, least, want = rng.integers(1, top + 1, begin[-1]).astype(np.uint64), int(rng.integers(2, 12)), set()
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            for c in range(a, b):
                lo, hi = c, c
                while lo > a and v[lo - 1] > v[c]:
                    lo -= 1
                while hi + 1 < b and v[hi + 1] >= v[c]:
                    hi += 1
                if hi - lo + 1 >= least:
                    want.add((lo, c, hi))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, begin, least)), strict=True)) == want


def test_decontamination(spark, docs):
    passage = docs.where("doc_id = 9").first()["text"].split()[150:230]
    bench = spark.createDataFrame([(5, " ".join(passage[:12]).upper()), (6, "Two words!"), (7, None), (8, ""), (9, " ".join(passage[3:14]))], "item_id long, text string")
    for block in (1 << 20, 10):  # one automaton, or one an item
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench, block_bytes=block).collect()}
        assert (got[9]["n_hit"], got[9]["item_ids"]) == (14, [5, 9]) and got[7]["item_ids"] == [6] and got[4]["n_words"] == 0 and got[1]["n_hit"] == 0
        assert len(got) == 13 and [(p["first"], p["last"]) for p in got[9]["spans"]] == [(150, 164)]
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    odd = spark.createDataFrame([(None, "two words"), ("x", " ".join(passage[:12])), (None, " ".join(passage[20:31]))], "item_id string, text string")
    clash = docs.where("doc_id in (7, 9)").withColumn("n_words", F.lit(-1)).withColumn("key", F.lit("k"))
    for block in (1 << 20, 10):
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(clash.unionByName(clash.withColumn("doc_id", F.lit(None).cast("long"))), odd, block_bytes=block).collect()}
        assert got[9]["item_ids"] == ["x", None] and got[9]["n_hit"] == 23 and got[7]["item_ids"] == [None] and got[None]["n_words"] > 0


def test_decontamination_by_brute_force(spark):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items, rows = [(i, text(r.randrange(1, 14))) for i in range(12)], [(i, text(r.randrange(0, 40))) for i in range(30)]
    got = {q["doc_id"]: (q["n_words"], q["n_hit"], q["item_ids"]) for q in decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=4, block_bytes=300).collect()}
    for i, t in rows:
        w, hit, named = t.split(), set(), set()
        for k, p in items:
            v = p.split()
            n = min(4, len(v))
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            at = [j for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in wins]
            hit |= {j + x for j in at for x in range(n)}
            named |= {k} if at else set()
        assert got[i] == (len(w), len(hit), sorted(named))


def test_urls(spark):
    rows = [(1, "https://A.Example.com/en/7x?q"), (2, "http://b.com/en/"), (3, None), (4, "no scheme"), (5, "http://com/en/1"), (6, "x://example.net/de/8"), (7, "x://m.example.net/de/1#z"), (8, "x://notcom/en/1"), (9, "http://x.org")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block") and got[3] == got[4] == ("", "", None, "allow")
    assert got[5][3] == "block" and got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == ("net/de/", "allow") and got[8][2] is None and got[9][2] is None


def test_sharding(docs):
    got = sharding.with_slots(sharding.assign(docs, "doc_id", 4), "doc_id", 8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 4)
    assert len(got) == 14 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    heavy = sharding.assign(docs, "doc_id", 2, weights=[1e9, 1e-9]).select("shard").distinct().collect()
    assert [r["shard"] for r in heavy] == [0]


def test_warc(spark):
    big = "a" * 1500
    rows = [(1, "http://a.com/x", big), (2, "http://b.com/", big), (3, None, big), (4, "http://a.com/x", None), (5, "é://ü/\n", "short"), (6, "http://a.com/x", "short"), (7, "http://a.com/x", ""), (None, "http://a.com/x", big)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, key string, number int").repartition(3)
    s = Scratch(spark)
    upper = warc.write_index(warc.write_archives(pages, s), s, 2)
    ask = pages.select(*(c.alias(k) for k, c in warc.capture(pages).items()))
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_back(ask, upper, 2).collect()}
    assert got == {None: (1500, "response", None), 1: (1500, "revisit", 3), 2: (1500, "revisit", 3), 3: (1500, "response", None), 4: (0, "response", None), 5: (5, "response", None), 6: (5, "response", None), 7: (0, "response", None)}


def test_quality(spark, sf_dir):
    out = suite.QUERIES["op10_quality"](spark, sf_dir.replace("0.001", "0.01")).join(spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score_quality(docs, quality.fit(docs, none)).orderBy("doc_id").collect()] == [0.0, 0.0, 1.0]


def test_quality_votes(spark):
    """Scores against a plain loop over all labelled vectors; repeated rows, ids and clashing columns."""
    from corpusloom.llm.textcore import Hasher, ascii_space

    rng = random.Random(5)
    good, junk = (lambda: " ".join(words(40, rng.random()))), (lambda: "!!! $$$ " * rng.randrange(5, 30))
    rows = [(i, good() if i % 2 else junk()) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(7, 1), (None, 0), (9999, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + [(7, rows[7][1])] * 3 + [(None, "null id")], "doc_id long, text string").withColumn("score", F.lit(-7.0))
    model = quality.fit(docs, labels)
    counts = quality.term_counts([t.encode() for _, t in rows], Hasher(ascii_space()))
    unit = lambda v: v / max(np.linalg.norm(v), 1e-30)
    vectors, near = np.array([unit(v) for v in model._weigh(counts) @ model.basis]), quality.NEIGHBOURS
    want = []
    for v in vectors:
        cosine = [float(v @ x) for x in model.vectors]
        best = sorted(range(len(cosine)), key=lambda k: -cosine[k])[:near]
        weight = [max(cosine[k], 1e-3) ** quality.POWER for k in best]
        want.append(sum(w * model.labels[k] for w, k in zip(weight, best)) / sum(weight))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert len(got) == 401 and max(abs(got[i] - want[i]) for i in range(400)) < 1e-3
    assert np.mean([(got[i] >= 0.5) == (i % 2) for i in range(400)]) > 0.99


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert minhash.near_duplicates(none).count() == passages.find_passages(none).count() == token_counts.count_tokens(none).count() == 0
    assert sharding.with_slots(sharding.assign(none, "doc_id", 3), "doc_id").count() == 0
    s = Scratch(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    upper = warc.write_index(warc.write_archives(pages, s), s, 2)
    assert warc.read_back(pages.select(*(c.alias(k) for k, c in warc.capture(pages).items())), upper, 2).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.find_contamination(none, bench).count() == url_filter.filter_urls(pages).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(none, quality.fit(none, labels)).count() == 0


@pytest.mark.parametrize("name", list(suite.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(suite.ORACLE_SQL[name])
    cols = want.columns
    assert sorted(map(repr, (tuple(r) for r in suite.QUERIES[name](spark, sf_dir).select(*cols).collect()))) == sorted(map(repr, want.fetchall()))
