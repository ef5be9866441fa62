"""Every query of the engine proper against its SQL twin, and functions against fixed cases."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import planning, transcript
from corpusloom.operators.matching import unique_stems
from corpusloom.operators.vocabulary import expand_code
from corpusloom.plans import suite

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) or str(x) == "<NA>" else x.item() if hasattr(x, "item") else x
    return sorted(repr([plain(x) for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = suite.QUERIES[name](spark, sf_dir).toPandas()
    if name in suite.ORACLE_SQL:
        want = duck.sql(suite.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "given", "want"), [
    (text.slug, "Straße", "strae"), (text.fold, "Straße", "strasse"), (text.slug, "", "untitled"), (text.slug, "don't stop", "dont-stop"),
    (text.squeeze, "one\x1ctwo\u0085three\u00a0 four", "one two three four"), (text.unrun, "DeepTranceLoop2", "Deep Trance Loop 2"), (text.unrun, "a_b_c", "a b c"),
    (text.tidy_case, "The End Of The Road", "The End of the Road"), (text.base_of, "title-0", "title"), (text.seconds_of, "1:02:03", 3723),
    (text.slug, "Łódź ﬁle", "odz-file"), (text.fold, "ẖŉ ǰ", "hnj"), (text.squash, "Ünder_score, ok!", "under_score ok"), (text.release_date, " 2024-05 about", "2024-05"), (text.release_date, "May 2024", ""),
    (text.json_part, '```json\n{"a": 1}\n```', '{"a": 1}'), (text.json_part, 'so: {"a": 1} done', '{"a": 1}'), (text.json_part, "none", None),
    (text.sentences, " ".join(["word"] * 90), [" ".join(["word"] * 49), " ".join(["word"] * 41)]), (text.sentences, 'Hello! "Next." End.', ["Hello!", '"Next.', "End."]), (text.stem_of, "a/b/c.yaml", "c"), (text.prose, "<p>a<b>b</b>", "a b"),
])
def test_functions(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_truthiness(spark):
    assert one(spark, text.first_truthy(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "x"
    for plain in ("fun", "four", "4", "x4", "Content: F4M", "mp4 file", ""):
        assert one(spark, expand_code(F.lit(plain))) == []
    assert one(spark, expand_code(F.lit("Audience: f4m"))) == ["Voice: fem", "Audience: man"]
    assert one(spark, expand_code(F.lit("FM4A"))) == ["Voice: fem", "Voice: masc", "Audience: anyone"]


def test_order_refuses():
    with pytest.raises(ValueError, match="unknown"):
        planning.order({"a": ["b"]})
    with pytest.raises(ValueError, match="cycle"):
        planning.order({"a": ["b"], "b": ["a"]})


def test_stems(spark):
    df = spark.createDataFrame([("x", 1, "t"), ("x", 2, "t-0"), ("x", 3, "t"), ("x", 4, "t")], "author string, pos long, stem string")
    many = spark.createDataFrame([("x", i, "t") for i in range(1003)], "author string, pos long, stem string")
    with pytest.raises(Exception, match="no free name"):
        unique_stems(many).count()
    assert [r["unique"] for r in unique_stems(df).orderBy("pos").collect()] == ["t", "t-0", "t-1", "t-2"]


def test_fuzzy_quotes(spark):
    from difflib import SequenceMatcher

    long = "The grey harbour lay under fog while 12 boats kept waiting for jazz, quartz vexed by pilots and the quiet mayor who had promised them a lamp, a bell, six maps and a warm hut beside the old northern wall before winter set in again over the bay."
    quotes = [(1, long), (2, "Thr quick brown fox jumps over the lazy dog."), (3, "Nothing like this is anywhere in the texts."), (4, None), (5, "")]
    texts = [long, "The quick brown fox jumps over the lazy dog.", "the lazy dog jumps over a fox", "", "Teh harbour " + long[16:]]
    got = transcript.similar_quotes([q for q in quotes if q[1] is not None], texts, 0.75)
    assert got == [(i, k, r) for k, t in enumerate(texts) for i, q in quotes if q is not None for r in [SequenceMatcher(None, t, q).ratio()] if r >= 0.75]
    docs = spark.createDataFrame([(7, texts[0]), (8, texts[1]), (9, None)], "doc_id long, text string")
    found = {r["item_id"]: (r["ratio"], r["doc_id"]) for r in transcript.fuzzy_quotes(spark.createDataFrame(quotes, "item_id long, text string"), docs).collect()}
    assert set(found) == {1, 2} and found[1] == (1.0, 7) and found[2][1] == 8


def test_exact_quotes_are_whole(spark):
    docs = spark.createDataFrame([(1, "x " + "a" * 70 + "b end"), (2, "x " + "a" * 70 + "c"), (3, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "a" * 70 + "b"), (2, "a" * 70), (3, "a" * 70 + "b"), (4, "short"), (5, None)], "item_id long, text string")
    assert sorted(map(tuple, transcript.exact_quotes(quotes, docs).collect())) == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_sentences_keep_their_first_digits(spark):
    """Pieces are trimmed of spaces, not of the digits of their place."""
    given = "  One. 148 is two. 2 is three! 33.122 is four? 4 is five. 5  "
    assert one(spark, text.sentences(F.lit(given))) == ["One.", "148 is two.", "2 is three!", "33.122 is four?", "4 is five.", "5"]
    assert one(spark, text.sentences(F.lit(" 0 is first. "))) == ["0 is first."]


def test_many_quotes_at_once():
    """Subsequences of all pairs in one pass against a plain table, with quotations of one to five words of bits, and ratios against difflib."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(4)
    quotes = [(k, "".join(r.choice("abcdé 😀") for _ in range(n))) for k, n in enumerate((1, 40, 63, 64, 65, 128, 129, 300))]
    texts = ["", "x", *("".join(r.choice("abcdéz ") for _ in range(n)) for n in (1, 50, 64, 90, 200, 310))]
    for _, q in quotes:  # close ones
        t = list(q)
        for _ in range(len(t) // 9):
            t[r.randrange(len(t))] = r.choice("ab z")
        texts.append("".join(t))

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for i, y in enumerate(b):
                last, row[i + 1] = row[i + 1], last + 1 if x == y else max(row[i], row[i + 1])
        return row[-1]

    prepared = transcript._Quotes(quotes)
    pairs = [(j, k) for j in range(len(quotes)) for k in range(len(texts))]
    size = np.array([len(t) for t in texts])
    j, k = np.array(pairs).T
    got = prepared.in_order(j, (np.cumsum(size) - size)[k], size[k], prepared.letter_of(transcript._codes(texts)))
    assert got.tolist() == [table(texts[k], quotes[j][1]) for j, k in pairs]
    want = [(i, k, x) for k, t in enumerate(texts) for i, q in quotes for x in [SequenceMatcher(None, t, q).ratio()] if x >= 0.75]
    assert prepared.similar(texts, 0.75) == want and len(want) == 7  # all close ones but the longest, whose letters are all popular
