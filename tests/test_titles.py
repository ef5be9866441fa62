"""Titles, proposals and small values against fixed cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import titles, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [
    ("Deep Sleep [12:30]", ("Deep Sleep", "", "")),
    ("[F4M] Deep Sleep (script by u/some_one)", ("Deep Sleep", "some_one", "")),
    ("[Deep Sleep] [tag] and more words here", ("and more words here", "", "")),
    ("[Deep Sleep] [tag] short", ("Deep Sleep", "", "")),
    ("Deep Sleep [tag", ("Deep Sleep", "", "")),
    ("Deep Sleep some tag]", ("Deep Sleep", "", "")),
    ("example.com - Deep Sleep", ("Deep Sleep", "", "")),
    ("Deep Sleep video_h264 HQ.mp3", ("Deep Sleep", "", "video h264")),
    ("Deep Sleep (loop)", ("Deep Sleep", "", "")),
    ("DeepTranceLoop2_mixdown", ("Deep Trance Loop 2", "", "mixdown")),
    ("HQ", ("HQ", "", "")), ("", ("", "", "")), (None, None),
])
def test_tidy_title(spark, given, want):
    got = one(spark, titles.tidy_title(F.lit(given).cast("string")))
    assert (None if got is None or got["title"] is None else tuple(got)) == want


def test_sites_are_a_parameter(spark):
    assert one(spark, titles.tidy_title(F.lit("My Site: Deep Sleep"), [r"my\s+site"]))["title"] == "Deep Sleep"


@pytest.mark.parametrize(("given", "want"), [("some light rope", ["rope", "Rope"]), ("hint of fear", ["CW: fear", "CW: Fear"]), ("rope", []), ("mild", []), (None, None)])
def test_proposal_forms(spark, given, want):
    got = one(spark, titles.proposal_forms(F.lit(given).cast("string")))
    assert [f["form"] for f in got or []] == (want or [])


def test_title_words(spark):
    assert one(spark, titles.title_words(F.lit("o'neil's mIXED-case 2nd"))) == "O'Neil'S Mixed-Case 2Nd"


@pytest.mark.parametrize(("words", "rows", "want"), [("a b c d e", 2, ["a b", "c d e"]), ("a b c", 1, ["a b c"]), ("a", 3, ["a"]), ("a b", 5, ["a", "b"]), ("a b c d e f g", 3, ["a b", "c d", "e f g"])])
def test_wrap_words(spark, words, rows, want):
    assert one(spark, values.wrap_words(F.split(F.lit(words), " "), rows)) == want


def test_lists(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, values.mark_generated(arr("zeta"), arr("title", "nothing", "cover"))) == ["cover", "title", "zeta"]
    assert [tuple(p) for p in one(spark, values.add_proposals(F.array(F.struct(F.lit("a").alias("tag"), F.lit("w").alias("why"))), arr("a", "b", "b"), "new"))] == [("a", "w"), ("b", "new")]
    assert one(spark, values.added_tags(arr("b", "a", "c"), arr("a"))) == ["b", "c"]
    assert [one(spark, values.catch_all(F.lit(a).cast("string"))) for a in (None, " Unknown one", "compilation", "Ann")] == [True, True, True, False]
    assert one(spark, values.trusted_labels(arr("a", "", "b"), F.lit(None).cast("boolean"), 1)) == ["a"]
    assert one(spark, values.trusted_labels(arr("a"), F.lit(False), 1)) == []
    scores = F.array(F.struct(F.lit("fem").alias("label"), F.lit(0.4).alias("score")), F.struct(F.lit("x").alias("label"), F.lit(0.9).alias("score")))
    assert one(spark, values.voice_confidence(scores, ["fem"])) == 0.4 and one(spark, values.voice_confidence(scores, ["none"])) == 0.0


def test_records(spark):
    assert tuple(one(spark, values.prompt_for(F.lit("Flux"), F.lit(""), F.lit(None), F.lit("t"), F.lit("n")))) == ("n", "natural")
    assert tuple(one(spark, values.prompt_for(F.lit("x"), F.lit(""), F.lit(None), F.lit(""), F.lit("n")))) == ("n", "natural")
    assert one(spark, values.art_key(F.lit(" a "), F.lit(None), F.lit("E"))) == one(spark, values.art_key(F.lit("a"), F.lit(""), F.lit("e ")))
    assert one(spark, values.merged(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3)"))) == {"a": 1, "b": 3}
    assert one(spark, values.same_value(F.lit(1), F.lit("1"))) and one(spark, values.same_value(F.lit(None), F.lit(None))) and not one(spark, values.same_value(F.lit(None), F.lit("")))


def test_prune_citations(spark):
    record = {"a": ["s1", "s9", {"b": "s8"}], "c": "s7", "d": "text", "_warnings": ["old"]}
    got = json.loads(one(spark, values.prune_citations(F.lit(json.dumps(record)), F.array(F.lit("s1")))))
    assert got == {"a": ["s1", {"b": ""}], "c": "", "d": "text", "_warnings": ["old", "3 cited sentence ids were not in the transcript: s7, s8, s9"]}
    for odd in (None, "", "{broken", "[1]"):
        assert one(spark, values.prune_citations(F.lit(odd).cast("string"), F.lit(None).cast("array<string>"))) == odd
