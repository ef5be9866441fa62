"""Edits of a registry and merges of duplicates against fixed cases and plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import merging, registry
from corpusloom.operators.registry import EditError, Registry

KINDS = {"content": "", "voice": "Voice", "warning": "CW"}
REG = Registry(KINDS, {"Rope": "cord", "Silk": "cloth", "CW: Blood": "red", "Voice: fem": "high"})
ITEMS = "id long, tags array<string>, added array<string>, proposals array<struct<tag:string,why:string>>"


def edits(*rows):
    return [dict(zip(("action", "tag", *r[2::2]), (r[0], r[1], *r[3::2]), strict=True)) for r in rows]


def test_plan_follows_names():
    p = registry.plan(REG, edits(("rename", "rope", "to", "Cord"), ("merge", "Cord", "into", "silk"), ("add", "Knot", "description", "tie"), ("rename", "knot", "to", "Bow")), "2024-01-01")
    assert p.changes == {"Rope": "Silk", "Cord": "Silk", "Knot": "Bow"} and p.accept == {"knot": "Bow"}
    assert sorted(p.registry.meanings) == ["Bow", "CW: Blood", "Silk", "Voice: fem"] and p.registry.meanings["Bow"] == "tie"
    assert sorted(REG.meanings) == ["CW: Blood", "Rope", "Silk", "Voice: fem"]
    assert [r["verdict"] for r in p.rulings] == ["rework", "merge", "approve", "rework"] and p.steps[1] == {"action": "merge", "tag": "Cord", "target": "Silk"}
    assert p.registry.known("blood") == "CW: Blood" and p.registry.known("rope") == ""


@pytest.mark.parametrize("bad", [
    ("add", "rope", "description", "x"), ("add", "Knot"), ("add", "CWW: Knot", "description", "x"), ("describe", "Knot", "description", "x"), ("describe", "rope"), ("remove", "Knot"),
    ("rename", "rope", "to", "silk"), ("rename", "rope", "to", " "), ("rename", "rope", "to", "Odd: x"), ("merge", "rope", "into", "ROPE"), ("merge", "rope", "into", "Knot"), ("explode", "rope"), ("remove", "rope", "sort", "x"),
])
def test_bad_edits(bad):
    with pytest.raises(EditError, match="edit 2"):
        registry.plan(REG, edits(("describe", "silk", "description", "y"), bad), "2024-01-01")


def test_about_and_block():
    r = REG.describe_kind("Voice:", " who speaks ")
    assert r.block() == "content:\n  Rope: cord\n  Silk: cloth\nvoice: who speaks\n  Voice: fem: high\nwarning:\n  CW: Blood: red"
    assert r.describe_kind("voice", "").about == {}
    with pytest.raises(EditError):
        REG.describe_kind("nothing", "x")


def test_rewrite_items(spark):
    p = registry.plan(REG, edits(("merge", "rope", "into", "silk"), ("remove", "blood", "why", "rare"), ("add", "Knot", "description", "tie")), "2024-01-01")
    rows = [
        (1, ["ROPE", "Silk", "x"], ["x", "rope"], [("knot", "w"), ("rope", "w"), ("y", "w")]), (2, ["CW: Blood"], [], None), (3, ["cw blood", "x"], None, [("CW: BLOOD", "w")]),
        (4, ["x", "x"], None, []), (5, None, None, None), (6, ["Knot"], None, [("Knot", "w"), (None, None)]),
    ]
    got = {r["id"]: r for r in registry.rewrite_items(spark.createDataFrame(rows, ITEMS), p).collect()}
    see = lambda i: (got[i]["tags"], got[i]["added"], [tuple(w) for w in got[i]["proposals"]], got[i]["touched"], got[i]["granted"], got[i]["requeued"])
    assert see(1) == (["Silk", "x", "Knot"], ["Silk", "x"], [("Silk", "w"), ("y", "w")], True, 1, 0)
    assert see(2) == ([], [], [("CW: Blood", "removed from the registry on 2024-01-01: rare")], True, 0, 1)
    assert see(3) == (["x"], [], [("CW: BLOOD", "w")], True, 0, 0)
    assert see(4) == (["x", "x"], [], [], False, 0, 0) and see(5) == ([], [], [], False, 0, 0)
    assert see(6) == (["Knot"], [], [(None, None)], True, 0, 0)
    empty = registry.rewrite_items(spark.createDataFrame([], ITEMS), registry.plan(REG, [], "2024-01-01"))
    assert empty.count() == 0


def test_rewrite_maps(spark):
    p = registry.plan(REG, edits(("rename", "rope", "to", "Cord"), ("remove", "silk"), ("add", "Knot", "description", "tie")), "2024-01-01")
    rows = spark.createDataFrame([("a", "rope"), ("b", "SILK"), ("c", "other"), ("d", ""), ("e", None)], "tag string, to string")
    got = {r["tag"]: (r["to"], r["retired_on"], r["retired_why"]) for r in registry.rewrite_mapping(rows, p).collect()}
    assert got == {"a": ("Cord", None, None), "b": ("SILK", "2024-01-01", "removed from the registry on 2024-01-01"), "c": ("other", None, None), "d": ("", None, None), "e": (None, None, None)}
    pending = spark.createDataFrame([("rope",), ("silk",), ("knot",), ("z",)], "tag string")
    assert sorted(r["tag"] for r in registry.rewrite_pending(pending, p).collect()) == ["Cord", "z"]


def test_rulings(spark):
    rulings = [
        {"tag": "tie", "verdict": "rework", "name": "Knot", "description": "a tie"}, {"tag": "bad", "verdict": "omit"}, {"tag": "silk", "verdict": "omit"}, {"tag": "cord", "verdict": "merge", "merge_into": "rope"},
        {"tag": "odd", "verdict": "approve", "name": "Nope: x", "description": "d"}, {"tag": "odd", "verdict": "omit"},
    ]
    reg, decided, refused = registry.adjudicate(REG, rulings)
    assert decided == {"tie": "Knot", "bad": "", "silk": "Silk", "cord": "Rope", "odd": ""} and reg.known("knot") == "Knot" and len(refused) == 1
    with pytest.raises(EditError, match="unregistered"):
        registry.adjudicate(REG, [{"tag": "a", "verdict": "merge", "merge_into": "zzz"}])
    rows = [(1, ["bad", "x"], ["bad", "x"], [("tie", "w"), (" bad ", "w"), ("free", "w")]), (2, ["Rope"], ["Rope"], [("cord", "w")]), (3, ["x"], None, None)]
    got = {r["id"]: r for r in registry.apply_rulings(spark.createDataFrame(rows, ITEMS), decided).collect()}
    assert (got[1]["tags"], got[1]["added"], got[1]["gained"], got[1]["dropped"], [w["tag"] for w in got[1]["proposals"]]) == (["x", "Knot"], ["Knot", "x"], ["Knot"], ["bad"], ["free"])
    assert got[2]["tags"] == ["Rope"] and got[2]["proposals"] == [] and got[2]["ruled"] and not got[3]["ruled"]


def _plain(group, fold, chosen=()):
    """A merge in plain Python, straight from the rules."""
    size = lambda x: len(x or ())
    rich = lambda r: (bool(r["source_url"]), size(r["spoilers"]), size(r["description"]), size(r["tags"]), size(r["summary"]))
    unnumbered = lambda r: "-" not in r["path"]
    url = lambda r: (r["source_url"] or "").rstrip("/").count("/") > 2
    title = lambda r: (True, len(r["title"] or "") < 10, " " in (r["title"] or ""), "_" not in (r["title"] or ""), size(r["title"]))
    res = lambda r: (url(r), *title(r), bool(r["series"]), bool(r["source_url"]), unnumbered(r), size(r["spoilers"]), size(r["tags"]), size(r["description"]))
    by_path = sorted(group, key=lambda r: r["path"])
    ranked = sorted(by_path, key=rich if fold else res, reverse=True)
    keep = ranked[0]
    for wanted in [lambda r: r["path"] in chosen, *([unnumbered] if fold else [])]:
        keep = next((r for r in by_path if wanted(r)), keep)
    line = ranked if fold else [keep, *(r for r in ranked if r is not keep)]
    out = {f: next((r[f] for r in line if r[f]), line[0][f]) for f in ("description", "summary", "series", "source_url")}
    if not fold:
        out |= {f: keep[f] or None for f in ("series", "source_url")}
    out |= {f: keep[f] or (line[0][f] if fold else None) for f in ("id", "title")}
    out["tags"] = list(dict.fromkeys(t for r in line for t in r["tags"] or () if t))
    told = [keep, *(r for r in sorted(by_path, key=rich, reverse=True) if r is not keep)]
    out["provenance"] = {k: next(r["provenance"][k] for r in told if (r["provenance"] or {}).get(k)) for k in {k for r in told for k, v in (r["provenance"] or {}).items() if v}}
    gave = {f: [r for r in group if r[f] == out[f]] for f in ("description", "summary", "title")}
    out["generated"] = sorted(f for f, rs in gave.items() if rs and all(f in (r["generated"] or ()) for r in rs))
    return keep["path"], out


@pytest.mark.parametrize("fold", [False, True])
def test_merge_against_plain(spark, fold):
    rng = random.Random(5)
    some = lambda *xs: rng.choice(xs)
    rows = []
    for i in range(240):
        rows.append({
            "group": some(*"abcdefghijklmnopqrstuvwxyz", None), "path": f"p{i:03d}{some('', '-1')}", "id": f"i{i}", "title": some("One two", "Three", "a_b", ""), "series": some("", "s"), "source_url": some("", "http://x/", "http://x/y/z"),
            "description": some("", None, "long text", "txt"), "summary": some("", "s1", "s22"), "tags": some(["a", "b"], ["c", "a"], [], None), "categories": [], "spoilers": some([], None, ["x"], ["x", "y"]),
            "generated": some(["description"], ["summary", "description", "title"], [], None), "provenance": some({"k": "v1"}, {"k": "", "m": "v2"}, {}, None),
        })
    schema = "group string, path string, id string, title string, series string, source_url string, description string, summary string, tags array<string>, categories array<string>, spoilers array<string>, generated array<string>, provenance map<string,string>"
    df = spark.createDataFrame(rows, schema)
    chosen = ["p017", "p018-1", "p030", "p044"]
    kept = merging.survivors(df, fold=fold, chosen=F.col("path").isin(chosen))
    got = {r["group"]: r for r in merging.merge_groups(df, kept, fold=fold).collect()}
    groups = {g: [r for r in rows if r["group"] == g] for g in {r["group"] for r in rows} - {None}}
    groups = {g: rs for g, rs in groups.items() if len(rs) > 1}
    assert set(got) == set(groups)
    for g, rs in groups.items():
        path, want = _plain(rs, fold, chosen)
        assert got[g]["path"] == path
        for f in ("id", "title", "description", "summary", "series", "source_url", "tags"):
            assert (got[g][f] or None) == (want[f] or None), (g, f)
        assert (got[g]["provenance"] or {}) == want["provenance"]
        if want["title"] and want["description"] and want["summary"]:
            assert [f for f in got[g]["generated"] if f in ("description", "summary", "title")] == want["generated"]
    lost = merging.lineage(df, kept)
    assert lost.count() == sum(len(rs) - 1 for rs in groups.values())
