"""Document libraries, the ledger and replaced files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import slug, word_fold
from corpusloom.sources import documents as docs
from corpusloom.sources import ledger

pytest.importorskip("yaml")


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    at = tmp_path_factory.mktemp("library")
    made = {
        "a/one.yaml": "kind: Episode\ntitle: One\nauthor: Ann\naudio: x.mp3\n",
        "a/two.yml": "title: Two\naudio: y.mp3\nauthor: Ann\nextra: 1\n",
        "b/ann.yaml": "kind: person\nname: Ann\n",
        "b/bob.yaml": "name: Bob\n",
        "b/words.yaml": "kind: 'vocabulary'\ntitle: not an item\n",
        "broken.yaml": "a: [1\n",
        "hypnotica.yml": "x: 1\n",
        ".hidden.yaml": "title: hidden\n",
        "notes.txt": "# c\n\n one \ntwo\n",
    }
    for name, text in made.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_text(text)
    return str(at)


def names(df):
    return sorted((r["path"].rpartition("/")[2], r["kind"]) for r in df.collect())


def test_scan_by_kind(spark, library):
    assert names(docs.documents(spark, library)) == [("ann.yaml", "author"), ("bob.yaml", "author"), ("hypnotica.yml", "config"), ("one.yaml", "item"), ("two.yml", "item"), ("words.yaml", "tags")]
    assert names(docs.documents(spark, library, "item")) == [("one.yaml", "item"), ("two.yml", "item")]
    assert names(docs.documents(spark, library, "author", "tags")) == [("ann.yaml", "author"), ("bob.yaml", "author"), ("words.yaml", "tags")]
    assert {r["data"] for r in docs.optional(spark, library).where("path LIKE '%broken%'").collect()} == {"{}"}
    assert sorted(r["line"] for r in docs.lines(spark, f"{library}/notes.txt").collect()) == ["one", "two"]
    assert sorted(r["title"] for r in docs.titles(docs.documents(spark, library)).collect()) == ["One", "Two"]


def test_source_report(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(
        "audio: 1.mp3\ntitle: 'A\\tB'\nauthor: Ann\nodd: 1\n---\n- {audio: 2.mp3, title: T, author: Ann}\n- {audio: 3.mp3, title: T, author: Ann}\n- {audio: 4.mp3, title: T, author: Ann, variant: v}\n- {audio: 1.mp3, title: U, author: Ann}\n- 7\n---\ntitle: only\n---\nkind: Author\nname: Ann\n---\nkind: author\nname: Ann\n---\nkind: author\n"
    )
    (tmp_path / "z.yaml").write_text("a: [1\n")
    got = docs.source_report(docs.records(docs.files(spark, str(tmp_path))), slug("author"))
    assert sorted(r["audio"] for r in got["sources"].collect()) == ["1.mp3", "2.mp3", "3.mp3", "4.mp3"]
    assert {r["title"] for r in got["sources"].where("audio = '1.mp3'").collect()} <= {"A B", "A\\tB"}
    assert [(r["id"], r["name"]) for r in got["authors"].collect()] == [("ann", "Ann")]
    errors = sorted(r["place"] + ": " + r["message"].split(":")[0] for r in got["errors"].collect())
    assert errors == ["s.yaml [2]: audio already claimed by s.yaml", "s.yaml [2]: expected a mapping", "s.yaml [3]: missing audio, author", "s.yaml [6]: author record has no name", "z.yaml: invalid document"]
    warnings = sorted(r["place"] + ": " + r["message"] for r in got["warnings"].collect())
    assert warnings == ['ann: repeated title "T"', "s.yaml [5]: a second author record for ann", "s.yaml: unrecognised field(s) odd"]


def test_mapping(spark, tmp_path):
    for folder, name, text in (("now", "ann", "mapping:\n- {tag: calm, verdict: map, to: A}\n- {tag: calm, verdict: map, to: B}\n- {verdict: drop}\n"), ("old", "ann", "mapping: [{tag: calm, verdict: drop}]"), ("old", "bob", "mapping: [{tag: x, verdict: drop}]")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.yaml").write_text(text)
    got = docs.mapping(spark, str(tmp_path / "now"), str(tmp_path / "old")).collect()
    assert sorted(map(tuple, got), key=str) == [("ann", "calm", "map", "B"), ("bob", "x", "drop", None)]


def test_changed_files(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.yaml").write_text(n)
    before = docs.files(spark, str(tmp_path)).drop("content").toPandas()
    os.remove(tmp_path / "a.yaml")
    (tmp_path / "b.yaml").write_text("bb")
    (tmp_path / "d.yaml").write_text("d")
    got = docs.changed(spark.createDataFrame(before), docs.files(spark, str(tmp_path))).collect()
    assert sorted((r["path"][-6:], r["state"]) for r in got) == [("a.yaml", "gone"), ("b.yaml", "changed"), ("d.yaml", "new")]


def test_ledger(spark, tmp_path):
    at = f"{tmp_path}/ledger"
    assert ledger.read(spark, at).count() == 0
    rows = spark.createDataFrame([("2024-01-01", "Calm", "map", "A", 0), ("2024-01-01", "calm ", "drop", None, 1), ("2024-01-01", "", "map", "B", 2), ("2024-01-01", "x", None, "B", 3)], "`when` string, tag string, verdict string, `into` string, pos long")
    assert ledger.append(rows, at) == 2 and ledger.append(rows.limit(0), at) == 0
    assert ledger.append(spark.createDataFrame([("calm", "map", "C")], "tag string, verdict string, `into` string"), at) == 1
    assert ledger.read(spark, at).count() == 3
    now = ledger.standing(ledger.read(spark, at), word_fold("tag")).collect()
    assert [(r["tag"], r["into"], r["batch"]) for r in now] == [("calm", "C", 2)]


def test_replaced_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/n/x.yaml", '{"z": 1, "id": "é", "a": [1]}')], "path string, data string")
    assert [r["changed"] for r in ledger.write_documents(rows, ["id"]).collect()] == [True]
    text = (tmp_path / "n" / "x.yaml").read_text()
    assert text.index('"id"') < text.index('"a"') < text.index('"z"') and docs.parse(text) == [{"id": "é", "a": [1], "z": 1}]
    os.utime(tmp_path / "n" / "x.yaml", (1, 1))
    assert [r["changed"] for r in ledger.write_documents(rows, ["id"]).collect()] == [False]
    assert os.stat(tmp_path / "n" / "x.yaml").st_mtime == 1 and os.listdir(tmp_path / "n") == ["x.yaml"]
    back = docs.documents(spark, str(tmp_path))
    assert back.select(F.get_json_object("data", "$.id")).first()[0] == "é"
