"""Libraries of YAML and JSON documents as DataFrames.

Files are listed and read by Spark's ``binaryFile`` source, so any file system
that Spark reaches will do, and parsed where they are read. A record is one
JSON text (``data``) beside the columns that scans filter on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import squeeze, strip_controls

try:
    import yaml
except ImportError:  # JSON libraries can still be read
    yaml = None

#: Spellings of each kind of document.
KINDS = {
    "item": ["item", "file", "episode", "track"],
    "author": ["author", "authors", "person"],
    "config": ["config", "site", "settings", "hypnotica"],
    "tags": ["tags", "tag", "vocabulary", "registry"],
    "transcript": ["transcript", "transcription"],
}
#: Names of files that are configuration whatever they hold.
CONFIG_FILES = ["hypnotica.yaml", "hypnotica.yml"]
#: Fields that a source record and an author record may have.
SOURCE_FIELDS = "apiVersion kind audio title author author_id date description summary tags categories series series_index source_url cover explicit variant provenance duration".split()
AUTHOR_FIELDS = "apiVersion kind id name author url image links language explicit description summary provenance".split()
#: Bytes at the head of a file in which a top-level ``kind:`` saves parsing it.
HEAD = 2048


def files(spark: SparkSession, root: str, pattern: str = "*.y*ml") -> DataFrame:
    """``(path, size, modified, content)`` of all files under a folder whose name fits; hidden ones are skipped. Unused columns are pruned, so a listing reads no content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def parse(text: str) -> list[Any]:
    """All documents of a YAML (or JSON) text; empty ones are left out."""
    if yaml is None:
        return [json.loads(text)]
    return [d for d in yaml.load_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if d is not None]


def kind_of(kind: Column) -> Column:
    """The kind that a spelling names, else empty."""
    k, out = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lit("")
    for name, spellings in KINDS.items():
        out = F.when(k.isin(spellings), name).otherwise(out)
    return out


def _truthy(field: str) -> Column:
    v = F.get_json_object("data", f"$.{field}")
    return F.coalesce(~v.isin("", "false", "0", "[]", "{}"), F.lit(False))


def guess_kind() -> Column:
    """The kind of a record ``(path, data)``: as named, else by file name and fields."""
    named = kind_of(F.get_json_object("data", "$.kind"))
    guess = F.when(F.substring_index("path", "/", -1).isin(CONFIG_FILES), "config").when(_truthy("title") | _truthy("audio"), "item").when(_truthy("name") & ~_truthy("author"), "author").otherwise("")
    return F.when(named != "", named).otherwise(guess)


_RAW = "path string, doc_pos int, entry int, data string, error string"


def records(found: DataFrame) -> DataFrame:
    """``(path, doc_pos, entry, data, error)``: a row per record of ``found(path, content)``; a list is a record each, what isn't a mapping or doesn't parse is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    documents = parse(bytes(content).decode())
                except Exception as e:  # any fault of a file is its own row
                    rows.append((path, 1, 1, None, f"invalid document: {str(e).splitlines()[0] if str(e) else type(e).__name__}"))
                    continue
                for pos, doc in enumerate(documents, 1):
                    for k, entry in enumerate(doc if isinstance(doc, list) else [doc], 1):
                        good = isinstance(entry, dict)
                        rows.append((path, pos, k, json.dumps(entry, default=str, ensure_ascii=False) if good else None, None if good else "expected a mapping"))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _RAW.split(", ")])

    return found.select("path", "content").mapInPandas(run, _RAW)


def documents(spark: SparkSession, root: str, *kinds: str) -> DataFrame:
    """``(path, kind, data)`` of single documents of the wanted kinds (all, if none is named); unreadable ones are left out. Files whose head names another kind are not parsed."""
    found = files(spark, root)
    if kinds:
        head = F.decode(F.substring(F.col("content"), 1, HEAD), "UTF-8")
        stated = F.regexp_extract(head, r"(?m)^kind:[ \t]*[\"']?([^\"'\r\n]*)", 1)
        found = found.where((kind_of(stated) == "") | kind_of(stated).isin(*kinds))
    read = records(found).where("error IS NULL AND doc_pos = 1 AND entry = 1").withColumn("kind", guess_kind())
    return (read.where(F.col("kind").isin(*kinds)) if kinds else read).select("path", "kind", "data")


def optional(spark: SparkSession, root: str, pattern: str = "*.y*ml") -> DataFrame:
    """``(path, data)`` where an absent or broken document is an empty mapping."""
    return records(files(spark, root, pattern)).where("doc_pos = 1 AND entry = 1").select("path", F.coalesce("data", F.lit("{}")).alias("data"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file without comments and blanks."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")


def _missing(fields: list[str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.get_json_object("data", f"$.{f}"), F.lit(""))) == "", f) for f in fields)))


def source_report(raw: DataFrame, slug: Column) -> dict[str, DataFrame]:
    """``sources``, ``authors``, ``errors`` and ``warnings`` of records; ``slug``: the id of an author column ``author``.

    The first record, by path and place, that names an audio file keeps it;
    later ones are errors. Titles that repeat for an author under one variant
    are warnings.
    """
    where = F.concat(F.substring_index("path", "/", -1), F.when(F.col("doc_pos") > 1, F.concat(F.lit(" ["), F.col("doc_pos").cast("string"), F.lit("]"))).otherwise(""))
    raw = raw.withColumn("place", where)
    own = raw.where("error IS NULL").withColumn("is_author", F.lower(F.trim(F.coalesce(F.get_json_object("data", "$.kind"), F.lit("")))) == "author")
    field = lambda f: F.coalesce(F.get_json_object("data", f"$.{f}"), F.lit(""))
    unknown = lambda known: F.array_sort(F.array_except(F.json_object_keys("data"), F.array(*map(F.lit, known))))

    named = own.where("is_author").withColumn("author", F.trim(F.coalesce(F.nullif(field("name"), F.lit("")), field("author"))))
    authors = named.where("author <> ''").withColumn("id", F.coalesce(F.nullif(F.trim(field("id")), F.lit("")), slug))
    ordered = lambda *by: Window.partitionBy(*by).orderBy("path", "doc_pos", "entry")
    authors = authors.withColumn("nth", F.row_number().over(ordered("id")))

    rest = own.where("NOT is_author").withColumn("missing", _missing(["audio", "title", "author"]))
    whole = rest.where(F.size("missing") == 0).select("*", field("audio").alias("audio"), F.trim(strip_controls(field("title"))).alias("title"), F.trim(strip_controls(field("author"))).alias("author"), F.trim(field("variant")).alias("variant"))
    whole = whole.withColumns({"author_id": F.coalesce(F.nullif(F.trim(field("author_id")), F.lit("")), slug), "nth": F.row_number().over(ordered("audio")), "holder": F.first("place").over(ordered("audio"))})
    sources = whole.where("nth = 1").select("path", "place", "audio", "title", "author", "author_id", "variant", "data")

    said = lambda df, text: df.select("place", text.alias("message"))
    errors = said(raw.where("error IS NOT NULL"), F.col("error")).unionAll(said(named.where("author = ''"), F.lit("author record has no name")))
    errors = errors.unionAll(said(rest.where(F.size("missing") > 0), F.concat(F.lit("missing "), F.array_join("missing", ", ")))).unionAll(said(whole.where("nth > 1"), F.concat(F.lit("audio already claimed by "), F.col("holder"))))
    odd = whole.select("place", unknown(SOURCE_FIELDS).alias("u"), F.lit("unrecognised field(s) ").alias("w")).unionAll(authors.select("place", unknown(AUTHOR_FIELDS).alias("u"), F.lit("unrecognised author field(s) ").alias("w")))
    warnings = said(odd.where(F.size("u") > 0), F.concat("w", F.array_join("u", ", "))).unionAll(said(authors.where("nth > 1"), F.concat(F.lit("a second author record for "), F.col("id"))))
    again = sources.groupBy("author_id", "title", "variant").count().where("count > 1")
    repeated = F.concat(F.lit('repeated title "'), F.col("title"), F.lit('"'), F.when(F.col("variant") != "", F.concat(F.lit(' under the same variant "'), F.col("variant"), F.lit('"'))).otherwise(""))
    warnings = warnings.unionAll(again.select(F.col("author_id").alias("place"), repeated.alias("message")))
    last = authors.withColumn("left", F.count("*").over(Window.partitionBy("id")) - F.col("nth")).where("left = 0")
    return {"sources": sources, "authors": last.select("id", F.col("author").alias("name"), "data"), "errors": errors, "warnings": warnings}


def mapping(spark: SparkSession, now: str, old: str | None = None) -> DataFrame:
    """``(author, tag, verdict, to)`` of mapping files ``<author>.yaml``: the last row of a tag wins; an author's file in ``now`` hides that in ``old``."""
    rows = optional(spark, now).withColumn("age", F.lit(0))
    if old is not None:
        rows = rows.unionAll(optional(spark, old).withColumn("age", F.lit(1)))
    rows = rows.withColumn("author", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    newest = rows.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy("age", "path"))).where("r = 1")
    each = newest.select("author", F.posexplode(F.from_json(F.get_json_object("data", "$.mapping"), "array<struct<tag: string, verdict: string, to: string>>")).alias("pos", "m"))
    return each.where("m.tag <> ''").groupBy("author", F.col("m.tag").alias("tag")).agg(F.max_by("m", "pos").alias("m")).select("author", "tag", "m.verdict", "m.to")


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, state)`` of two listings ``(path, size, modified)``: new, changed or gone; files that are the same are left out."""
    a, b = before.select("path", F.struct("size", "modified").alias("was")), now.select("path", F.struct("size", "modified").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state IS NOT NULL")


def titles(data: DataFrame) -> DataFrame:
    """``(path, title, author)`` of item records."""
    return data.where("kind = 'item'").select("path", squeeze(F.get_json_object("data", "$.title")).alias("title"), squeeze(F.get_json_object("data", "$.author")).alias("author"))
