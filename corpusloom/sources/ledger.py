"""An append-only ledger of rulings, and documents that are replaced whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "when string, tag string, verdict string, into string, why string, proposals int, model string, source string"


def append(rows: DataFrame, path: str) -> int:
    """Append rulings as one batch; rows without tag or verdict are left out. Returns how many were written.

    The batch is one Parquet commit with the next number, so a reader sees all
    of it or nothing, and rows keep the order of batches and, within one, of
    ``pos`` (a column, or 0).
    """
    spark = rows.sparkSession
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    pos = F.col("pos").cast("long") if "pos" in rows.columns else F.lit(0).cast("long")
    good = rows.where((F.coalesce("tag", F.lit("")) != "") & (F.coalesce("verdict", F.lit("")) != ""))
    good = good.select(*(F.col(f"`{n}`") if n in rows.columns else F.lit(None).alias(n) for n in names), pos.alias("pos")).selectExpr(*(f"CAST(`{f.split()[0]}` AS {f.split()[1]}) AS `{f.split()[0]}`" for f in SCHEMA.split(", ")), "pos")
    n = good.count()
    if n:
        last = read(spark, path).agg(F.max("batch").alias("b")).first()["b"]
        good.withColumn("batch", F.lit((last or 0) + 1).cast("long")).write.mode("append").parquet(path)
    return n


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rulings with ``batch`` and ``pos``; a ledger that isn't there is empty."""
    schema = f"{SCHEMA}, pos long, batch long".replace("when string", "`when` string")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def standing(rulings: DataFrame, key: F.Column) -> DataFrame:
    """The latest ruling of each key, by batch and place."""
    latest = Window.partitionBy("__key").orderBy(F.desc("batch"), F.desc("pos"))
    return rulings.withColumn("__key", key).withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__key", "__r")


def ordered_json(record: dict[str, Any], first: list[str]) -> str:
    """A record as JSON, the given keys in front in their order and all others by name; JSON is YAML too."""
    keys = [k for k in first if k in record] + sorted(k for k in record if k not in first)
    return json.dumps({k: record[k] for k in keys}, ensure_ascii=False, indent=2) + "\n"


def replace_file(path: str, content: bytes) -> bool:
    """Put a file in place in one step; false, and the file untouched, if it holds the same bytes already."""
    try:
        with open(path, "rb") as f:
            if f.read() == content:
                return False
        mode = os.stat(path).st_mode & 0o777
    except FileNotFoundError:
        mode = 0o644
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".new-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, mode)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return True


def write_documents(docs: DataFrame, first: list[str]) -> DataFrame:
    """``(path, changed)``: each ``docs(path, data)`` written to its path (a folder that all executors share), keys in order; unchanged ones stay as they are."""

    def run(batches):
        for b in batches:
            b["changed"] = [replace_file(p.removeprefix("file:"), ordered_json(json.loads(d), first).encode()) for p, d in zip(b["path"], b["data"], strict=True)]
            yield b[["path", "changed"]]

    return docs.select("path", "data").mapInPandas(run, "path string, changed boolean")
