"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

Every operator that needs a result twice, or that must cut lineage, writes it
here as Parquet: files in the shared folder outlive the executor that wrote
them. A machine-local folder is used only where the setting is absent (tests).
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: What goes to a Python worker at once, the same for all operators: rows, and bytes, which bound it when texts are long.
ARROW_ROWS, ARROW_BYTES = 2048, 4 << 20

_live: list[Scratch] = []
_own: list[str] = []


def bounded(spark: SparkSession) -> None:
    """Bound the batches of Python workers. All operators set the same bounds, so a lazy frame has them whatever ran since."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own where none is named, which only a local master can read back."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return _own[0]


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete a write's shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """A folder of staged tables that belong to one operator run."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.uri = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        bounded(spark)
        _live.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.uri}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads it back."""
        at = self.path(name)
        with _shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df: DataFrame) -> None:
        """Remove a staged table that nothing reads any more."""
        for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if at.startswith(self.uri) or self.uri.replace("file://", "file:") in at:
                self._delete(at)

    def clear(self) -> None:
        self._delete(self.uri)
        if self in _live:
            _live.remove(self)

    def _delete(self, at: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def opened(into: list[Scratch]) -> Iterator[None]:
    """Put the folders that are opened meanwhile into a list."""
    before = set(map(id, _live))
    try:
        yield
    finally:
        into += [s for s in _live if id(s) not in before]


def release() -> None:
    """Remove all staged tables of this process; only for callers that have written all results."""
    for s in list(_live):
        s.clear()


def _at_exit() -> None:
    for s in list(_live):
        try:
            s.clear()
        except Exception:  # the session is gone already
            return


atexit.register(_at_exit)
