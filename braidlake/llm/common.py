"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Arrow batches that go to Python workers, unless the session sets its own: texts are long, so bytes bound a batch, not rows alone.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="braidlake-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    This cuts lineage: executors can be lost afterwards without repeating what came before, and the shuffle files of
    the finished step are released. ``discard`` deletes the table when no later step reads it; else it goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/braidlake-{uuid.uuid4().hex}/{name}"
    # the step runs once, here: its shuffle files can go as soon as it has ended
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _written[path] = spark
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for path in (t.__dict__.get("_cut_path") for t in tables if t is not None):
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it, once for each application; bound the batches that they get."""
    context = spark.sparkContext
    for name, value in BATCHES.items():
        if not spark._jsparkSession.sessionState().conf().contains(name):
            spark.conf.set(name, value)
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="braidlake-")
    with zipfile.ZipFile(os.path.join(folder, "braidlake.zip"), "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(os.path.join(folder, "braidlake.zip"))


def tidy(run):
    """An Arrow function that gives memory back when its task ends: workers wait for further tasks and would keep their peak."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def _delete_written() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)


atexit.register(_delete_written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Column: number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hex_fraction(digest):
    """Column: the first 13 hexadecimal digits of a digest as a number in (0, 1)."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
