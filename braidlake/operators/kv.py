"""A log of key-value records (key, value, sequence, deleted): reads, writes, compaction, snapshots.

The current record of a key is the one of greatest sequence; a deleted one hides the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compact(records: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The current value of each key."""
    return records.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def load(records: DataFrame) -> DataFrame:
    """(key, value, sequence) of keys that are there now."""
    latest = records.groupBy("key").agg(F.max(F.struct("sequence", "deleted", "value")).alias("r"))
    return latest.filter(~F.col("r.deleted")).select("key", "r.value", "r.sequence")


def point_read(table: DataFrame, key: str, wanted) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return table.filter(F.col(key) == F.lit(wanted))


def prefix_scan(table: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins with ``prefix``, in key order."""
    return table.filter(F.col(key).startswith(prefix)).orderBy(key)


def keyset_page(table: DataFrame, key: str, after, most: int, prefix: str | None = None) -> DataFrame:
    """The first ``most`` rows beyond the key ``after`` (None: from the beginning), in key order, of those with a prefix if one is given."""
    rows = table if after is None else table.filter(F.col(key) > F.lit(after))
    rows = rows.filter(F.col(key).startswith(prefix)) if prefix is not None else rows
    return rows.orderBy(key).limit(most)


def multi_get(table: DataFrame, keys: list, key: str, value: str) -> DataFrame:
    """(pos, asked, value) in the order of ``keys``; null where there is none."""
    kind = dict(table.dtypes)[key]
    asked = table.sparkSession.createDataFrame(list(enumerate(keys)), f"pos long, asked {kind}")
    some = table.filter(F.col(key).isin(list({k for k in keys if k is not None}))) if len(keys) <= 1000 else table
    return asked.join(some.select(F.col(key).alias("__k"), F.col(value).alias("value")), F.col("asked") == F.col("__k"), "left").select("pos", "asked", "value")


def multi_get_bounded(table: DataFrame, keys: list, key: str, value: str, budget: int) -> DataFrame:
    """The first of ``keys`` whose values fit a byte budget together; the first may exceed it. A list of keys is in the driver's memory, so one task numbers it."""
    got = multi_get(table, keys, key, value)
    size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    run = F.sum(size).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return got.withColumn("__run", run).filter((F.col("pos") == 0) | (F.col("__run") <= budget)).drop("__run")


def written(records: DataFrame, batch: DataFrame, first: int) -> DataFrame:
    """``records`` with a batch of mutations (place, key, value, deleted) behind them, numbered from ``first`` by place; of one key in the batch the last counts."""
    new = batch.select("key", "value", (F.col("place") + F.lit(first)).cast("long").alias("sequence"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return records.select("key", "value", "sequence", "deleted").unionByName(new)


def compacted(records: DataFrame, keep_deleted: bool = True) -> DataFrame:
    """The records that an index of current sequences still points at; without ``keep_deleted`` deletions go as well."""
    latest = records.groupBy("key").agg(F.max(F.struct("sequence", "deleted", "value")).alias("r")).select("key", "r.value", "r.sequence", "r.deleted")
    return latest if keep_deleted else latest.filter(~F.col("deleted"))


def dropped_tombstones(segments: DataFrame) -> DataFrame:
    """Records (segment, key, sequence, deleted) without the deletions of keys of which no older record stands in any other segment."""
    older = segments.groupBy(F.col("key").alias("__k")).agg(F.min("sequence").alias("__first"))
    both = segments.join(older, F.col("key") == F.col("__k"))
    return both.filter(~F.col("deleted") | (F.col("__first") < F.col("sequence"))).drop("__k", "__first")


def dead_files(files: DataFrame, records: DataFrame) -> DataFrame:
    """(segment) of files that hold no current record."""
    latest = records.groupBy("key").agg(F.max_by("segment", "sequence").alias("__live"))
    return files.select("segment").distinct().join(latest.select("__live").distinct(), F.col("segment") == F.col("__live"), "left_anti")


def snapshot_head(events: DataFrame) -> DataFrame:
    """Events (sequence, kind, body) that a logical snapshot keeps: the latest schema event and what came after the last snapshot."""
    ends = events.agg(F.max(F.when(F.col("kind") == "schema", F.col("sequence"))).alias("__schema"), F.max(F.when(F.col("kind") == "snapshot", F.col("sequence"))).alias("__snap"))
    # one row of two numbers
    both = events.crossJoin(F.broadcast(ends))
    kept = (F.col("sequence") == F.col("__schema")) | ((F.col("kind") != "schema") & (F.col("sequence") >= F.coalesce("__snap", F.lit(0))))
    return both.filter(kept).select(events.columns)
