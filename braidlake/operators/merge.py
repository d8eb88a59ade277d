"""State merge of versioned cells.

Cells are rows (key, column, value, generation, millis, logical, node); tombstones are (key, generation, millis, logical, node). Incarnations
stay apart at rest and fold when read, so deletion floors are known before anything merges and the result does not depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSION = ("millis", "logical", "node")


def version():
    return F.struct(*VERSION)


def floors(tombstones: DataFrame) -> DataFrame:
    """(key, floor): the highest deleted generation of each key."""
    return tombstones.groupBy("key").agg(F.max("generation").alias("floor"))


def deduplicated_tombstones(tombstones: DataFrame) -> DataFrame:
    """One tombstone (key, generation, millis, logical, node) for each deleted generation: the one of greatest version."""
    best = tombstones.groupBy("key", "generation").agg(F.max(version()).alias("v"))
    return best.select("key", "generation", "v.*")


def live_cells(cells: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Cells above their key's floor."""
    low = floors(tombstones).withColumnRenamed("key", "__key")
    return cells.join(low, F.col("key") == F.col("__key"), "left").filter(F.col("floor").isNull() | (F.col("generation") > F.col("floor"))).drop("__key", "floor")


def merge(cells: DataFrame, tombstones: DataFrame, strict: bool = False) -> DataFrame:
    """(key, column, value, generation) by last writer within the highest live generation; minimum and maximum fold over all live ones.

    With ``strict``, two values under the winning version of a cell are corrupt state and raise.
    """
    if strict:
        same = cells.groupBy("key", "column", "generation", *VERSION).agg(F.min("value").alias("__low"), F.max("value").alias("value"))
        clash = F.raise_error(F.concat(F.lit("corrupt: two values under one version of "), F.col("column"))).cast(cells.schema["value"].dataType)
        cells = same.withColumn("value", F.when(F.col("__low").eqNullSafe(F.col("value")), F.col("value")).otherwise(clash))
    # one row for each cell and generation first; then all rows of a key meet once, and with them its floor
    best = F.max(F.struct(version().alias("version"), "value")).alias("best")
    per = cells.groupBy("key", "column", "generation").agg(best, F.min("value").alias("low"), F.max("value").alias("high"))
    both = per.withColumn("floor", F.lit(None).cast("long")).unionByName(floors(tombstones).withColumn("floor", F.col("floor").cast("long")), allowMissingColumns=True)
    own = Window.partitionBy("key")
    live = both.withColumn("floor", F.max("floor").over(own)).filter(F.col("best").isNotNull() & (F.col("floor").isNull() | (F.col("generation") > F.col("floor"))))
    live = live.withColumn("winner", F.max("generation").over(own))
    value = F.max(F.when(F.col("generation") == F.col("winner"), F.struct("best.version", "best.value"))).alias("won")
    folded = live.groupBy("key", "column").agg(value, F.min("low").alias("low"), F.max("high").alias("high"), F.max("winner").alias("generation"))
    return folded.select("key", "column", F.col("won.value").alias("value"), "low", "high", "generation")


def conflicts(cells: DataFrame) -> DataFrame:
    """Cells with different values under one version: corrupt state."""
    return cells.groupBy("key", "column", "generation", *VERSION).agg(F.count_distinct("value").alias("values")).filter("values > 1")


def patch(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that make ``before`` into ``after``: key, change (added, updated, removed) and the new values."""
    old = before.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__old"))
    new = after.select(key, *columns, F.lit(True).alias("__new"))
    both = new.join(old, F.col(key) == F.col("__k"), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~same, "updated")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(F.coalesce(F.col(key), F.col("__k")).alias(key), "change", *columns)


def watermark(cells: DataFrame) -> DataFrame:
    """The greatest version."""
    return cells.agg(F.max(version()).alias("v")).select("v.*")


def carry_versions(before: DataFrame, after: DataFrame, stamp) -> DataFrame:
    """After a migration: unchanged cells keep their version, changed ones get ``stamp``, vanished ones become tombstones."""
    old = before.select(F.col("key").alias("__k"), F.col("column").alias("__c"), F.col("value").alias("__v"), F.col("version").alias("__version"))
    both = after.select("key", "column", "value", F.lit(True).alias("__new")).join(old, (F.col("key") == F.col("__k")) & (F.col("column") == F.col("__c")), "full")
    kept = F.col("__new").isNotNull() & F.col("__version").isNotNull() & F.col("value").eqNullSafe(F.col("__v"))
    return both.select(
        F.coalesce("key", "__k").alias("key"), F.coalesce("column", "__c").alias("column"), "value",
        F.when(kept, F.col("__version")).otherwise(stamp).alias("version"), F.col("__new").isNull().alias("deleted"),
    )
