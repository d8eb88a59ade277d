"""Versioned inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (key, column, value, generation, millis, logical, node)."""
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("long")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("event_type").alias("column"), "value", week.alias("generation"),
        F.unix_millis("ts").alias("millis"), F.col("event_id").alias("logical"), (F.col("event_id") % 3).alias("node"),
    )


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(spark, sf_dir).filter((F.col("column") == "error") & (F.col("logical") % 50 == 0)).select("key", "generation", "millis", "logical", "node")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, sequence, size) with gaps: every 97th sequence is missing."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("origin"), "event_id", F.length("props").cast("long").alias("size"))
    rows = rows.withColumn("sequence", F.row_number().over(Window.partitionBy("origin").orderBy("event_id")).cast("long"))
    return rows.filter(F.col("sequence") % 97 != 0).drop("event_id")


EDITS = """edits AS (SELECT user_id AS key, event_type AS col, value, floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7.0)::BIGINT AS generation,
    (epoch_us(ts) // 1000)::BIGINT AS millis, event_id AS logical, event_id % 3 AS node FROM events),
floors AS (SELECT key, max(generation) AS floor FROM edits WHERE col = 'error' AND logical % 50 = 0 GROUP BY 1),
live AS (SELECT e.* FROM edits e LEFT JOIN floors f USING (key) WHERE f.floor IS NULL OR e.generation > f.floor)"""
LOG = """log AS (SELECT origin, sequence, size FROM (SELECT user_id % 5 AS origin, length(props)::BIGINT AS size,
    row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id)::BIGINT AS sequence FROM events) WHERE sequence % 97 <> 0)"""
