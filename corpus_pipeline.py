"""A corpus pipeline over the table documents: quality rules, near duplicates, repeated strings, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Every stage takes null ids, languages,
sources and counts as values, null texts as empty, rows that repeat as rows of their own, and an empty table, which gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm import bpe, jaccard, mixing, quality, suffixes
from braidlake.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the boilerplate lines of their source. A null or empty text has no words and goes."""
    verdicts = cut(quality.judged(docs).drop("__t"), "verdicts")
    return quality.kept_rows(docs, verdicts).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows, that of the smallest id (a null id comes last); links: shingles of five words, a similarity of 0.8 or more.

    Rows, not ids, are linked and kept: rows that repeat another or have a null id are copies like any others, and unlike texts of one id are
    documents of their own. A row without words is linked with nothing and stays.
    """
    # a written number tells rows apart
    rows = cut(docs.select(COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard.near_duplicates(rows, id_col="__row", words=5, percent=80).select(F.col("doc_id").alias("__member"), "component_id")
    members = rows.select("__row", "doc_id").join(groups, F.col("__row") == F.col("__member"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    return rows.join(first.select(F.col("first.__row").alias("__kept")), F.col("__row") == F.col("__kept"), "left_semi").select(COLUMNS)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings; a text of which no word is left goes, one that had none to begin with stays; a null text becomes the empty one.

    A removed run may begin or end inside a character of several bytes: what is left of such a character goes as well.
    """
    kept = suffixes.remove_repeats(docs, carry=("lang", "source"))
    text = F.col("kept_text")
    kept = kept.filter((F.col("n_removed") == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; one without words is not taken."""
    mixed = mixing.mix_sources(docs).filter(F.col("copies") > 0).select("unit", F.col("doc_id").alias("__id"), "copies").distinct()
    rows = docs.withColumn("__unit", F.xxhash64("doc_id", "text"))
    rows = rows.join(mixed, (F.col("__unit") == F.col("unit")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return rows.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; a null or empty one has none."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_string_stage),
    ("mixing_sources", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL cannot express the suffix sort's texts, the balanced sample and the encoding: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
