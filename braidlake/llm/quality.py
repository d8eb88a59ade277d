"""Quality rules with cross-document line frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import n_words

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The base rules: at least so many words, and at most this share of them in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is boilerplate of its host when more distinct documents than this hold it, however large the host is. The count is that
#: of published line-level deduplication (lines seen more than 6 times go); it was not chosen from the tables here.
LINE_LIMIT = 6
#: A document is depleted when fewer words than this share are left without boilerplate lines.
MIN_LEFT_PERCENT = 50
VERDICT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"__words": words, "__lines": lines})
    # a window's hash is taken from its three words; equal windows of one text are found by sorting (hash, place)
    df = df.withColumn(
        "__windows",
        F.when(
            F.size("__words") >= 3,
            F.transform(F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("__repeats", F.size("__windows") > F.size(F.array_distinct("__windows")))
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(F.col("__repeats"), placed))
    same = lambda x, at: F.coalesce(F.get("__sorted", at)["h"] == x["h"], F.lit(False))
    twice = F.filter("__sorted", lambda x, i: same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(F.lit(False)))
    df = df.withColumn("__starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    # a window covers three words; of neighbours that overlap only the part beyond the one before counts
    covered = F.aggregate(
        F.transform("__starts", lambda s, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), s - F.get("__starts", i - 1)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("__repeats"), covered).otherwise(F.lit(0)).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__words", "__lines", "__windows", "__repeats", "__sorted", "__starts")


def normal_line(line):
    """Column: a line in lower case with its runs of white space made single and cut off at both ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def host_hash(host_col: str):
    """Column: a hash of the host; null is a host."""
    return F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\x00null")))


def line_verdicts(docs: DataFrame, host_col: str, id_col: str = "doc_id", text_col: str = "text", line_docs: int = LINE_LIMIT) -> DataFrame:
    """What boilerplate lines hold, for each document with any: (__doc, __host, __text, removed_words, removed_lines).

    Lines are compared by a hash of their normal form within a host (null is a host). A line's documents are counted as
    distinct texts, so exact copies alone never make their own lines boilerplate. The document of smallest id keeps the
    line, so no content is lost from the host altogether. ``removed_lines`` are places in the text split at line ends, from 0.
    Boilerplate is a line of more documents than ``line_docs``.
    """
    rows = docs.select(
        F.col(id_col).alias("__doc"),
        host_hash(host_col).alias("__host"),
        F.xxhash64(F.col(text_col)).alias("__text"),
        F.split(F.col(text_col), "\n").alias("__lines"),
    )
    lines = rows.select("__doc", "__host", "__text", F.posexplode("__lines").alias("__at", "__line")).filter(F.col("__line").rlike(r"[^\x20\x09-\x0D]"))
    lines = lines.select(
        "__doc", "__host", "__text", "__at", F.xxhash64("__host", normal_line(F.col("__line"))).alias("__key"), n_words(F.col("__line")).alias("__w")
    )
    over = (
        lines.groupBy("__host", "__key", "__text").agg(F.min("__doc").alias("__first"))
        .groupBy("__host", "__key").agg(F.count(F.lit(1)).alias("__n"), F.min("__first").alias("__first"))
        .filter(F.col("__n") > line_docs)
    )
    over = over.select(F.col("__key").alias("__over"), "__first")
    # rows that repeat a document have its lines once
    return (
        lines.join(over, F.col("__key") == F.col("__over"))
        .filter(~F.col("__doc").eqNullSafe(F.col("__first")))
        .select("__doc", "__host", "__text", "__at", "__w").distinct()
        .groupBy("__doc", "__host", "__text").agg(F.sum("__w").alias("removed_words"), F.collect_set("__at").alias("removed_lines"))
    )


def without_lines(text, removed):
    """Column: a text without the lines at the places ``removed``; all of it where that is null."""
    joined = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed), lambda i: F.get(lines, i)), "\n")
    return F.when(removed.isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n")), joined), 0))


def judged(
    docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", line_docs: int = LINE_LIMIT
) -> DataFrame:
    """The columns of quality_rules but kept_text, with removed_lines, __host, __th (a hash of the text) and the text as __t."""
    base = base_metrics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"), host_hash(host_col).alias("__h")), "doc_id", "__t")
    base = base.withColumn("__th", F.xxhash64("__t"))
    removed = line_verdicts(docs, host_col, id_col, text_col, line_docs)
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__th") == F.col("__text")) & (F.col("__h") == F.col("__host"))
    df = base.join(removed, same, "left").drop("__host").withColumnRenamed("__h", "__host")
    df = df.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < MIN_LEFT_PERCENT * F.col("n_words")
    return df.withColumn("kept", ~F.col("base_failed") & ~depleted).select(*VERDICT, "removed_lines", "__host", "__th", "__t")


def quality_rules(
    docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", line_docs: int = LINE_LIMIT
) -> DataFrame:
    """Judge every document by the base rules and by what boilerplate lines of its host leave of it, and remove those lines.

    Returns ``docs``' id with the base metrics (of the whole text), base_failed, removed_words, kept, and kept_text: the text
    without its boilerplate lines. Empty and null texts have no words and fail the base rules; rows that repeat another are
    judged alike; an empty table gives an empty result.
    """
    df = judged(docs, host_col, id_col, text_col, line_docs)
    return df.select(*VERDICT, without_lines(F.coalesce("__t", F.lit("")), F.col("removed_lines")).alias("kept_text"))


def kept_rows(docs: DataFrame, verdicts: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own id, host and text ``verdicts`` (of judged, better written before) keep, without boilerplate lines."""
    kept = verdicts.filter("kept").select(F.col("doc_id").alias("__id"), F.col("__host").alias("__of"), F.col("__th").alias("__is"), "removed_lines").distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (host_hash(host_col) == F.col("__of")) & (F.xxhash64(text_col) == F.col("__is"))
    return docs.join(kept, same).withColumn(text_col, without_lines(F.col(text_col), F.col("removed_lines"))).select(docs.columns)
