"""Records in pieces, snapshots in chunks, pages of bounded size, and digests of what they hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a piece; records and bytes of a page; chunks asked for at once.
PIECE, PAGE_RECORDS, PAGE_BYTES, ASKED = 64 * 1024, 256, 1 << 20, 128


def pieces(records: DataFrame, size: int = PIECE) -> DataFrame:
    """(key, place, pieces, length, digest, body) of records (key, payload binary): the payload cut into pieces of ``size`` bytes, each with what the whole must be."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / F.lit(size))).cast("int")
    rows = records.filter(F.col("payload").isNotNull()).withColumn("__n", n)
    cut = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.substring(F.col("payload"), i * size + 1, F.lit(size)))
    rows = rows.select("key", F.col("__n").alias("pieces"), F.octet_length("payload").alias("length"), F.sha2("payload", 256).alias("digest"), F.posexplode(cut).alias("place", "body"))
    return rows.select("key", "place", "pieces", "length", "digest", "body")


def assembled(parts: DataFrame) -> DataFrame:
    """(key, payload) of pieces in any order; a piece that is missing or twice, or a wrong length or digest, raises."""
    hexed = F.array_sort(F.collect_list(F.struct("place", F.hex("body").alias("body"))))
    per = parts.groupBy("key").agg(hexed.alias("__p"), F.max("pieces").alias("__n"), F.max("length").alias("__l"), F.max("digest").alias("__d"), F.count_distinct("pieces", "length", "digest").alias("__kinds"))
    whole = F.unhex(F.array_join(F.transform("__p", lambda p: p["body"]), ""))
    order = F.transform("__p", lambda p: p["place"]) == F.sequence(F.lit(0), F.col("__n") - 1)
    per = per.withColumn("__whole", whole)
    fault = (
        F.when(F.col("__kinds") != 1, "pieces of different records")
        .when((F.size("__p") != F.col("__n")) | ~order, "a piece is missing or twice")
        .when(F.octet_length("__whole") != F.col("__l"), "wrong length")
        .when(F.sha2("__whole", 256) != F.col("__d"), "wrong digest")
    )
    return per.select("key", F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("corrupt: "), fault)).cast("binary")).otherwise(F.col("__whole")).alias("payload"))


def pages(records: DataFrame, key: str, size: str, slots: int = 64, most: int = PAGE_RECORDS, budget: int = PAGE_BYTES) -> DataFrame:
    """``records`` with (slot, page): pages of ``most`` records or about ``budget`` bytes, in key order within a slot; slots deal the keys by hash, so that
    many tasks number them."""
    rows = records.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)))
    order = Window.partitionBy("slot").orderBy(key)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = F.floor(before / F.lit(budget)) + F.floor((F.row_number().over(order) - 1) / F.lit(most))
    return rows.withColumn("page", page.cast("long"))


def manifest(chunks: DataFrame) -> DataFrame:
    """(name, chunk, bytes, digest) of chunks (name, chunk, body)."""
    return chunks.select("name", "chunk", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("digest"))


def verified(received: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, chunk, state) of each chunk of a manifest: good, bad (another digest than the manifest's) or missing."""
    have = received.select(F.col("name").alias("__n"), F.col("chunk").alias("__c"), F.sha2("body", 256).alias("__d"))
    both = manifest.join(have, (F.col("name") == F.col("__n")) & (F.col("chunk") == F.col("__c")), "left")
    state = F.when(F.col("__d").isNull(), 0).when(F.col("__d") == F.col("digest"), 2).otherwise(1)
    best = both.groupBy("name", "chunk").agg(F.max(state).alias("__s"))  # one good delivery will do
    return best.select("name", "chunk", F.element_at(F.array(F.lit("missing"), F.lit("bad"), F.lit("good")), F.col("__s") + 1).alias("state"))


def missing_chunks(have: DataFrame, total: DataFrame, most: int | None = None) -> DataFrame:
    """(name, chunk) of chunks 0 .. total - 1 that are not there; with ``most``, the first so many of each name."""
    wanted = total.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("chunk"))
    gone = wanted.join(have, ["name", "chunk"], "left_anti")
    if most is None:
        return gone
    return gone.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy("chunk"))).filter(F.col("__n") <= most).drop("__n")


def holders(missing: DataFrame, having: DataFrame) -> DataFrame:
    """(name, chunk, holder): whom to ask for each missing chunk: those that have it in turn, by the chunk's place among the missing ones; null if nobody has it."""
    place = F.row_number().over(Window.partitionBy("name").orderBy("chunk")) - 1
    lists = having.groupBy(F.col("name").alias("__n"), F.col("chunk").alias("__c")).agg(F.array_sort(F.collect_set("holder")).alias("__h"))
    both = missing.withColumn("__i", place).join(lists, (F.col("name") == F.col("__n")) & (F.col("chunk") == F.col("__c")), "left")
    return both.select("name", "chunk", F.when(F.col("__h").isNotNull(), F.element_at("__h", (F.col("__i") % F.size("__h") + 1).cast("int"))).alias("holder"))


def file_parts(parts: DataFrame) -> DataFrame:
    """(name, upto, state) of parts (name, offset, length, digest): how far a file is there from its beginning, and whether two parts of one place differ."""
    per = parts.groupBy("name", "offset").agg(F.max("length").alias("length"), F.count_distinct("digest").alias("__n"))
    before = F.coalesce(F.max(F.col("offset") + F.col("length")).over(Window.partitionBy("name").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__gap", (F.col("offset") > before).cast("int"))
    gaps = F.sum("__gap").over(Window.partitionBy("name").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = per.withColumn("__gaps", gaps).groupBy("name").agg(F.max(F.when(F.col("__gaps") == 0, F.col("offset") + F.col("length"))).alias("upto"), F.max("__n").alias("__n"))
    return per.select("name", F.coalesce("upto", F.lit(0)).cast("long").alias("upto"), F.when(F.col("__n") > 1, "conflict").otherwise("good").alias("state"))


def row_digest(columns: Sequence[str]):
    """Column: the SHA-256 of a row: its values as text, each with its length; null told from the empty text."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws(",", *[part(c) for c in columns]), 256)


def digest(df: DataFrame, columns: Sequence[str], order: str, size: int = 4096) -> DataFrame:
    """(rows, digest): an ordered digest of a table with an integer key ``order``: rows digest in key order within ranges of ``size`` keys, the ranges in their order.

    A range's digests are in one task's memory (64 bytes a row), and the digests of the ranges in one row: 64 bytes for each range that has rows.
    """
    rows = df.select(F.floor(F.col(order) / F.lit(size)).alias("__r"), F.struct(F.col(order).alias("k"), row_digest(columns).alias("d")).alias("x"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["d"]), ""), 256)
    parts = rows.groupBy("__r").agg(F.count(F.lit(1)).alias("n"), joined("x").alias("d"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), joined(F.struct(F.col("__r").alias("k"), "d")).alias("digest"))


def live_pins(pins: DataFrame, now) -> DataFrame:
    """Snapshot pins (snapshot, origin, floor, expires) that still hold the log back."""
    return pins.filter(F.col("expires") > now)


def received(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, finished): whether all chunks of each name of a manifest are there and good."""
    return verified(chunks, manifest).groupBy("name").agg(F.min((F.col("state") == "good").cast("int")).alias("n")).select("name", (F.col("n") == 1).alias("finished"))
