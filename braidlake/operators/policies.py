"""Mergeable columns: counters, observed-remove sets, ownership overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counter(states: DataFrame) -> DataFrame:
    """(key, value) from states (key, actor, pos, neg): the greatest of each actor, summed without overflow and checked on the way back."""
    per = states.groupBy("key", "actor").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    exact = F.sum(F.col("pos").cast("decimal(38,0)") - F.col("neg").cast("decimal(38,0)"))
    return per.groupBy("key").agg(exact.cast("long").alias("value"))


def rebase_counters(ops: DataFrame, floors: DataFrame) -> DataFrame:
    """(key, value): deltas of all incarnations above the key's floor, whichever was inserted concurrently."""
    low = floors.withColumnRenamed("key", "__key")
    live = ops.join(low, F.col("key") == F.col("__key"), "left").filter(F.col("floor").isNull() | (F.col("generation") > F.col("floor")))
    return live.groupBy("key").agg(F.sum("delta").alias("value"))


def observed_set(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """(key, value) of elements with a tag that no remove has observed."""
    gone = removes.select(F.col("key").alias("__key"), F.col("tag").alias("__tag")).distinct()
    return adds.join(gone, (F.col("key") == F.col("__key")) & (F.col("tag") == F.col("__tag")), "left_anti").select("key", "value").distinct()


def overlay(low: DataFrame, owned: DataFrame, key: str, column: str) -> DataFrame:
    """Low rows overlaid by owned cells; a released cell shows the low one again, an owned cell without a low row stays."""
    high = owned.select(F.col(key).alias("__k"), F.col(column).alias("__v"), "owned")
    both = low.select(key, column).join(high, F.col(key) == F.col("__k"), "full")
    return both.filter(F.col(key).isNotNull() | F.col("owned")).select(F.coalesce(key, "__k").alias(key), F.when(F.col("owned"), F.col("__v")).otherwise(F.col(column)).alias(column))


def latest_owner(owners: DataFrame) -> DataFrame:
    """(key, column, owner, owned) by greatest epoch, then version."""
    best = F.max_by(F.struct("owner", "owned"), F.struct("epoch", "version")).alias("o")
    return owners.groupBy("key", "column").agg(best).select("key", "column", "o.owner", "o.owned")


# ---- operations, their guards and their causal state

#: Identity of a policy state, and how many intents a transaction may hold.
STATE = ("table", "column", "key", "generation", "domain", "branch", "scope")
MOST_INTENTS = 10_000
#: The node under which a baseline's values stand as tags.
SEED = 0


def _raise(text: str, kind: str):
    return F.raise_error(F.lit(text)).cast(kind)


def checked_add(a, b):
    """Column: the sum of two 64-bit integers; an overflow raises."""
    exact = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    low, high = F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")
    return F.when(exact.between(low, high), exact.cast("long")).when(exact.isNotNull(), _raise("limit: the counter leaves 64 bits", "long"))


def counter_add(states: DataFrame, ops: DataFrame) -> DataFrame:
    """States (key, actor, pos, neg) after operations (key, actor, delta): an actor only ever adds to its own two sums."""
    new = ops.groupBy("key", "actor").agg(
        F.sum(F.greatest("delta", F.lit(0)).cast("decimal(38,0)")).alias("p"), F.sum(F.greatest(-F.col("delta"), F.lit(0)).cast("decimal(38,0)")).alias("n")
    )
    old = states.select("key", "actor", F.col("pos").cast("decimal(38,0)").alias("p"), F.col("neg").cast("decimal(38,0)").alias("n"))
    both = old.unionByName(new).groupBy("key", "actor").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    fit = lambda c: F.when(F.col(c) <= F.lit("9223372036854775807").cast("decimal(38,0)"), F.col(c).cast("long")).otherwise(_raise("limit: the counter leaves 64 bits", "long"))
    return both.select("key", "actor", fit("pos").alias("pos"), fit("neg").alias("neg"))


def projected_counter(states: DataFrame, baselines: DataFrame) -> DataFrame:
    """(key, value): baseline plus what all actors added; a key without operations shows its baseline."""
    added = counter(states).withColumnRenamed("value", "__added")
    both = baselines.select("key", "baseline").join(added, "key", "full")
    return both.select("key", checked_add(F.coalesce("baseline", F.lit(0).cast("long")), F.coalesce("__added", F.lit(0).cast("long"))).alias("value"))


def set_projection(values, added, removed):
    """Column: a set's sorted array with ``added`` put in where absent and ``removed`` taken out; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.array_union(F.coalesce(values, none), F.coalesce(added, none)), F.coalesce(removed, none)))


def set_remove(adds: DataFrame, removals: DataFrame) -> DataFrame:
    """(key, tag) that a removal (key, value, seen) observes: the tags of the value that stood there by ``seen``. A later or concurrent add keeps its tag."""
    gone = removals.select(F.col("key").alias("__k"), F.col("value").alias("__v"), "seen")
    both = adds.join(gone, (F.col("key") == F.col("__k")) & (F.col("value") == F.col("__v")) & (F.col("at") <= F.col("seen")))
    return both.select("key", "tag").distinct()


def extrema(cells: DataFrame, floors: DataFrame) -> DataFrame:
    """(key, low, high) over all generations above the key's floor: an incarnation that was deleted no longer counts."""
    low = floors.withColumnRenamed("key", "__key")
    live = cells.join(low, F.col("key") == F.col("__key"), "left").filter(F.col("floor").isNull() | (F.col("generation") > F.col("floor")))
    return live.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def refused_intents(intents: DataFrame, rows: DataFrame, most: int = MOST_INTENTS) -> DataFrame:
    """(transaction, fault) of intents (transaction, key) that may not be applied: a null key, no such row, or too many in a transaction."""
    there = rows.select(F.col("key").alias("__k")).distinct()
    both = intents.join(there, F.col("key") == F.col("__k"), "left")
    many = both.groupBy("transaction").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("key").isNull().cast("int")).alias("nulls"), F.sum((F.col("key").isNotNull() & F.col("__k").isNull()).cast("int")).alias("missing")
    )
    fault = F.when(F.col("n") > most, "limit: too many intents").when(F.col("nulls") > 0, "a null key").when(F.col("missing") > 0, "no such row")
    return many.withColumn("fault", fault).filter("fault IS NOT NULL").select("transaction", "fault")


def materialised(intents: DataFrame, identity: tuple[str, ...] = ("table", "column", "key", "generation")) -> DataFrame:
    """Causal counter states (identity, actor, pos, neg) of intents (identity, actor, delta)."""
    return intents.groupBy(*identity, "actor").agg(F.sum(F.greatest("delta", F.lit(0))).alias("pos"), F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("neg"))


def seed_tags(baselines: DataFrame) -> DataFrame:
    """(key, value, node, place): the values of a baseline set as tags of the node SEED, numbered in sorted order."""
    return baselines.select("key", F.posexplode(F.array_sort(F.array_distinct("values"))).alias("place", "value")).select("key", "value", F.lit(SEED).alias("node"), "place")


def joined_states(states: DataFrame, identity: tuple[str, ...] = ("key",)) -> DataFrame:
    """(identity, basis, baseline): of several states the baseline of the highest basis; two baselines of one basis are a conflict and raise."""
    by_basis = states.groupBy(*identity, "basis").agg(F.max("baseline").alias("baseline"), F.count_distinct("baseline").alias("__n"))
    kind = states.schema["baseline"].dataType
    sure = F.when(F.col("__n") > 1, F.raise_error(F.lit("corrupt: two baselines of one basis")).cast(kind)).otherwise(F.col("baseline"))
    return by_basis.withColumn("baseline", sure).groupBy(*identity).agg(F.max("basis").alias("basis"), F.max_by("baseline", "basis").alias("baseline"))


def kept_tags(tags: DataFrame, states: DataFrame) -> DataFrame:
    """Tags (key, basis, node, ...) without the seeds of states that lost to a higher basis; tags of operations all stay."""
    top = states.select(F.col("key").alias("__k"), F.col("basis").alias("__top"))
    both = tags.join(top, F.col("key") == F.col("__k"), "left")
    return both.filter((F.col("node") != SEED) | F.col("__top").isNull() | (F.col("basis") == F.col("__top"))).drop("__k", "__top")


def orphans(states: DataFrame, floors: DataFrame) -> DataFrame:
    """Operations (key, generation, actor, delta) with ``generation`` set to the key's winning one, those of fenced generations left out.

    Rows that were inserted concurrently under one key keep their operations: what the losers counted goes to the winner. Generations at or below the
    key's deletion floor are fenced: their operations went with the row.
    """
    low = floors.withColumnRenamed("key", "__key")
    live = states.join(low, F.col("key") == F.col("__key"), "left").filter(F.col("floor").isNull() | (F.col("generation") > F.col("floor"))).drop("__key", "floor")
    top = live.groupBy(F.col("key").alias("__key")).agg(F.max("generation").alias("winner"))
    return live.join(top, F.col("key") == F.col("__key")).select("key", F.col("winner").alias("generation"), "actor", "delta")


def rebased(states: DataFrame, floors: DataFrame, baselines: DataFrame) -> DataFrame:
    """(key, generation, value): the winner's baseline plus the operations of all unfenced generations."""
    moved = orphans(states, floors).groupBy("key", "generation").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("__sum"))
    base = baselines.select(F.col("key").alias("__k"), F.col("generation").alias("__g"), "baseline")
    both = moved.join(base, (F.col("key") == F.col("__k")) & (F.col("generation") == F.col("__g")), "left")
    return both.select("key", "generation", (F.coalesce("baseline", F.lit(0)).cast("decimal(38,0)") + F.col("__sum")).cast("long").alias("value"))


def configured(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table, column, policy) of ``wanted`` checked against ``columns`` (table, column, key boolean): unknown columns and key columns raise."""
    known = columns.select(F.col("table").alias("__t"), F.col("column").alias("__c"), F.col("key").alias("__key"))
    both = wanted.join(known, (F.col("table") == F.col("__t")) & (F.col("column") == F.col("__c")), "left")
    sure = F.when(F.col("__c").isNull(), _raise("no such column", "string")).when(F.col("__key"), _raise("a key column has no policy", "string")).otherwise(F.col("policy"))
    return both.select("table", "column", sure.alias("policy"))


# ---- ownership of the high side over the low one

ROW = "__row__"


def promoted(cells: DataFrame, deletes: DataFrame, version, epoch) -> DataFrame:
    """Owners (key, column, owned, epoch) that local writes of a batch make: its cells, and the whole row (column ROW) of its deletions."""
    own = cells.filter(F.col("version") == version).select("key", "column", F.lit(True).alias("owned"), epoch.alias("epoch"))
    rows = deletes.filter(F.col("version") == version).select("key", F.lit(ROW).alias("column"), F.lit(True).alias("owned"), epoch.alias("epoch"))
    return own.unionByName(rows).distinct()


def shadows(cells: DataFrame) -> DataFrame:
    """(domain, key, column, value, version, generation): each source domain's latest low cell of the highest generation."""
    best = F.max(F.struct("generation", "version", "value")).alias("b")
    per = cells.groupBy("domain", "key", "column").agg(best)
    top = per.groupBy(F.col("domain").alias("__d"), F.col("key").alias("__k")).agg(F.max("b.generation").alias("__g"))
    both = per.join(top, (F.col("domain") == F.col("__d")) & (F.col("key") == F.col("__k")) & (F.col("b.generation") == F.col("__g")))
    return both.select("domain", "key", "column", "b.value", "b.version", "b.generation")


def release(owners: DataFrame, released: DataFrame, epoch) -> DataFrame:
    """Owners after giving up those of ``released`` (key, column; a null column means the whole row): not owned any more, as of ``epoch``."""
    gone = released.select(F.col("key").alias("__k"), F.col("column").alias("__c"), F.lit(True).alias("__gone")).distinct()
    both = owners.join(gone, (F.col("key") == F.col("__k")) & (F.col("__c").isNull() | (F.col("column") == F.col("__c"))), "left")
    out = both.select("key", "column", (F.col("owned") & F.col("__gone").isNull()).alias("owned"), F.when(F.col("__gone"), epoch).otherwise(F.col("epoch")).alias("epoch"))
    return out.groupBy("key", "column").agg(F.max_by("owned", "epoch").alias("owned"), F.max("epoch").alias("epoch"))


def overlaid(high: DataFrame, low: DataFrame, owners: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cells (key, column, value, side) that readers see.

    A row that the high side owns shows its high cells alone; an owned cell shows the high value; any other cell the low one. A row that the low
    side deleted (``deleted``: key) and of which nothing is owned is gone.
    """
    owned = owners.filter("owned")
    rows = owned.filter(F.col("column") == ROW).select(F.col("key").alias("__rk")).distinct()
    cells = owned.filter(F.col("column") != ROW).select(F.col("key").alias("__ck"), F.col("column").alias("__cc")).distinct()
    any_ = owned.select(F.col("key").alias("__ak")).distinct()
    high_row = high.join(rows, F.col("key") == F.col("__rk"), "left_semi")
    high_cell = high.join(rows, F.col("key") == F.col("__rk"), "left_anti").join(cells, (F.col("key") == F.col("__ck")) & (F.col("column") == F.col("__cc")), "left_semi")
    gone = deleted.select(F.col("key").alias("__dk")).distinct().join(any_, F.col("__dk") == F.col("__ak"), "left_anti")
    rest = low.join(rows, F.col("key") == F.col("__rk"), "left_anti").join(cells, (F.col("key") == F.col("__ck")) & (F.col("column") == F.col("__cc")), "left_anti")
    rest = rest.join(gone, F.col("key") == F.col("__dk"), "left_anti")
    show = lambda df, side: df.select("key", "column", "value", F.lit(side).alias("side"))
    return show(high_row, "high").unionByName(show(high_cell, "high")).unionByName(show(rest, "low"))


def branches(owners: DataFrame, cells: DataFrame, local: str) -> DataFrame:
    """(key, column, domain): whose policy branch counts: the local domain's where the cell is owned, else that of the newest shadow."""
    newest = cells.groupBy("key", "column").agg(F.max(F.struct("version", "domain", "generation")).alias("n"))
    own = owners.filter("owned").select(F.col("key").alias("__k"), F.col("column").alias("__c"), F.lit(local).alias("__local")).distinct()
    both = newest.join(own, (F.col("key") == F.col("__k")) & (F.col("column") == F.col("__c")), "left")
    return both.select("key", "column", F.coalesce("__local", "n.domain").alias("domain"))


def imported(bundles: DataFrame, receipts: DataFrame) -> DataFrame:
    """Bundles (stream, sequence, digest, ...) not taken in before; a receipt of the same place with another digest is corrupt and raises."""
    had = receipts.select(F.col("stream").alias("__s"), F.col("sequence").alias("__q"), F.col("digest").alias("__d"))
    both = bundles.join(had, (F.col("stream") == F.col("__s")) & (F.col("sequence") == F.col("__q")), "left")
    clash = F.when(F.col("__d").isNotNull() & (F.col("__d") != F.col("digest")), _raise("corrupt: another bundle had this place", "boolean")).otherwise(F.col("__d").isNull())
    return both.filter(clash).drop("__s", "__q", "__d")
