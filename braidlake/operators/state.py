"""Tables as versioned cells: capture of changes, application of changesets, DML on keyed rows, checks, chunked migration.

A changeset has rows (key, op, old, new): op is insert, update or delete, old and new are structs of the row's columns (null where there
is no row). State is a table of cells (key, column, value, generation, version) and one of tombstones (key, generation, version).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_scan(rows: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A table's rows in key order."""
    return rows.select(*(columns or rows.columns)).orderBy(*key)


def all_tables(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table, key, row) of every row of ``tables`` (name to rows and key columns): keys as arrays of text, rows as JSON."""
    parts = [df.select(F.lit(name).alias("table"), F.array(*[F.col(k).cast("string") for k in key]).alias("key"), F.to_json(F.struct(*df.columns)).alias("row")) for name, (df, key) in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, bytes): row counts and estimated bytes of each table, in one pass over each."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("table"), "rows", "bytes") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_bytes(df: DataFrame, overhead: int = 16) -> Column:
    """Column: an estimate of a row's bytes: 8 for a number, the length of texts and blobs, and an overhead for each value."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        size = F.octet_length(name) if kind in ("string", "binary") else F.lit(8)
        total = total + F.lit(overhead) + F.coalesce(F.when(F.col(name).isNotNull(), size), F.lit(0))
    return total


def capture(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The changeset that makes ``before`` into ``after``; unchanged rows have none, keys compare null-safe."""
    row = lambda: F.struct(*columns)
    old = before.select(*[F.col(k).alias(f"__{k}") for k in key], row().alias("old"), F.lit(True).alias("__old"))
    new = after.select(*key, row().alias("new"), F.lit(True).alias("__new"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = new.join(old, same, "full")
    op = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    keys = [F.when(F.col("__new").isNotNull(), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in key]
    return both.withColumn("op", op).filter("op IS NOT NULL").select(*keys, "op", "old", "new")


def affected_tables(changes: DataFrame) -> DataFrame:
    """(table) names that a changeset with a column ``table`` touches."""
    return changes.select("table").distinct()


def coalesced(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The net change of each key in a batch of changes in ``order``: the first old and the last new row; changes that come to nothing go."""
    at = F.struct(*order)
    net = changes.groupBy(*key).agg(F.min_by("old", at).alias("old"), F.max_by("new", at).alias("new"))
    op = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "insert").when(F.col("old").isNotNull() & F.col("new").isNull(), "delete")
    op = op.when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return net.withColumn("op", op).filter("op IS NOT NULL").select(*key, "op", "old", "new")


def apply_changes(cells: DataFrame, changes: DataFrame, version: Column, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, tombstones) after a changeset of one version; ``changes`` has one row for each key.

    An insert begins the generation after the key's last one; an update stamps the cells that differ; a delete leaves a
    tombstone of the row's generation and takes its cells. Cells of other keys and of unchanged columns keep their versions.
    """
    of = cells.groupBy(F.col("key").alias("__k")).agg(F.max("generation").alias("__g"))
    rows = changes.join(of, F.col("key") == F.col("__k"), "left")
    generation = F.when(F.col("op") == "insert", F.coalesce(F.col("__g") + 1, F.lit(0).cast("long"))).otherwise(F.coalesce("__g", F.lit(0).cast("long")))
    rows = rows.withColumn("generation", generation)
    pair = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"old.{c}").alias("old"), F.col(f"new.{c}").alias("value"))
    written = rows.filter("op <> 'delete'").select("key", "generation", "op", F.explode(F.array(*[pair(c) for c in columns])).alias("c")).select("key", "generation", "op", "c.*")
    written = written.filter((F.col("op") == "insert") | ~F.col("old").eqNullSafe(F.col("value"))).select("key", "column", "value", "generation", version.alias("version"))
    gone = rows.filter("op IN ('delete', 'insert')").select(F.col("key").alias("__gone")).distinct()
    over = written.select(F.col("key").alias("__wk"), F.col("column").alias("__wc"))
    kept = cells.join(gone, F.col("key") == F.col("__gone"), "left_anti").join(over, (F.col("key") == F.col("__wk")) & (F.col("column") == F.col("__wc")), "left_anti")
    tombs = rows.filter("op = 'delete'").select("key", "generation", version.alias("version"))
    return kept.select("key", "column", "value", "generation", "version").unionByName(written), tombs


def rebuilt(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide rows (key, generation, columns...) of the cells of each key's highest generation, in one aggregation."""
    at = F.max("generation").alias("generation")
    latest = lambda c: F.max_by(F.when(F.col("column") == c, F.col("value")), F.when(F.col("column") == c, F.struct("generation", "version"))).alias(c)
    of = lambda c: F.max(F.when(F.col("column") == c, F.col("generation"))).alias(f"__{c}")
    wide = cells.groupBy("key").agg(at, *[latest(c) for c in columns], *[of(c) for c in columns])
    return wide.select("key", "generation", *[F.when(F.col(f"__{c}") == F.col("generation"), F.col(c)).alias(c) for c in columns])


def export_state(rows: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Rows with their versions; a row without one is corrupt and raises."""
    seen = versions.select(F.col(key).alias("__k"), F.col("version"))
    both = rows.join(seen, F.col(key) == F.col("__k"), "left").drop("__k")
    text = F.concat(F.lit("corrupt: no version of the row "), F.col(key).cast("string"))
    return both.withColumn("version", F.when(F.col("version").isNull(), F.raise_error(text).cast(versions.schema["version"].dataType)).otherwise(F.col("version")))


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``table`` with ``rows`` added; a key that is there or comes twice raises when the result is read."""
    both = table.select("*", F.lit(0).alias("__in")).unionByName(rows.select(*table.columns, F.lit(1).alias("__in")))
    many = F.count(F.lit(1)).over(Window.partitionBy(*key))
    added = F.sum("__in").over(Window.partitionBy(*key))
    return both.withColumn("__n", F.when((many > 1) & (added > 0), F.raise_error(F.lit("a key is there already")).cast("long"))).filter("__n IS NULL").select(table.columns)


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], update: dict[str, Column] | None = None) -> DataFrame:
    """``table`` with ``rows`` inserted, or, where the key is there, with the columns of ``update`` set.

    ``update`` gives expressions over the columns of ``table`` and, as ``excluded_<column>``, of the new row; without it all columns but the key are taken.
    A key comes once in ``rows``.
    """
    rest = [c for c in table.columns if c not in key]
    new = rows.select(*[F.col(c).alias(f"excluded_{c}") for c in table.columns], F.lit(True).alias("__new"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"excluded_{k}"))
    both = table.withColumn("__old", F.lit(True)).join(new, same, "full")
    update = update or {c: F.col(f"excluded_{c}") for c in rest}
    out = [F.coalesce(F.col(k), F.col(f"excluded_{k}")).alias(k) for k in key]
    for c in rest:
        changed = update.get(c, F.col(c))
        out.append(F.when(F.col("__old").isNull(), F.col(f"excluded_{c}")).when(F.col("__new").isNull(), F.col(c)).otherwise(changed).alias(c))
    return both.select(*out).select(table.columns)


def replace(table: DataFrame, rows: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """``table`` with ``rows`` put in place of those of the same key, of several the last by ``order``."""
    if order:
        best = F.max_by(F.struct(*table.columns), order).alias("r")
        rows = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(best).select("r.*")
    return delete(table, rows, key).unionByName(rows.select(table.columns))


def delete(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """``table`` without the rows of ``keys``; a null key equals a null key."""
    gone = keys.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return table.join(gone, same, "left_anti")


def update(table: DataFrame, where: Column, values: dict[str, Column], key: Sequence[str], policies: Sequence[str] = ()) -> DataFrame:
    """``table`` with ``values`` set where ``where`` holds; key columns and columns under a merge policy are not set like this."""
    barred = sorted(set(values) & {*key, *policies})
    if barred:
        raise ValueError(f"not to be updated: {', '.join(barred)}")
    unknown = sorted(set(values) - set(table.columns))
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def row_faults(cells: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(row, fault) of rows (row, key array, cells array of (column, value)) of the wrong shape.

    Every column is there once and no other is; the key holds no null and equals the key columns' values.
    """
    names = F.transform("cells", lambda c: c["column"])
    want = F.array(*[F.lit(c) for c in columns])
    value = lambda k: F.element_at(F.filter("cells", lambda c: c["column"] == k), 1)["value"]
    own = F.array(*[value(k) for k in key])
    fault = (
        F.when(F.size(names) != F.size(F.array_distinct(names)), "a column twice")
        .when(F.size(F.array_except(want, names)) > 0, "a column missing")
        .when(F.size(F.array_except(names, want)) > 0, "an unknown column")
        .when(F.exists("key", lambda k: k.isNull()), "a null key")
        .when(~F.col("key").eqNullSafe(own), "key and cells differ")
    )
    return cells.withColumn("fault", fault).filter("fault IS NOT NULL").select("row", "fault")


def overlaps(changes: DataFrame, patch: DataFrame, key: Sequence[str]) -> bool:
    """Whether a changeset touches any key of a patch."""
    return not changes.join(patch.select(*key).distinct(), list(key), "left_semi").limit(1).isEmpty()


def affected_rows(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The rows of ``state`` whose key the batch touches."""
    touched = batch.select(F.col(key).alias("__touched")).distinct()
    return state.join(touched, F.col(key) == F.col("__touched"), "left_semi")


def aligned_chunks(before: DataFrame, after: DataFrame, key: str, size: str, keys: int = 2000, budget: int = 1 << 20, slots: int = 64) -> DataFrame:
    """(key, slot, chunk): keys of two states in key order, cut into chunks of at most ``keys`` keys or about ``budget`` bytes.

    The keys are cut into ``slots`` ranges of their hash order first, so that no task numbers all of them; chunks lie within a slot, and in a slot
    they follow the keys. A chunk ends with the key by which its bytes pass the budget.
    """
    sizes = lambda df, name: df.select(F.col(key).alias("key"), F.col(size).cast("long").alias(name))
    both = sizes(before, "b").join(sizes(after, "a"), "key", "full").select("key", (F.coalesce("b", F.lit(0)) + F.coalesce("a", F.lit(0))).alias("bytes"))
    both = both.withColumn("slot", F.pmod(F.col("key"), F.lit(slots)) if dict(before.dtypes)[key] in ("int", "bigint", "smallint") else F.pmod(F.xxhash64("key"), F.lit(slots)))
    order = Window.partitionBy("slot").orderBy("key")
    run = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(order) - 1
    chunk = F.floor(run / F.lit(budget)) + F.floor(place / F.lit(keys))
    return both.withColumn("chunk", chunk.cast("long")).select("key", "slot", "chunk")


def transaction(table: DataFrame, steps: Sequence, check: Column | None = None) -> DataFrame:
    """``steps`` (functions of a table) one after another, all or nothing: a step that raises, or a row that fails ``check``, leaves no result."""
    out = table
    for step in steps:
        out = step(out)
    if check is None:
        return out
    guard = F.when(F.coalesce(check, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a row fails the check")).cast("boolean"))
    return out.filter(guard)


def export_replica(path: str, cells: DataFrame, tombstones: DataFrame) -> None:
    """Write a replica's whole state: its cells and its tombstones."""
    cells.write.parquet(f"{path}/cells")
    tombstones.write.parquet(f"{path}/tombstones")


def import_replica(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """A replica's state as it was exported."""
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/tombstones")
