"""Catalogues of tables and columns: identity, mappings, validation, additive adoption, filters by table, and null-filling of rows.

A catalogue has rows (table, column, type, key, not_null, policy): ``key`` is a column's place in the key from 1, or 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATALOGUE = "table string, column string, type string, key int, not_null boolean, policy string"
#: Keywords that a definition may not use, and how many columns a table may have.
BARRED = ("VIRTUAL", "CHECK", "REFERENCES", "GENERATED", "AUTOINCREMENT")
MOST_COLUMNS = 2000
_SKIPPED = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\[[^\]]*\]", re.DOTALL)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def hash_id(*parts) -> Column:
    """Column: an opaque identifier of texts: the first 32 hexadecimal digits of their SHA-256, each part with its length."""
    pieces = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 32)


def keywords(definition: str) -> list[str]:
    """The words of a definition in upper case, without those in quotes and comments."""
    return [w.upper() for w in re.findall(r"[A-Za-z_]+", _SKIPPED.sub(" ", definition))]


def barred(definition: str) -> list[str]:
    """The keywords of a definition that are not allowed."""
    found = set(keywords(definition))
    return [w for w in BARRED if w in found]


def parse_index(definition: str) -> tuple[str, str, list[str], bool]:
    """(index, table, columns, unique) of a CREATE INDEX statement over plain columns."""
    name = r"(\"(?:[^\"]|\"\")+\"|[A-Za-z_]\w*)"
    found = re.fullmatch(rf"\s*CREATE\s+(UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?{name}\s+ON\s+{name}\s*\(([^()]*)\)\s*;?\s*", definition, re.IGNORECASE)
    if not found:
        raise ValueError("not an index over plain columns")
    plain = lambda x: x[1:-1].replace('""', '"') if x.startswith('"') else x
    columns = [plain(re.sub(r"\s+(ASC|DESC)$", "", c.strip(), flags=re.IGNORECASE)) for c in found[4].split(",")]
    return plain(found[2]), plain(found[3]), columns, bool(found[1])


def faults(catalogue: DataFrame) -> DataFrame:
    """(table, fault) of tables that break a rule: no key, a key column that may be null, a gap in the key, a bad name, too many columns, a policy on a key column."""
    lone = (F.col("keys") == 1) & (F.col("key_type") == "INTEGER")
    per = catalogue.groupBy("table").agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum((F.col("key") > 0).cast("int")).alias("keys"),
        F.max("key").alias("last"),
        F.count_distinct(F.when(F.col("key") > 0, F.col("key"))).alias("places"),
        F.max(F.when(F.col("key") > 0, F.upper("type"))).alias("key_type"),
        F.sum(((F.col("key") > 0) & ~F.col("not_null")).cast("int")).alias("loose"),
        F.sum((~F.col("column").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") | ~F.col("table").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")).cast("int")).alias("odd"),
        F.sum(((F.col("key") > 0) & F.col("policy").isNotNull()).cast("int")).alias("barred"),
    )
    fault = (
        F.when(F.col("keys") == 0, "no key")
        .when((F.col("loose") > 0) & ~lone, "a key column may be null")
        .when((F.col("last") != F.col("keys")) | (F.col("places") != F.col("keys")), "a gap in the key")
        .when(F.col("odd") > 0, "a name that is not plain")
        .when(F.col("columns") > MOST_COLUMNS, "too many columns")
        .when(F.col("barred") > 0, "a policy on a key column")
    )
    return per.withColumn("fault", fault).filter("fault IS NOT NULL").select("table", "fault")


def identities(new: DataFrame, previous: DataFrame, mappings: DataFrame) -> DataFrame:
    """(table, column, table_id, column_id) of a new catalogue's columns.

    A mapping (table, column, old_table, old_column; null columns map a table) hands on the ids of ``previous`` (table, column, table_id, column_id);
    without one a name that was there keeps its id, and a new name gets the hash of its name. A mapping to nothing raises.
    """
    tables = mappings.filter("column IS NULL").select(F.col("table").alias("__mt"), F.col("old_table").alias("__mo"))
    columns = mappings.filter("column IS NOT NULL").select(F.col("table").alias("__ct"), F.col("column").alias("__cc"), F.col("old_column").alias("__co"))
    old = previous.select(F.col("table").alias("__ot"), F.col("column").alias("__oc"), "table_id", "column_id")
    old_tables = previous.select(F.col("table").alias("__pt"), F.col("table_id").alias("__pid")).distinct()
    rows = new.join(tables, F.col("table") == F.col("__mt"), "left").join(columns, (F.col("table") == F.col("__ct")) & (F.col("column") == F.col("__cc")), "left")
    rows = rows.withColumns({"__was_t": F.coalesce("__mo", "table"), "__was_c": F.coalesce("__co", "column")})
    rows = rows.join(old_tables, F.col("__was_t") == F.col("__pt"), "left").join(old, (F.col("__was_t") == F.col("__ot")) & (F.col("__was_c") == F.col("__oc")), "left")
    lost = (F.col("__mo").isNotNull() & F.col("__pid").isNull()) | (F.col("__co").isNotNull() & F.col("column_id").isNull())
    table_id = F.when(lost, F.raise_error(F.lit("a mapping to nothing")).cast("string")).otherwise(F.coalesce("__pid", hash_id(F.lit("table"), F.col("table"))))
    rows = rows.withColumn("__tid", table_id)
    return rows.select("table", "column", F.col("__tid").alias("table_id"), F.coalesce("column_id", hash_id(F.col("__tid"), F.col("column"))).alias("column_id"))


def history(previous: Column, text: Column) -> Column:
    """Column: the digest of a schema's history after one more statement."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit("\n"), text), 256)


def adopted(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(table, column, action) by which a local catalogue takes in a remote one.

    add_table and add_column (nullable, not of the key) are additive; conflict marks a column whose type, key place or policy differs, or a new
    column that may not be null or belongs to the key; same needs nothing, local_only is not in the remote one.
    """
    mine = local.select(F.col("table").alias("__t"), F.col("column").alias("__c"), F.col("type").alias("__type"), F.col("key").alias("__key"), F.col("policy").alias("__policy"))
    have = local.select(F.col("table").alias("__have")).distinct()
    both = remote.withColumn("__remote", F.lit(True)).join(mine, (F.col("table") == F.col("__t")) & (F.col("column") == F.col("__c")), "full")
    both = both.join(have, F.col("table") == F.col("__have"), "left")
    equal = (F.upper("type") == F.upper("__type")) & (F.col("key") == F.col("__key")) & F.col("policy").eqNullSafe(F.col("__policy"))
    action = (
        F.when(F.col("__remote").isNull(), "local_only")
        .when(F.col("__have").isNull(), "add_table")
        .when(F.col("__t").isNotNull(), F.when(equal, "same").otherwise("conflict"))
        .when(F.col("not_null") | (F.col("key") > 0), "conflict")
        .otherwise("add_column")
    )
    return both.select(F.coalesce("table", "__t").alias("table"), F.coalesce("column", "__c").alias("column"), action.alias("action"))


def mapped(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(table, column, type, policy) columns that two domains share: equal in name, type and policy."""
    mine = local.select(F.col("table").alias("__t"), F.col("column").alias("__c"), F.upper("type").alias("__type"), F.col("policy").alias("__policy"))
    same = (F.col("table") == F.col("__t")) & (F.col("column") == F.col("__c")) & (F.upper("type") == F.col("__type")) & F.col("policy").eqNullSafe(F.col("__policy"))
    return remote.join(mine, same, "left_semi").select("table", "column", "type", "policy")


def accepted(manifests: DataFrame, local: DataFrame) -> DataFrame:
    """(database, verdict) of schema manifests (database, epoch, history) against the local one: current, adopt, stale, or record (no local one)."""
    mine = local.select(F.col("database").alias("__d"), F.col("epoch").alias("__e"), F.col("history").alias("__h"))
    both = manifests.join(mine, F.col("database") == F.col("__d"), "left")
    verdict = (
        F.when(F.col("__d").isNull(), "record")
        .when(F.col("history") == F.col("__h"), "current")
        .when(F.col("epoch") > F.col("__e"), "adopt")
        .otherwise("stale")
    )
    return both.select("database", verdict.alias("verdict"))


def replicated(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Rows (table, ...) of tables that are replicated: those that ``settings`` (table, enabled) do not switch off."""
    off = settings.filter(~F.col("enabled")).select(F.col("table").alias("__off")).distinct()
    return rows.join(off, F.col("table") == F.col("__off"), "left_anti")


def retired(declared: DataFrame, local: DataFrame) -> DataFrame:
    """(sender, table) of tables that a sender declares and this side does not have any more: their rows are left out."""
    have = local.select(F.col("table").alias("__have")).distinct()
    return declared.select("sender", "table").distinct().join(have, F.col("table") == F.col("__have"), "left_anti")


def without_retired(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (sender, table, ...) without those of tables that are retired for their sender."""
    out = gone.select(F.col("sender").alias("__s"), F.col("table").alias("__t"))
    return rows.join(out, (F.col("sender") == F.col("__s")) & (F.col("table") == F.col("__t")), "left_anti")


def null_filled(rows: DataFrame, catalogue: list[tuple[str, str, bool]]) -> DataFrame:
    """``rows`` with every column of ``catalogue`` (name, type, required): a missing one is null; a missing required one, or a null in it, raises."""
    out = []
    for name, kind, required in catalogue:
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        if required:
            value = F.coalesce(value, F.raise_error(F.lit(f"{name} may not be null")).cast(kind))
        out.append(value.alias(name))
    return rows.select(*out)


def quoted(name: str) -> str:
    """A name as an SQL identifier."""
    if "\x00" in name:
        raise ValueError("a name holds no zero character")
    return '"' + name.replace('"', '""') + '"'


def plain_name(name: str) -> bool:
    return bool(_NAME.fullmatch(name))
