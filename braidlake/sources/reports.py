"""Reports for administrators: status, inspection, verification and keys of a store, as text or JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.sources.store import Store, key_inventory


def status(store: Store) -> dict:
    """Identity, versions, and what failed writers left."""
    have = store.versions()
    return {"id": store.identity(), "versions": len(have), "last": max(have, default=None), "unreferenced": len(store.unreferenced())}


def inspect(store: Store, version: int | None = None) -> dict:
    """Tables of a version with their rows, digests and columns."""
    version = max(store.versions()) if version is None else version
    told = store.manifest(version)
    tables = {n: t | {"columns": [f"{c} {k}" for c, k in store.read(n, version).dtypes]} for n, t in sorted(told["tables"].items())}
    return {"version": version, "note": told["note"], "tables": tables}


def verify(store: Store) -> dict:
    """Faults of every version."""
    return {"versions": {str(v): store.faults(v) for v in store.versions()}}


def keys(tables: dict[str, DataFrame]) -> dict:
    """Rows by key of sealed tables, and the keys that several tables use."""
    rows = {n: {r["key_id"]: r["rows"] for r in key_inventory(df).collect()} for n, df in sorted(tables.items())}  # one row for each key
    used = [k for told in rows.values() for k in told]
    return {"tables": rows, "shared": sorted({k for k in used if used.count(k) > 1})}


def progress(reports: DataFrame) -> dict:
    """Origins, and how far behind the furthest is, of (origin, applied, observed)."""
    row = reports.agg(F.count(F.lit(1)), F.max(F.col("observed") - F.col("applied"))).first()
    return {"origins": row[0], "behind": row[1] or 0}


def as_json(report: dict) -> str:
    return json.dumps(report, sort_keys=True, ensure_ascii=False)


def as_text(report: dict, depth: int = 0) -> str:
    """A report in lines of name and value."""
    out = []
    for name, value in report.items():
        if isinstance(value, dict):
            out += [f"{'  ' * depth}{name}:", as_text(value, depth + 1)]
        else:
            out.append(f"{'  ' * depth}{name}: {', '.join(map(str, value)) if isinstance(value, list) else value}")
    return "\n".join(x for x in out if x)
