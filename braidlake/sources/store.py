"""Versioned tables in a folder with fenced publication, backup and verification; SQL that only reads; sealed columns."""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer published first."""


class Store:
    """Tables under ``path``: those of an attempt lie in data/<attempt>/<table>; manifest/<version>.json names the attempt that became the version.

    A manifest is created where there is none yet, which the file system does for one writer only, so two writers never share a version, and what a
    failed attempt wrote is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _create(self, name: str, text: str) -> bool:
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or self._fs.exists(self._at(name)):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def identity(self) -> str:
        """The store's own identifier, made at the first call."""
        self._create("identity.json", json.dumps({"id": uuid.uuid4().hex}))
        return self._read("identity.json")["id"]

    def versions(self) -> list[int]:
        where = self._at("manifest")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int) -> dict:
        return self._read(f"manifest/{version}.json")

    def publish(self, tables: dict[str, DataFrame], base: int | None = None, note: dict | None = None) -> int:
        """Write all tables, then the manifest; readers see all of a version or nothing.

        With ``base`` the version must follow that one: if another writer was faster, Conflict is raised and nothing changes. Without it the next free
        version is taken. The manifest has each table's rows and digest.
        """
        attempt, told = uuid.uuid4().hex, {}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/data/{attempt}/{name}")
            told[name] = fingerprint(self.spark.read.parquet(f"{self.path}/data/{attempt}/{name}"))
        version = (max(self.versions(), default=0) if base is None else base) + 1
        while not self._create(f"manifest/{version}.json", json.dumps({"version": version, "attempt": attempt, "tables": told, "note": note or {}})):
            if base is not None:
                raise Conflict(f"version {version} is there already")
            version += 1
        return version

    def transact(self, change, tries: int = 5) -> int:
        """Publish ``change(tables at the last version)``, again from the start if another writer was faster."""
        for _ in range(tries):
            base = max(self.versions(), default=0)
            have = {n: self.read(n, base) for n in self.manifest(base)["tables"]} if base else {}
            try:
                return self.publish(have | change(have), base)
            except Conflict:
                continue
        raise Conflict(f"no luck in {tries} tries")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        have = self.versions()
        version = max(have, default=None) if version is None else version
        if version not in have:
            raise ValueError(f"no version {version}")
        told = self.manifest(version)
        if name not in told["tables"]:
            raise ValueError(f"no table {name} in version {version}")
        return self.spark.read.parquet(f"{self.path}/data/{told['attempt']}/{name}")

    def faults(self, version: int | None = None) -> list[str]:
        """Tables of a version that are not what its manifest says."""
        version = max(self.versions()) if version is None else version
        return [n for n, told in sorted(self.manifest(version)["tables"].items()) if fingerprint(self.read(n, version)) != told]

    def backup(self, to: Store, version: int | None = None) -> int:
        """Copy one version into another store, which has an identity of its own, and hold the copy against the manifest; a difference raises."""
        version = max(self.versions()) if version is None else version
        if to.identity() == self.identity():
            raise ValueError("a store is no backup of itself")
        told = self.manifest(version)["tables"]
        made = to.publish({n: self.read(n, version) for n in told}, note={"of": self.identity(), "version": version})
        if to.manifest(made)["tables"] != told:
            raise RuntimeError("the copy differs from the manifest")
        return made

    def unreferenced(self) -> list[str]:
        """Attempts that no version names: what failed writers left."""
        if not self._fs.exists(self._at("data")):
            return []
        used = {self.manifest(v)["attempt"] for v in self.versions()}
        return sorted({s.getPath().getName() for s in self._fs.listStatus(self._at("data"))} - used)

    def report(self) -> DataFrame:
        """(version, name, rows, digest) of all versions."""
        rows = [(v, n, t["rows"], t["digest"]) for v in self.versions() for n, t in sorted(self.manifest(v)["tables"].items())]
        return self.spark.createDataFrame(rows, "version long, name string, rows long, digest string")


def fingerprint(df: DataFrame) -> dict:
    """Rows and a digest of a table that does not depend on the order of its rows; two sums over independent hashes of each row."""
    values = [F.to_json(F.struct(F.col(c).alias("v"))) for c in sorted(df.columns)]
    one, two = F.xxhash64(*values).cast("decimal(38,0)"), F.conv(F.substring(F.sha2(F.concat_ws("\x00", *values), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(one).cast("string"), F.sum(two).cast("string")).first()
    return {"rows": n, "digest": f"{a or 0}:{b or 0}"}


_WRITES = ("Command", "ParsedStatement")


def _writes(spark: SparkSession, plan) -> bool:
    gateway = spark.sparkContext._gateway
    if any(is_instance_of(gateway, plan, f"org.apache.spark.sql.catalyst.plans.logical.{kind}") for kind in _WRITES):
        return True
    for nodes in (plan.children(), plan.innerChildren()):
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan") and _writes(spark, node):
                return True
    return False


def sql(spark: SparkSession, text: str, args=None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Read-only SQL over views, with bound parameters: a text whose parsed plan holds a command or a statement that writes raises."""
    if _writes(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
        raise ValueError("only reads are allowed here")
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args) if args is not None else spark.sql(text)


# ---- sealed columns


def sealed(df: DataFrame, columns: list[str], key: bytes, key_id: str, context: str) -> DataFrame:
    """``df`` with texts or blobs encrypted by AES-GCM and a column ``key_id``; ``context`` is bound to the values, which open in no other."""
    lock = lambda c: F.aes_encrypt(F.col(c), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit("")), F.lit(f"{context}:{c}:{key_id}"))
    return df.withColumns({c: lock(c) for c in columns}).withColumn("key_id", F.lit(key_id))


def opened(df: DataFrame, columns: list[str], keys: dict[str, bytes], context: str) -> DataFrame:
    """The texts of sealed columns, each by the key that its row names; an unknown or wrong key raises when the row is read."""

    def unlock(c):
        out = F.raise_error(F.concat(F.lit("no key "), F.col("key_id"))).cast("binary")
        for key_id, key in keys.items():
            out = F.when(F.col("key_id") == key_id, F.aes_decrypt(F.col(c), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(f"{context}:{c}:{key_id}"))).otherwise(out)
        return out.cast("string")

    return df.withColumns({c: unlock(c) for c in columns}).drop("key_id")


def rotated(df: DataFrame, columns: list[str], keys: dict[str, bytes], to: str, context: str) -> DataFrame:
    """Sealed rows with those under other keys sealed anew under ``to``."""
    old = df.filter(F.col("key_id") != to)
    return df.filter(F.col("key_id") == to).unionByName(sealed(opened(old, columns, keys, context), columns, keys[to], to, context))


def key_inventory(df: DataFrame) -> DataFrame:
    """(key_id, rows): a key without rows may be dropped."""
    return df.groupBy("key_id").agg(F.count(F.lit(1)).alias("rows"))
