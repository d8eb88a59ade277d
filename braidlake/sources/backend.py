"""A table source of one's own: key-value backends behind Spark's Python data source interface, and rows as objects.

A backend is any class with ``parts()`` (names of what can be read apart) and ``records(part)`` (an iterator of (key, value, sequence, deleted)); it is
imported by name on the executors, where each part is read by a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "key string, value binary, sequence bigint, deleted boolean"


def _backend(name: str, where: str):
    module, _, cls = name.rpartition(".")
    return getattr(import_module(module), cls)(where)


class _Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.name, self.where = options["backend"], options.get("path", "")

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in _backend(self.name, self.where).parts()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _backend(self.name, self.where).records(partition.value)


class RecordSource(DataSource):
    """Format ``records``: options backend (the class's full name) and path."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def records(spark: SparkSession, backend: str, path: str = "") -> DataFrame:
    """The records of a backend."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").option("backend", backend).load(path)


def as_objects(df: DataFrame, kind: Callable) -> Iterator:
    """Rows as objects of a dataclass, one after another; columns by the names of its fields, a missing one raises."""
    names = [f.name for f in fields(kind)]
    for row in df.select(*names).toLocalIterator():
        yield kind(*row)
