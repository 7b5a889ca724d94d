"""Tables from rows in memory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.catalog.model import ForeignKey, Table, columns_of
from larkspur.sources.provider import Provider


class MemoryProvider(Provider):
    """Each table is read as it was when it was added."""

    def __init__(self, database: str = "main"):
        self.name, self.held = database, {}

    def add(self, name: str, schema: T.StructType | str, rows: Iterable[tuple], key: list[str] | None = None, foreign: list[ForeignKey] | None = None) -> "MemoryProvider":
        struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.held[name.lower()] = (Table(name, columns_of(struct), key or [], foreign or [], self.name), struct, list(rows))
        return self

    def databases(self) -> list[str]:
        return [self.name]

    def tables(self, database: str) -> list[Table]:
        return [t for t, _, _ in self.held.values()]

    def scan(self, spark: SparkSession, database: str, table: str) -> DataFrame:
        _, struct, rows = self.held[table.lower()]
        return spark.createDataFrame(rows, struct)
