"""Parquet tables of a directory, with keys declared in code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.catalog.model import ForeignKey, Table, columns_of
from larkspur.sources.provider import Provider


class ParquetProvider(Provider):
    """`names` of <directory>/<name>.parquet. A schema is read from a file's footer once, when it is first wanted."""

    def __init__(self, spark: SparkSession, directory: str, names: list[str], keys: dict[str, list[str]] | None = None, foreign: dict[str, list[ForeignKey]] | None = None, database: str = "main"):
        self.spark, self.directory, self.names, self.database = spark, directory.rstrip("/"), names, database
        self.keys, self.foreign, self.known = keys or {}, foreign or {}, {}

    def databases(self) -> list[str]:
        return [self.database]

    def table(self, name: str) -> Table:
        if name not in self.known:
            schema = self.spark.read.parquet(f"{self.directory}/{name}.parquet").schema
            self.known[name] = (Table(name, columns_of(schema), self.keys.get(name, []), self.foreign.get(name, []), self.database), schema)
        return self.known[name][0]

    def tables(self, database: str) -> list[Table]:
        return [self.table(n) for n in self.names]

    def find(self, name: str) -> str | None:
        return next((n for n in self.names if n.lower() == name.lower()), None)

    def paths(self, table: str) -> list[str]:
        return [f"{self.directory}/{self.find(table)}.parquet"]

    def scan(self, spark: SparkSession, database: str, table: str) -> DataFrame:
        name = self.find(table)
        self.table(name)
        return spark.read.schema(self.known[name][1]).parquet(f"{self.directory}/{name}.parquet")
