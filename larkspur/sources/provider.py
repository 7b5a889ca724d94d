"""What a source of tables offers to a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.catalog.model import Table


class Unsupported(ValueError):
    """A source can't do what a statement asks."""


class Provider:
    """Tables of one or more databases. Only tables() and scan() are needed; a flag says what else there is.

    writable: statements may change tables; changes are kept as snapshots beside the source, which is never written.
    full_query: query(sql) answers a whole statement by itself.
    aggregates: aggregate(sql) answers one with aggregates over a single table, or raises Unsupported to be scanned instead.
    """

    writable = True
    full_query = False
    aggregates = False

    def databases(self) -> list[str]:
        return ["main"]

    def tables(self, database: str) -> list[Table]:
        raise NotImplementedError

    def scan(self, spark: SparkSession, database: str, table: str) -> DataFrame:
        """The whole table, lazily; Catalyst pushes filters and columns into it."""
        raise NotImplementedError

    def paths(self, table: str) -> list[str] | None:
        """Folders or files of Parquet that hold the table and nothing else, if there are such."""
        return None

    def query(self, spark: SparkSession, database: str, sql: str) -> DataFrame:
        raise Unsupported("no whole queries here")

    def aggregate(self, spark: SparkSession, database: str, sql: str) -> DataFrame:
        raise Unsupported("no aggregates here")
