"""Tables of files in any format that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.catalog.model import Table, columns_of
from larkspur.sources.provider import Provider


class FileProvider(Provider):
    """files: by table name, (format, path) and, where the files don't tell it, a schema. CSV has a header. A schema that isn't given is
    read once: ORC, Avro and Parquet hold it, JSON and CSV are looked through as a whole."""

    def __init__(self, spark: SparkSession, files: dict[str, tuple], database: str = "main", options: dict[str, str] | None = None):
        self.spark, self.files, self.database, self.options = spark, files, database, {"header": "true", **(options or {})}
        self.known: dict[str, tuple[Table, T.StructType]] = {}

    def _read(self, name: str, schema: T.StructType | None) -> DataFrame:
        kind, path = self.files[name][:2]
        reader = self.spark.read.options(**self.options).format(kind)
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).load(path)

    def databases(self) -> list[str]:
        return [self.database]

    def table(self, name: str) -> Table:
        if name not in self.known:
            given = self.files[name][2] if len(self.files[name]) > 2 else None
            schema = given or self._read(name, None).schema
            self.known[name] = (Table(name, columns_of(schema), [], [], self.database), schema)
        return self.known[name][0]

    def find(self, name: str) -> str | None:
        return next((n for n in self.files if n.lower() == name.lower()), None)

    def tables(self, database: str) -> list[Table]:
        return [self.table(n) for n in self.files]

    def scan(self, spark: SparkSession, database: str, table: str) -> DataFrame:
        name = self.find(table)
        self.table(name)
        return self._read(name, self.known[name][1])
