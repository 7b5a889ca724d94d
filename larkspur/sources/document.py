"""Collections of JSON documents, one a line, as tables.

Three ways to a schema: inferred from all documents (or, where asked, the first ones), declared in a catalog document that lies
beside the collections, or given in code. Values that are no scalars become their JSON text. Every document is read; no scan is capped.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog.model import Column, ForeignKey, Table, kind_of
from larkspur.sources.provider import Provider

#: Documents whose fields come first, as they were seen; others follow by name.
SAMPLE = 100
_MOMENT = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?"
#: The file that declares tables.
CATALOG = "_catalog.json"

_DECLARED: dict[str, T.DataType] = {
    "bit": T.BooleanType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "integer": T.IntegerType(), "short": T.IntegerType(),
    "byte": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "half_float": T.DoubleType(),
    "scaled_float": T.DoubleType(), "decimal": T.DecimalType(18, 2), "date": T.TimestampType(), "datetime": T.TimestampType(), "datetime2": T.TimestampType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(),
}


def declared_type(name: str) -> T.DataType:
    """The type of a declared or mapped name; anything else is text."""
    return _DECLARED.get(name.lower().split("(")[0], T.StringType())


def _value_type(v) -> T.DataType:
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.LongType()
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, str) and re.fullmatch(_MOMENT, v):
        return T.TimestampType()
    return T.StringType()


def infer(documents: list[str], order: str = "seen") -> list[Column]:
    """The union of the documents' fields, each of the type of its first value that isn't null; `_id` first, then as seen or by
    name. What is no document is passed over."""
    types: dict[str, T.DataType | None] = {}
    for line in documents:
        try:
            doc = json.loads(line)
        except ValueError:
            continue
        if isinstance(doc, dict):
            for k, v in doc.items():
                if types.get(k) is None:
                    types[k] = None if v is None else _value_type(v)
    names = sorted(types) if order == "name" else list(types)
    names.sort(key=lambda n: n != "_id")
    return [Column(n, t := types[n] or T.StringType(), kind_of(t)) for n in names]


class DocumentProvider(Provider):
    """collections: by table name, a path to JSON lines.

    mode "inferred": columns from the documents, no keys. sample: only so many are looked at, and a field has the type of its first value;
    without it all are, in one pass of Spark's own, and a field has a type that holds all its values. strict: a line that is no
    document is an error instead of being passed over. "declared": columns and keys from CATALOG in `directory`, which is
    written from inference if it is missing (the key is then `id`, where there is one). "static": `tables`, given in code.
    """

    def __init__(self, spark: SparkSession, collections: dict[str, str], mode: str = "inferred", directory: str | None = None, tables: list[Table] | None = None, database: str = "main", order: str = "seen", sample: int | None = None, strict: bool = False):
        if mode not in ("inferred", "declared", "static"):
            raise ValueError(f"unknown mode {mode}")
        self.spark, self.collections, self.database, self.order, self.sample, self.strict = spark, collections, database, order, sample, strict
        if mode == "static":
            self.known = {t.name: t for t in tables or []}
        else:
            self.known = self._declared(directory) if mode == "declared" else {n: self._inferred(n) for n in collections}

    def _inferred(self, name: str) -> Table:
        lines = [r[0] for r in self.spark.read.text(self.collections[name]).limit(self.sample or SAMPLE).collect()]
        first = infer(lines, self.order)
        return Table(name, first if self.sample else self._inferred_of_all(name, [c.name for c in first]), [], [], self.database)

    def _inferred_of_all(self, name: str, seen: list[str]) -> list[Column]:
        broken = "__lk_broken"
        read = self.spark.read.option("columnNameOfCorruptRecord", broken).json(self.collections[name])
        types = {f.name: f.dataType for f in read.schema.fields if f.name != broken}
        texts = [n for n, t in types.items() if isinstance(t, T.StringType)]
        if texts:  # moments are texts to JSON
            quoted = [f"d.`{n.replace('`', '``')}`" for n in texts]
            lines = self.spark.read.text(self.collections[name]).select(F.from_json("value", T.StructType([T.StructField(n, T.StringType()) for n in texts])).alias("d"))
            found = lines.agg(*[F.coalesce(F.every(F.col(q).rlike(f"^{_MOMENT}$")), F.lit(False)).alias(f"m{i}") for i, q in enumerate(quoted)]).first()
            types |= {n: T.TimestampType() for n, moment in zip(texts, found) if moment}
        scalar = (T.BooleanType, T.LongType, T.DoubleType, T.TimestampType)
        place = {n: i for i, n in enumerate(seen)}
        names = sorted(types, key=lambda n: (n != "_id", place.get(n, len(place)) if self.order == "seen" else 0, n))
        return [Column(n, t := types[n] if isinstance(types[n], scalar) else T.StringType(), kind_of(t)) for n in names]

    def _declared(self, directory: str) -> dict[str, Table]:
        path = f"{directory.rstrip('/')}/{CATALOG}"
        try:
            entries = [json.loads(r[0]) for r in self.spark.read.text(path).collect()]
        except Exception as x:
            if "PATH_NOT_FOUND" not in str(x):
                raise
            entries = []
            for name in self.collections:
                t = self._inferred(name)
                key = [c.name for c in t.columns if c.name == "id"]
                entries.append({"table": name, "columns": [{"name": c.name, "type": c.type.simpleString()} for c in t.columns], "primary_key": key, "foreign_keys": []})
            rows = self.spark.createDataFrame([(json.dumps(e),) for e in entries], "value string")
            rows.coalesce(1).write.text(path)
        found = {}
        for e in entries:
            columns = []
            for c in e["columns"]:
                spark_type = T.TimestampType() if c["type"] == "timestamp" else declared_type(c["type"])
                columns.append(Column(c["name"], spark_type, kind_of(spark_type)))
            foreign = [ForeignKey(tuple(f["columns"]), f["ref_table"], tuple(f["ref_columns"])) for f in e.get("foreign_keys", [])]
            found[e["table"]] = Table(e["table"], columns, list(e.get("primary_key", [])), foreign, self.database)
        return found

    def databases(self) -> list[str]:
        return [self.database]

    def tables(self, database: str) -> list[Table]:
        return list(self.known.values())

    def scan(self, spark: SparkSession, database: str, table: str) -> DataFrame:
        t = next(x for x in self.known.values() if x.name.lower() == table.lower())
        # Read as text first, so that a value of another type than its column's is cast, or null, but never loses the document.
        lines = spark.read.text(self.collections[t.name])
        broken = "__lk_broken"
        as_text = T.StructType([T.StructField(c.name, T.StringType()) for c in t.columns] + [T.StructField(broken, T.StringType())])
        parsed = lines.select(F.from_json("value", as_text, {"columnNameOfCorruptRecord": broken}).alias("d"))
        cells = []
        for c in t.columns:
            cell = F.col(f"d.`{c.name.replace('`', '``')}`")
            if isinstance(c.type, T.BinaryType):
                cells.append(F.expr(f"try_to_binary(d.`{c.name}`, 'base64')").alias(c.name))
            else:
                cells.append((cell if isinstance(c.type, T.StringType) else cell.try_cast(c.type)).alias(c.name))
        whole = F.col("d").isNotNull() & F.col(f"d.{broken}").isNull()
        if self.strict:
            whole = F.when(whole, True).otherwise(F.raise_error(F.lit(f"{t.name} has a line that is no document")).cast("boolean"))
        return parsed.where(whole).select(*cells)


def mapping_table(name: str, mapping: dict[str, str], key: list[str] | None = None, database: str = "main") -> Table:
    """A table from a field mapping (name: type), as a search engine declares it; `_id` first, then by name."""
    names = ["_id", *sorted(n for n in mapping if n != "_id")]
    columns = [Column(n, t := declared_type(mapping.get(n, "keyword")), kind_of(t)) for n in names]
    return Table(name, columns, key or ["_id"], [], database)
