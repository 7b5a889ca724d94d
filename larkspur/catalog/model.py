"""What is known of a table beyond its Spark schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SYSTEM = ("master", "tempdb", "model", "msdb")


@dataclass(frozen=True)
class Column:
    """kind: bit, int, bigint, float, decimal, nvarchar, varbinary, datetime2, uniqueidentifier or sql_variant. length of text
    or bytes, 0 for any."""

    name: str
    type: T.DataType
    kind: str
    nullable: bool = True
    length: int = 0


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]


@dataclass
class Table:
    name: str
    columns: list[Column]
    key: list[str] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    database: str = ""

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bit"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int"
    if isinstance(t, T.LongType):
        return "bigint"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, T.StringType):
        return "nvarchar"
    if isinstance(t, T.BinaryType):
        return "varbinary"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime2"
    return "sql_variant"


def columns_of(schema: T.StructType) -> list[Column]:
    """Columns of a Spark schema; metadata may hold `kind` and `length`."""
    return [Column(f.name, f.dataType, f.metadata.get("kind", kind_of(f.dataType)), f.nullable, f.metadata.get("length", 0)) for f in schema.fields]


#: Written type name: (Spark type, kind). Anything else is text of 255 characters.
WRITTEN: dict[str, tuple[T.DataType, str]] = {
    "BIT": (T.BooleanType(), "bit"), **dict.fromkeys(("INT", "INTEGER", "SMALLINT", "TINYINT"), (T.IntegerType(), "int")), "BIGINT": (T.LongType(), "bigint"),
    **dict.fromkeys(("FLOAT", "REAL", "DOUBLE"), (T.DoubleType(), "float")), **dict.fromkeys(("DECIMAL", "NUMERIC", "MONEY", "SMALLMONEY"), (T.DecimalType(18, 2), "decimal")),
    **dict.fromkeys(("VARBINARY", "BINARY"), (T.BinaryType(), "varbinary")), **dict.fromkeys(("DATETIME", "DATETIME2", "SMALLDATETIME", "TIME"), (T.TimestampType(), "datetime2")),
    "DATE": (T.DateType(), "datetime2"), "UNIQUEIDENTIFIER": (T.StringType(), "uniqueidentifier"),
}


def written(name: str, type_name: str, args: list[int], nullable: bool = True) -> Column:
    """The column that a definition writes."""
    spark, kind = WRITTEN.get(type_name, (T.StringType(), "nvarchar"))
    if kind == "decimal" and args:
        spark = T.DecimalType(args[0], args[1] if len(args) > 1 else 0)
    length = (args[0] if args and args[0] > 0 else 0) if kind == "varbinary" else 0
    if kind == "nvarchar":
        length = args[0] if args and args[0] > 0 else 0 if args else 255
    return Column(name, spark, kind, nullable, length)
