"""INFORMATION_SCHEMA, sys and the catalog procedures, as rows made from the registry."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import types as T

from larkspur.catalog.model import SYSTEM, Column, Table

Rows = list[tuple]
SCHEMA = "dbo"
FIRST_OBJECT, FIRST_KEY, FIRST_DATABASE = 100, 200, 5

_ID = {"bit": 104, "int": 56, "bigint": 127, "float": 62, "decimal": 106, "nvarchar": 231, "varbinary": 165, "datetime2": 42, "uniqueidentifier": 36}
_BYTES = {"bit": 1, "int": 4, "bigint": 8, "float": 8, "datetime2": 8, "uniqueidentifier": 16, "decimal": 17}
#: (identifier, bytes, name), by identifier.
_TYPES = [
    (36, 16, "uniqueidentifier"), (40, 3, "date"), (41, 5, "time"), (42, 8, "datetime2"), (48, 1, "tinyint"), (52, 2, "smallint"), (56, 4, "int"),
    (59, 4, "real"), (61, 8, "datetime"), (62, 8, "float"), (104, 1, "bit"), (106, 17, "decimal"), (108, 17, "numeric"), (127, 8, "bigint"),
    (165, -1, "varbinary"), (167, -1, "varchar"), (173, -1, "binary"), (175, -1, "char"), (231, -1, "nvarchar"), (239, -1, "nchar"),
]
_ODBC = {"bit": -7, "int": 4, "bigint": -5, "float": 8, "decimal": 3, "varbinary": -3, "datetime2": 93, "uniqueidentifier": -11}
_DIGITS = {"int": 10, "bigint": 19, "float": 53}


def schema(text: str) -> T.StructType:
    """From `NAME:s OTHER:i`: text or bigint columns."""
    return T.StructType([T.StructField(n, T.StringType() if k == "s" else T.LongType()) for n, k in (x.split(":") for x in text.split())])


def _decimal(c: Column) -> tuple[int, int]:
    return (c.type.precision, c.type.scale) if isinstance(c.type, T.DecimalType) else (0, 0)


def _text_length(c: Column) -> int | None:
    return c.length or None if c.kind in ("nvarchar", "varbinary") else None


def _precision(c: Column) -> int | None:
    return _decimal(c)[0] if c.kind == "decimal" else _DIGITS.get(c.kind)


def _yes(c: Column) -> str:
    return "YES" if c.nullable else "NO"


def _keys(tables: Iterable[Table]):
    """(table, constraint, its columns, the foreign key or None)"""
    for t in tables:
        if t.key:
            yield t, f"PK_{t.name}", t.key, None
        for f in t.foreign:
            yield t, f"FK_{t.name}_{f.table}", list(f.columns), f


def _object_ids(tables: list[Table]) -> dict[str, int]:
    return {t.name.lower(): FIRST_OBJECT + i for i, t in enumerate(tables)}


def object_id(tables: list[Table], name: str) -> int | None:
    return _object_ids(tables).get(name.split(".")[-1].strip("[]").lower())


def database_id(databases: list[str], name: str) -> int | None:
    names = [*SYSTEM, *databases]
    lower = [n.lower() for n in names]
    return lower.index(name.lower()) + 1 if name.lower() in lower else None


def _max_length(c: Column) -> int:
    if c.kind in _BYTES:
        return _BYTES[c.kind]
    return (c.length * 2 if c.kind == "nvarchar" else c.length) if c.length else -1


def view(name: str, tables: list[Table], databases: list[str]) -> tuple[T.StructType, Rows] | None:
    """A view by its lower-case name, like information_schema.tables; None if there is none."""
    where = [(t.database, SCHEMA, t.name) for t in tables]
    if name == "information_schema.tables":
        return schema("TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s TABLE_TYPE:s"), [(*w, "BASE TABLE") for w in where]
    if name == "information_schema.columns":
        names = "TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s ORDINAL_POSITION:i IS_NULLABLE:s DATA_TYPE:s CHARACTER_MAXIMUM_LENGTH:i NUMERIC_PRECISION:i NUMERIC_SCALE:i"
        return schema(names), [
            (*w, c.name, i, _yes(c), c.kind, _text_length(c), *(_decimal(c) if c.kind == "decimal" else (None, None)))
            for t, w in zip(tables, where)
            for i, c in enumerate(t.columns, 1)
        ]
    constraint = "CONSTRAINT_CATALOG:s CONSTRAINT_SCHEMA:s CONSTRAINT_NAME:s"
    if name == "information_schema.table_constraints":
        kinds = {True: "FOREIGN KEY", False: "PRIMARY KEY"}
        return schema(f"{constraint} TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s CONSTRAINT_TYPE:s"), [
            (t.database, SCHEMA, n, t.database, SCHEMA, t.name, kinds[f is not None]) for t, n, _, f in _keys(tables)
        ]
    if name == "information_schema.key_column_usage":
        return schema(f"{constraint} TABLE_CATALOG:s TABLE_SCHEMA:s TABLE_NAME:s COLUMN_NAME:s ORDINAL_POSITION:i"), [
            (t.database, SCHEMA, n, t.database, SCHEMA, t.name, c, i) for t, n, columns, _ in _keys(tables) for i, c in enumerate(columns, 1)
        ]
    if name == "information_schema.referential_constraints":
        unique = constraint.replace("CONSTRAINT_", "UNIQUE_CONSTRAINT_")
        return schema(f"{constraint} {unique} MATCH_OPTION:s UPDATE_RULE:s DELETE_RULE:s"), [
            (t.database, SCHEMA, n, t.database, SCHEMA, f"PK_{f.table}", "NONE", "NO ACTION", "NO ACTION") for t, n, _, f in _keys(tables) if f
        ]
    ids = _object_ids(tables)
    if name == "sys.databases":
        names = "name:s database_id:i state:i state_desc:s is_read_only:i collation_name:s compatibility_level:i"
        return schema(names), [(n, i, 0, "ONLINE", 0, "SQL_Latin1_General_CP1_CI_AS", 160) for i, n in enumerate([*SYSTEM, *databases], 1)]
    if name == "sys.schemas":
        return schema("name:s schema_id:i principal_id:i"), [("dbo", 1, 1), ("sys", 4, 4), ("INFORMATION_SCHEMA", 3, 4)]
    if name in ("sys.tables", "sys.objects"):
        return schema("name:s object_id:i schema_id:i type:s type_desc:s is_ms_shipped:i"), [(t.name, ids[t.name.lower()], 1, "U ", "USER_TABLE", 0) for t in tables]
    if name == "sys.columns":
        names = "object_id:i name:s column_id:i system_type_id:i user_type_id:i max_length:i precision:i scale:i is_nullable:i"
        return schema(names), [
            (ids[t.name.lower()], c.name, i, _ID.get(c.kind, 231), _ID.get(c.kind, 231), _max_length(c), *_decimal(c), int(c.nullable))
            for t in tables
            for i, c in enumerate(t.columns, 1)
        ]
    if name == "sys.types":
        names = "name:s system_type_id:i user_type_id:i schema_id:i max_length:i precision:i scale:i is_nullable:i is_user_defined:i"
        return schema(names), [(n, i, i, 4, length, 0, 0, 1, 0) for i, length, n in _TYPES]
    if name == "sys.foreign_keys":
        names = "name:s object_id:i parent_object_id:i referenced_object_id:i schema_id:i type:s type_desc:s is_disabled:i"
        foreign = [(t, n, f) for t, n, _, f in _keys(tables) if f]
        return schema(names), [(n, FIRST_KEY + i, ids[t.name.lower()], ids.get(f.table.lower(), 0), 1, "F ", "FOREIGN_KEY_CONSTRAINT", 0) for i, (t, n, f) in enumerate(foreign)]
    return None


def like(pattern: str | None):
    """Whether a name matches a LIKE pattern in any case; no pattern matches all."""
    if not pattern:
        return lambda name: True
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return lambda name: re.fullmatch(rx, name, re.I | re.S) is not None


def sp_databases(databases: list[str]) -> tuple[T.StructType, Rows]:
    return schema("DATABASE_NAME:s DATABASE_SIZE:i REMARKS:s"), [(d, None, None) for d in databases]


def sp_tables(tables: list[Table], pattern: str | None) -> tuple[T.StructType, Rows]:
    match = like(pattern)
    return schema("TABLE_QUALIFIER:s TABLE_OWNER:s TABLE_NAME:s TABLE_TYPE:s REMARKS:s"), sorted((t.database, "dbo", t.name, "TABLE", None) for t in tables if match(t.name))


def sp_columns(tables: list[Table], table: str | None, pattern: str | None) -> tuple[T.StructType, Rows]:
    names = """TABLE_QUALIFIER:s TABLE_OWNER:s TABLE_NAME:s COLUMN_NAME:s DATA_TYPE:i TYPE_NAME:s PRECISION:i LENGTH:i SCALE:i RADIX:i NULLABLE:i
        REMARKS:s COLUMN_DEF:s SQL_DATA_TYPE:i SQL_DATETIME_SUB:i CHAR_OCTET_LENGTH:i ORDINAL_POSITION:i IS_NULLABLE:s"""
    match, rows = like(pattern), []
    for t in tables:
        if t.name.lower() != (table or "").lower():
            continue
        for i, c in enumerate(t.columns, 1):
            if not match(c.name):
                continue
            numeric = c.kind in ("int", "bigint", "float", "decimal")
            precision = c.length if c.kind == "nvarchar" else _precision(c) or 0
            length = {"bit": 1, "int": 4, "bigint": 8, "float": 8, "nvarchar": c.length * 2}.get(c.kind, precision)
            rows.append((
                t.database, "dbo", t.name, c.name, _ODBC.get(c.kind, -9), c.kind, precision, length, _decimal(c)[1] if c.kind == "decimal" else None,
                10 if numeric else None, int(c.nullable), None, None, _ODBC.get(c.kind, -9), None, c.length * 2 if c.kind == "nvarchar" and c.length else None, i, _yes(c),
            ))
    return schema(names), rows
