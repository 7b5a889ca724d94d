"""The small tables that most statements are tried on."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from larkspur.catalog.model import ForeignKey
from larkspur.session import Session
from larkspur.sources.memory import MemoryProvider


def provider() -> MemoryProvider:
    uuid = {"kind": "uniqueidentifier"}
    items = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("price", T.DecimalType(10, 2)), T.StructField("ref", T.StringType(), True, uuid),
        T.StructField("made", T.TimestampType()), T.StructField("data", T.BinaryType()),
    ])
    made = datetime.datetime(2026, 6, 10, tzinfo=datetime.timezone.utc)
    return (
        MemoryProvider("shop")
        .add("people", "id bigint, name string", [(1, "eva"), (2, "hugo")], ["id"])
        .add("buys", "id bigint, person bigint, paid bigint", [(10, 1, 100), (11, 2, 200), (12, 2, 50)], ["id"], [ForeignKey(("person",), "people", ("id",))])
        .add("items", items, [(1, decimal.Decimal("19.99"), "12345678-1234-1234-1234-123456789abc", made, bytes.fromhex("DEADBEEF"))], ["id"])
        .add("units", "id bigint, name string", [(1, "eng"), (2, "sales"), (3, "ops")], ["id"])
        .add("staff", "id bigint, unit bigint, name string", [(10, 1, "amy"), (11, 2, "bob"), (12, 99, "orphan")], ["id"], [ForeignKey(("unit",), "units", ("id",))])
        .add("nulls", "id bigint, a bigint, s string, b boolean", [(1, 1, "x", True), (2, None, None, None), (3, 3, "Y", False)], ["id"])
    )


def session(spark: SparkSession, compat: bool = False) -> Session:
    return Session(spark, [provider()], compat=compat)


def rows(frame) -> list[tuple]:
    return [tuple(r) for r in frame.collect()]
