"""Every named query against the same in DuckDB, over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from larkspur import queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries.QUERIES)


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, int) and not isinstance(v, bool):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v).removesuffix(" 00:00:00").removesuffix("+00:00")
    return v


def sort(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in queries.NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    found = frame.collect()
    assert len(set(frame.columns)) == len(frame.columns)
    if name not in queries.ORACLES:
        assert name == "fn_getdate" and len(found) == 5
        return
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns) and sort(columns, cursor.fetchall()) == sort(frame.columns, found)


def test_order_holds(spark):
    for name in ("order_by", "order_by_desc", "order_by_multi", "order_by_ordinal", "top_n", "topk", "flagship"):
        rows = [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]
        key = {"order_by": lambda r: r[0], "order_by_multi": lambda r: (-r[0], r[1]), "order_by_ordinal": lambda r: (-r[1], r[0]), "top_n": lambda r: r[0], "topk": lambda r: (-r[1], r[0]), "flagship": lambda r: -r[2]}.get(name)
        assert rows == (sorted(rows, reverse=True) if key is None else sorted(rows, key=key)) and rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0 and set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
