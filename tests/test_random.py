"""Random queries over small tables with NULLs, against DuckDB."""

import random

import duckdb
import pytest

from larkspur.session import Session
from larkspur.sources.memory import MemoryProvider

A = [(i, None if i % 5 == 0 else i % 4, None if i % 7 == 3 else "xyzw"[i % 4]) for i in range(40)]
B = [(i, None if i % 3 == 1 else i % 6, "xyq"[i % 3]) for i in range(25)]


def operand(r):
    return r.choice(["a.k", "a.id", "b.k", "3", "(a.id + b.k)", "(a.k * 2)", "(0 - b.id)"])


def predicate(r, depth=0):
    kind = r.randrange(9 if depth < 2 else 6)
    if kind == 0:
        return f"{operand(r)} {r.choice(['=', '<>', '<', '<=', '>', '>='])} {operand(r)}"
    if kind == 1:
        return f"{r.choice(['a.s', 'b.s'])} {r.choice(['IS NULL', 'IS NOT NULL'])}"
    if kind == 2:
        return f"{operand(r)} {r.choice(['IN', 'NOT IN'])} (1, 2, 5)"
    if kind == 3:
        return f"{operand(r)} {r.choice(['BETWEEN', 'NOT BETWEEN'])} 1 AND 4"
    if kind == 4:
        return f"a.s {r.choice(['=', '<'])} b.s"
    if kind == 5:
        return f"COALESCE(a.k, 9) = {r.randrange(10)}"
    if kind == 6:
        return f"NOT ({predicate(r, depth + 1)})"
    return f"({predicate(r, depth + 1)} {r.choice(['AND', 'OR'])} {predicate(r, depth + 1)})"


def query(r):
    join = r.choice(["JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN"])
    base = f"FROM ta a {join} tb b ON a.k = b.k"
    shape = r.randrange(5)
    if shape == 0:
        return f"SELECT a.id AS x, b.id AS y, a.s AS z {base} WHERE {predicate(r)}"
    if shape == 1:
        return f"SELECT a.s AS g, COUNT(*) AS n, COUNT(b.k) AS m, MAX(b.id) AS p {base} WHERE {predicate(r)} GROUP BY a.s"
    if shape == 2:
        return f"SELECT DISTINCT a.k AS x, b.s AS y {base} WHERE {predicate(r)}"
    if shape == 3:
        op = r.choice(["UNION", "UNION ALL", "INTERSECT", "EXCEPT"])
        return f"SELECT a.k AS x, a.s AS y FROM ta a JOIN tb b ON a.id = b.id WHERE {predicate(r)} {op} SELECT b.k, b.s FROM tb b JOIN ta a ON a.k = b.k WHERE {predicate(r)}"
    test = r.choice(["EXISTS", "NOT EXISTS"])
    return f"SELECT a.id AS x FROM ta a WHERE {test} (SELECT 1 FROM tb b WHERE b.k = a.k AND {predicate(r)})"


@pytest.mark.parametrize("seed", range(60))
def test_random_query(spark, seed):
    text = query(random.Random(seed))
    c = duckdb.connect()
    for name, data in (("ta", A), ("tb", B)):
        c.execute(f"CREATE TABLE {name} (id BIGINT, k BIGINT, s VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", data)
    p = MemoryProvider().add("ta", "id bigint, k bigint, s string", A).add("tb", "id bigint, k bigint, s string", B)
    found = sorted(repr(tuple(r)) for r in Session(spark, [p]).sql(text).collect())
    assert found == sorted(repr(tuple(r)) for r in c.execute(text).fetchall()), text
