"""Named queries over the sample tables: one for each thing the dialect does, with the same in DuckDB's SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalog.model import Column, ForeignKey, Table, kind_of
from larkspur.session import Session
from larkspur.sources.document import DocumentProvider, declared_type, mapping_table
from larkspur.sources.memory import MemoryProvider
from larkspur.sources.parquet import ParquetProvider
from larkspur.sources.provider import Unsupported

NAMES = "region nation customer supplier part orders lineitem events".split()
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"]}
FOREIGN = {
    "nation": [ForeignKey(("n_regionkey",), "region", ("r_regionkey",))],
    "customer": [ForeignKey(("c_nationkey",), "nation", ("n_nationkey",))],
    "supplier": [ForeignKey(("s_nationkey",), "nation", ("n_nationkey",))],
    "orders": [ForeignKey(("o_custkey",), "customer", ("c_custkey",))],
    "lineitem": [ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey(("l_partkey",), "part", ("p_partkey",)), ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",))],
}


_providers: dict[tuple[str, str, str], ParquetProvider] = {}


def _provider(spark: SparkSession, sf_dir: str, database: str = "main", names: list[str] = NAMES) -> ParquetProvider:
    """The catalog of a directory; its schemas are read once an application. Providers are never written to, so sessions share them."""
    key = (spark.sparkContext.applicationId, sf_dir, database)
    if key not in _providers:
        keys = (KEYS, FOREIGN) if database == "main" else (None, None)
        _providers[key] = ParquetProvider(spark, sf_dir, names, *keys, database=database)
    return _providers[key]


def session(spark: SparkSession, sf_dir: str, **how) -> Session:
    return Session(spark, [_provider(spark, sf_dir)], **how)


FLAGSHIP = """SELECT TOP 10 n.n_name AS nation, COUNT(*) AS n_orders, SUM(o.o_totalprice) AS revenue
    FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE o.o_orderstatus = 'F' GROUP BY n.n_name HAVING COUNT(*) > 10 ORDER BY revenue DESC"""

#: Orders with a status that is NULL where it is P: the sample tables hold no NULL themselves.
_NULLS = "(SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS st, NULLIF(o_custkey % 10, 3) AS k FROM orders) AS x"

#: Statements that mean the same to both.
SAME: dict[str, str] = {
    "scan_table": "SELECT * FROM region",
    "select_star": "SELECT * FROM supplier",
    "project_columns": "SELECT nation.n_name, n_nationkey FROM nation",
    "alias_as": "SELECT c_name AS customer_name, c_acctbal AS balance FROM customer",
    "project_expr": "SELECT o_orderkey, o_orderkey * 2 + 1 AS x, o_custkey - 5 AS y FROM orders",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "where_basic": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'",
    "cmp_eq": "SELECT n_name FROM nation WHERE n_regionkey = 1", "cmp_ne": "SELECT n_name FROM nation WHERE n_regionkey <> 1",
    "cmp_lt": "SELECT c_custkey FROM customer WHERE c_acctbal < 0", "cmp_le": "SELECT p_partkey FROM part WHERE p_size <= 5",
    "cmp_gt": "SELECT p_partkey FROM part WHERE p_size > 45", "cmp_ge": "SELECT p_partkey FROM part WHERE p_size >= 45",
    "cmp_cols": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey = l_suppkey",
    "bool_and_or": "SELECT p_partkey FROM part WHERE (p_size = 1 OR p_size = 2) AND p_retailprice > 1000 OR p_size = 50",
    "bool_not": f"SELECT o_orderkey FROM {_NULLS} WHERE NOT st = 'F'",
    "in_list": "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49)",
    "not_in_list": f"SELECT o_orderkey FROM {_NULLS} WHERE st NOT IN ('F')",
    "between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000",
    "not_between": "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 50000",
    "is_null": f"SELECT o_orderkey FROM {_NULLS} WHERE st IS NULL", "is_not_null": f"SELECT o_orderkey, st FROM {_NULLS} WHERE k IS NOT NULL AND st IS NOT NULL",
    "bool_paren": "SELECT n_name FROM nation WHERE ((n_nationkey + 1) > 20 OR (n_regionkey = 0)) AND NOT (n_nationkey = 0)",
    "join_inner": "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "join_full": "SELECT a.n_name AS x, b.r_name AS y FROM nation a FULL JOIN region b ON a.n_nationkey = b.r_regionkey + 3",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey",
    "join_multi_pred": "SELECT l.l_orderkey, l.l_partkey, p.p_size FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND l.l_quantity > p.p_size AND p.p_size < 10",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "join_multi": "SELECT r.r_name, n.n_name, COUNT(*) AS customers FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name, n.n_name",
    "join_cte": "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000) SELECT b.o_orderkey, c.c_name FROM big b JOIN customer c ON c.c_custkey = b.o_custkey",
    "join_derived_right": "SELECT c.c_custkey, t.n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t ON t.o_custkey = c.c_custkey",
    "agg_count_star": "SELECT COUNT(*) AS n FROM lineitem", "agg_count_col": f"SELECT COUNT(st) AS a, COUNT(k) AS b, COUNT(*) AS c FROM {_NULLS}",
    "agg_min_max": "SELECT MIN(o_orderdate) AS a, MAX(o_orderdate) AS b, MIN(o_orderpriority) AS c, MAX(o_totalprice) AS d FROM orders",
    "agg_case": "SELECT o_orderstatus, MAX(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS big FROM orders GROUP BY o_orderstatus",
    "group_by": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "group_by_multi": f"SELECT st, k, COUNT(*) AS n FROM {_NULLS} GROUP BY st, k",
    "having_agg": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000",
    "having_alias": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 14",
    "agg_count_distinct": "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "order_by_hidden": "SELECT c_name FROM customer WHERE c_custkey <= 50 ORDER BY c_acctbal, c_custkey",
    "order_by": "SELECT n_name FROM nation ORDER BY n_name", "order_by_desc": "SELECT n_name FROM nation ORDER BY n_name DESC",
    "order_by_multi": "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name", "order_by_expr": "SELECT n_name FROM nation ORDER BY n_nationkey * -1",
    "order_by_ordinal": "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1", "order_by_qualified": "SELECT u.n_regionkey, u.n_name FROM nation u ORDER BY u.n_name",
    "order_by_agg": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000",
    "union_mixed": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region",
    "cte_union": "WITH t AS (SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region) SELECT x, COUNT(*) AS n FROM t GROUP BY x",
    "in_subquery": "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "exists_uncorrelated": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000)",
    "exists_correlated": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "not_exists_correlated": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "not_in_nulls": "SELECT c_custkey, 'a' AS kept FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, o_custkey) FROM orders) UNION ALL SELECT c_custkey, 'b' FROM customer WHERE NULLIF(c_custkey, 1) NOT IN (SELECT NULLIF(o_custkey, 7) FROM orders WHERE o_custkey > 7 AND o_totalprice > 250000) UNION ALL SELECT c_custkey, 'c' FROM customer WHERE NULLIF(c_custkey, 1) NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 0)",
    "in_correlated": "SELECT c_custkey FROM customer c WHERE c.c_nationkey IN (SELECT s_nationkey FROM supplier s WHERE s.s_acctbal > c.c_acctbal)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)",
    "scalar_correlated": "SELECT n.n_name, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n",
    "exists_in_join": "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "exists_or": "SELECT c_custkey FROM customer c WHERE c_acctbal < -500 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "derived_table": "SELECT t.c_name FROM (SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 9000) AS t WHERE t.c_acctbal < 9500",
    "derived_agg": "SELECT MAX(n) AS most, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t",
    "cte": "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n FROM t WHERE n > 10",
    "cte_chained": "WITH a AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, COUNT(*) AS n FROM a GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM b GROUP BY n",
    "arith": "SELECT o_orderkey + 1 AS a, o_orderkey - 2 AS b, o_orderkey * 3 AS c, (o_orderkey + 1) * 2 - o_custkey AS d FROM orders",
    "unary_minus": "SELECT -o_orderkey AS a, -(o_custkey + 1) AS b FROM orders",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_simple": f"SELECT o_orderkey, CASE st WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS s FROM {_NULLS}",
    "scalar_no_from": "SELECT 1 + 2 AS three",
    "fn_upper": "SELECT UPPER(c_mktsegment) AS x, c_custkey FROM customer", "fn_lower": "SELECT LOWER(c_name) AS x FROM customer",
    "fn_ltrim": "SELECT LTRIM('  ' || n_name || ' ') AS x FROM nation", "fn_rtrim": "SELECT RTRIM('  ' || n_name || ' ') AS x FROM nation", "fn_trim": "SELECT TRIM('  ' || n_name || ' ') AS x FROM nation",
    "fn_coalesce": f"SELECT o_orderkey, COALESCE(st, 'none') AS s FROM {_NULLS}", "fn_nullif": "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS x FROM nation",
    "fn_abs": "SELECT c_custkey, ABS(c_acctbal) AS a, ABS(0 - c_custkey) AS b FROM customer", "fn_replace": "SELECT REPLACE(c_name, '#', '-') AS x FROM customer",
    "fn_concat": f"SELECT o_orderkey, CONCAT('<', st, '|', 'x', '>') AS x FROM {_NULLS}",
}

#: (statement, DuckDB's SQL)
PAIRS: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, """SELECT n.n_name AS nation, COUNT(*) AS n_orders, SUM(o.o_totalprice) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F' GROUP BY n.n_name HAVING COUNT(*) > 10 ORDER BY revenue DESC LIMIT 10"""),
    "alias_eq": ("SELECT customer_name = c_name, twice = c_custkey * 2 FROM customer", "SELECT c_name AS customer_name, c_custkey * 2 AS twice FROM customer"),
    "like": ("SELECT n_name FROM nation WHERE n_name LIKE '%A_I%'", "SELECT n_name FROM nation WHERE n_name ILIKE '%A_I%'"),
    "not_like": ("SELECT c_name FROM customer WHERE c_name NOT LIKE '%1%' AND c_custkey NOT LIKE '2%'", "SELECT c_name FROM customer WHERE c_name NOT ILIKE '%1%' AND CAST(c_custkey AS VARCHAR) NOT ILIKE '2%'"),
    "where_expr_left": ("SELECT n_name FROM nation WHERE LEN(n_name) = 5 OR n_nationkey + 1 = 3", "SELECT n_name FROM nation WHERE length(n_name) = 5 OR n_nationkey + 1 = 3"),
    "cmp_mixed": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_custkey <= '100' AND o_orderdate >= '1995-01-01'", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000.0 AND o_custkey <= 100 AND o_orderdate >= TIMESTAMP '1995-01-01'"),
    "join_cross_db": ("SELECT o.o_orderkey, c.c_name FROM main.dbo.orders o JOIN other.dbo.customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000"),
    "agg_sum": ("SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS s, SUM(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS s, CAST(SUM(l_linenumber) AS DOUBLE) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_avg": ("SELECT p_brand, ROUND(AVG(p_size), 6) AS a FROM part GROUP BY p_brand", "SELECT p_brand, ROUND(AVG(p_size), 6) AS a FROM part GROUP BY p_brand"),
    "agg_expr": ("SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, MAX(l_quantity * 2) AS q FROM lineitem", "SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, MAX(l_quantity * 2) AS q FROM lineitem"),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0"),
    "agg_arith": ("SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS mean, COUNT(*) * 2 AS twice FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS mean, COUNT(*) * 2 AS twice FROM orders GROUP BY o_orderstatus"),
    "top_n": ("SELECT TOP 7 c_custkey, c_name FROM customer ORDER BY c_custkey", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 7"),
    "topk": ("SELECT TOP (25) o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "top_percent": ("SELECT TOP 3 PERCENT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (ORDER BY c_custkey) <= ceil(3 * count(*) OVER () / 100.0)"),
    "top_ties": ("SELECT TOP 5 WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 5"),
    "offset_fetch": ("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 20 ROWS FETCH NEXT 10 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20"),
    "offset_only": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20 ROWS", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "union_order_limit": ("SELECT n_nationkey AS k FROM nation UNION SELECT c_custkey FROM customer ORDER BY k DESC OFFSET 1 ROWS FETCH NEXT 5 ROWS ONLY", "SELECT n_nationkey AS k FROM nation UNION SELECT c_custkey FROM customer ORDER BY k DESC LIMIT 5 OFFSET 1"),
    "union_arm_top": ("SELECT * FROM (SELECT TOP 2 n_nationkey AS k FROM nation ORDER BY n_nationkey) a UNION ALL SELECT r_regionkey FROM region", "(SELECT n_nationkey AS k FROM nation ORDER BY 1 LIMIT 2) UNION ALL SELECT r_regionkey FROM region"),
    "cte_recursive": ("WITH upto AS (SELECT 1 AS n UNION ALL SELECT 1 + n FROM upto WHERE n <= 59) SELECT n, n * n AS sq FROM upto", "WITH RECURSIVE upto AS (SELECT 1 AS n UNION ALL SELECT 1 + n FROM upto WHERE n <= 59) SELECT n, n * n AS sq FROM upto"),
    "cte_recursive_join": ("WITH r(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, r.d + 1 FROM r JOIN nation n ON n.n_nationkey = r.k * 2 WHERE r.d < 6) SELECT k, d FROM r", "WITH RECURSIVE r(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, r.d + 1 FROM r JOIN nation n ON n.n_nationkey = r.k * 2 WHERE r.d < 6) SELECT k, d FROM r"),
    "div_int": ("SELECT o_orderkey, o_orderkey / 7 AS a, (0 - o_custkey) / 4 AS b FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS a, CAST(trunc((0 - o_custkey) / 4) AS BIGINT) AS b FROM orders"),
    "div_float": ("SELECT o_orderkey, o_totalprice / 3 AS a, o_orderkey / 2.5 AS b FROM orders", "SELECT o_orderkey, o_totalprice / 3 AS a, o_orderkey / CAST(2.5 AS DOUBLE) AS b FROM orders"),
    "div_zero": ("SELECT n_nationkey, n_nationkey / (n_regionkey - 1) AS a, n_nationkey / (n_regionkey * 1.0 - 1) AS b FROM nation", "SELECT n_nationkey, CAST(trunc(n_nationkey / NULLIF(n_regionkey - 1, 0)) AS BIGINT) AS a, n_nationkey / NULLIF(CAST(n_regionkey AS DOUBLE) - 1, 0) AS b FROM nation"),
    "modulo": ("SELECT o_orderkey, o_orderkey % 7 AS a, (0 - o_custkey) % 5 AS b, o_custkey % (o_orderkey % 2) AS c FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS a, (0 - o_custkey) % 5 AS b, o_custkey % NULLIF(o_orderkey % 2, 0) AS c FROM orders"),
    "concat_plus": (f"SELECT o_orderkey, 's:' + st + '!' AS x FROM {_NULLS}", f"SELECT o_orderkey, 's:' || st || '!' AS x FROM {_NULLS}"),
    "convert": ("SELECT CONVERT(VARCHAR(20), c_custkey) AS a, CONVERT(INT, '42', 1) AS b, CONVERT(FLOAT, '1.5') AS c FROM customer", "SELECT CAST(c_custkey AS VARCHAR) AS a, 42 AS b, CAST(1.5 AS DOUBLE) AS c FROM customer"),
    "cast_int": ("SELECT p_partkey, CAST(p_retailprice AS INT) AS a, CAST('12.5' AS INT) AS b, CAST(' 12 ' AS SMALLINT) AS c, CAST('x' AS INT) AS d FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS INT) AS a, CAST(NULL AS INT) AS b, 12 AS c, CAST(NULL AS INT) AS d FROM part"),
    "cast_bigint": ("SELECT CAST(c_acctbal AS BIGINT) AS a, CAST('123456789012' AS BIGINT) AS b FROM customer", "SELECT CAST(trunc(c_acctbal) AS BIGINT) AS a, 123456789012 AS b FROM customer"),
    "cast_float": ("SELECT CAST(c_custkey AS FLOAT) AS a, CAST('2.25' AS DECIMAL(10, 2)) AS b, CAST('no' AS REAL) AS c FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS a, CAST(2.25 AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS c FROM customer"),
    "cast_bit": ("SELECT n_nationkey, CAST(n_regionkey AS BIT) AS a, CAST('1' AS BIT) AS b FROM nation", "SELECT n_nationkey, CAST(n_regionkey <> 0 AS INT) AS a, CAST(NULL AS INT) AS b FROM nation"),
    "cast_varchar": ("SELECT CAST(c_custkey AS NVARCHAR(50)) + '!' AS a FROM customer", "SELECT CAST(c_custkey AS VARCHAR) || '!' AS a FROM customer"),
    "cast_date": ("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST('1996-02-30' AS DATE) AS b, CAST('1996-02-28' AS DATETIME2) AS c FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(NULL AS DATE) AS b, TIMESTAMP '1996-02-28' AS c FROM orders"),
    "literals": ("SELECT 1 AS a, 2.5 AS b, 'it''s' AS c, 'back\\slash' AS d, N'ü' AS e, 1e3 AS f", "SELECT 1 AS a, CAST(2.5 AS DOUBLE) AS b, 'it''s' AS c, 'back\\slash' AS d, 'ü' AS e, CAST(1000 AS DOUBLE) AS f"),
    "fn_len": ("SELECT c_name, LEN(c_name) AS a, LEN('a  ') AS b FROM customer", "SELECT c_name, length(c_name) AS a, 3 AS b FROM customer"),
    "fn_datalen": ("SELECT n_name, DATALEN(n_name) AS a, DATALEN('äé') AS b FROM nation", "SELECT n_name, strlen(n_name) AS a, 4 AS b FROM nation"),
    "fn_isnull": (f"SELECT o_orderkey, ISNULL(st, 'none') AS s, ISNULL(k, -1) AS k FROM {_NULLS}", f"SELECT o_orderkey, coalesce(st, 'none') AS s, coalesce(k, -1) AS k FROM {_NULLS}"),
    "fn_substring": ("SELECT SUBSTRING(c_name, 1, 4) AS a, SUBSTRING(c_name, 0, 3) AS b, SUBSTRING(c_name, 10, 99) AS c, SUBSTRING(c_name, -5, 3) AS d FROM customer", "SELECT substring(c_name, 1, 4) AS a, substring(c_name, 1, 2) AS b, substring(c_name, 10, 99) AS c, '' AS d FROM customer"),
    "fn_year": ("SELECT o_orderkey, YEAR(o_orderdate) AS y FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders"),
    "fn_month": ("SELECT o_orderkey, MONTH(o_orderdate) AS m FROM orders", "SELECT o_orderkey, month(o_orderdate) AS m FROM orders"),
    "fn_day": ("SELECT o_orderkey, DAY(o_orderdate) AS d FROM orders", "SELECT o_orderkey, day(o_orderdate) AS d FROM orders"),
    "fn_db_id": ("SELECT DB_ID('master') AS a, DB_ID('main') AS b, DB_ID('nope') AS c", "SELECT 1 AS a, 5 AS b, CAST(NULL AS BIGINT) AS c"),
    "fn_object_id": ("SELECT OBJECT_ID('dbo.nation') AS a, OBJECT_ID('nope') AS b", "SELECT 101 AS a, CAST(NULL AS BIGINT) AS b"),
    "fn_quotename": ("SELECT QUOTENAME(n_name) AS a, QUOTENAME('x]y') AS b FROM nation", "SELECT '[' || n_name || ']' AS a, '[x]]y]' AS b FROM nation"),
    "probe_session": ("SELECT DB_NAME() AS db, @@SPID AS spid, SCHEMA_NAME() AS s, @@LANGUAGE AS l, @@TRANCOUNT AS t, HAS_DBACCESS('main') AS h", "SELECT 'main' AS db, 1 AS spid, 'dbo' AS s, 'us_english' AS l, 0 AS t, 1 AS h"),
    "batch_multi": ("SET NOCOUNT ON; SELECT 1 AS x; SELECT COUNT(*) AS n FROM region", "SELECT COUNT(*) AS n FROM region"),
    "batch_variables": ("DECLARE @lo INT = 5, @seg VARCHAR(20) = 'BUILDING'; SET @lo = @lo * 10; SELECT c_custkey, '@seg' AS l FROM customer WHERE c_custkey < @lo AND c_mktsegment = @seg", "SELECT c_custkey, '@seg' AS l FROM customer WHERE c_custkey < 50 AND c_mktsegment = 'BUILDING'"),
    "batch_control": ("DECLARE @i INT = 0; WHILE @i < 3 SET @i = @i + 1; IF @i = 3 SELECT r_name FROM region ELSE SELECT n_name AS r_name FROM nation", "SELECT r_name FROM region"),
    "use_db": ("USE other; SELECT DB_NAME() AS d, COUNT(*) AS n FROM customer", "SELECT 'other' AS d, COUNT(*) AS n FROM customer"),
    "view_basic": ("CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000; SELECT c_custkey FROM rich WHERE c_acctbal < 9900", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_acctbal < 9900"),
    "view_join": ("CREATE OR ALTER VIEW rich AS SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000; SELECT r.c_name, o.o_orderkey FROM rich r JOIN orders o ON o.o_custkey = r.c_custkey", "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000"),
    "proc_basic": ("CREATE PROCEDURE regions AS SELECT r_name FROM region\nGO\nEXEC regions", "SELECT r_name FROM region"),
    "proc_params": ("CREATE PROC by_status @s VARCHAR(1), @least FLOAT = 300000 AS SELECT o_orderkey FROM orders WHERE o_orderstatus = @s AND o_totalprice > @least\nGO\nEXEC by_status 'O', @least = 250000", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000"),
    "dml_insert": ("INSERT INTO region (r_regionkey, r_name) VALUES (90, 'X'), (91, NULL); INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 0; SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT 90, 'X' UNION ALL SELECT 91, NULL UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 0"),
    "dml_update": ("UPDATE nation SET n_name = 'Q', n_regionkey = n_regionkey + 10 WHERE n_nationkey < 5 AND n_regionkey > 0; SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 AND n_regionkey > 0 THEN 'Q' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 5 AND n_regionkey > 0 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "dml_delete": ("DELETE FROM nation WHERE n_regionkey = 2; SELECT * FROM nation", "SELECT * FROM nation WHERE n_regionkey <> 2"),
    "dml_delete_or": ("DELETE FROM nation WHERE n_regionkey = 2 OR n_nationkey = 0; SELECT * FROM nation", "SELECT * FROM nation WHERE NOT (n_regionkey = 2 OR n_nationkey = 0)"),
    "ddl_create": ("CREATE TABLE made (id INT, label NVARCHAR(50), at DATETIME2); INSERT INTO made (id, label) VALUES (1, 'one'), (2, 'two'); SELECT * FROM made", "SELECT 1 AS id, 'one' AS label, CAST(NULL AS TIMESTAMP) AS at UNION ALL SELECT 2, 'two', NULL"),
    "ddl_alter_add": ("ALTER TABLE region ADD code INT, note VARCHAR(10); INSERT INTO region VALUES (9, 'Z', 1, 'n'); SELECT * FROM region", "SELECT r_regionkey, r_name, CAST(NULL AS INT) AS code, CAST(NULL AS VARCHAR) AS note FROM region UNION ALL SELECT 9, 'Z', 1, 'n'"),
    "ddl_alter_drop": ("ALTER TABLE nation DROP COLUMN n_name; SELECT * FROM nation", "SELECT n_nationkey, n_regionkey FROM nation"),
    "ddl_drop": ("DROP TABLE region; SELECT TABLE_NAME AS t FROM INFORMATION_SCHEMA.TABLES", "SELECT unnest(['nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events']) AS t"),
    "ddl_database": ("CREATE DATABASE extra; CREATE TABLE extra.dbo.t (a INT); INSERT INTO extra.dbo.t VALUES (4); DROP DATABASE other; USE extra; SELECT t.a, d.name FROM t CROSS JOIN sys.databases d WHERE d.database_id > 4", "SELECT 4 AS a, unnest(['main', 'extra']) AS name"),
    "sys_databases": ("SELECT name, database_id, state_desc FROM sys.databases", "SELECT * FROM (VALUES ('master', 1, 'ONLINE'), ('tempdb', 2, 'ONLINE'), ('model', 3, 'ONLINE'), ('msdb', 4, 'ONLINE'), ('main', 5, 'ONLINE'), ('other', 6, 'ONLINE')) t(name, database_id, state_desc)"),
    "sys_schemas": ("SELECT * FROM sys.schemas", "SELECT * FROM (VALUES ('dbo', 1, 1), ('sys', 4, 4), ('INFORMATION_SCHEMA', 3, 4)) t(name, schema_id, principal_id)"),
    "sys_types": ("SELECT COUNT(*) AS n, SUM(system_type_id) AS s FROM sys.types", "SELECT 20 AS n, CAST(2092 AS DOUBLE) AS s"),
    "sys_foreign_keys": ("SELECT name, type_desc FROM sys.foreign_keys", "SELECT unnest(['FK_nation_region', 'FK_customer_nation', 'FK_supplier_nation', 'FK_orders_customer', 'FK_lineitem_orders', 'FK_lineitem_part', 'FK_lineitem_supplier']) AS name, 'FOREIGN_KEY_CONSTRAINT' AS type_desc"),
    "is_constraints": ("SELECT CONSTRAINT_NAME, CONSTRAINT_TYPE FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS WHERE TABLE_NAME IN ('orders', 'lineitem')", "SELECT * FROM (VALUES ('PK_orders', 'PRIMARY KEY'), ('FK_orders_customer', 'FOREIGN KEY'), ('FK_lineitem_orders', 'FOREIGN KEY'), ('FK_lineitem_part', 'FOREIGN KEY'), ('FK_lineitem_supplier', 'FOREIGN KEY')) t(CONSTRAINT_NAME, CONSTRAINT_TYPE)"),
    "is_key_usage": ("SELECT TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION FROM INFORMATION_SCHEMA.KEY_COLUMN_USAGE WHERE CONSTRAINT_NAME LIKE 'FK_%'", "SELECT *, 1 AS ORDINAL_POSITION FROM (VALUES ('nation', 'n_regionkey'), ('customer', 'c_nationkey'), ('supplier', 's_nationkey'), ('orders', 'o_custkey'), ('lineitem', 'l_orderkey'), ('lineitem', 'l_partkey'), ('lineitem', 'l_suppkey')) t(TABLE_NAME, COLUMN_NAME)"),
    "is_ref_constraints": ("SELECT CONSTRAINT_NAME, UNIQUE_CONSTRAINT_NAME, MATCH_OPTION FROM INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS", "SELECT *, 'NONE' AS MATCH_OPTION FROM (VALUES ('FK_nation_region', 'PK_region'), ('FK_customer_nation', 'PK_nation'), ('FK_supplier_nation', 'PK_nation'), ('FK_orders_customer', 'PK_customer'), ('FK_lineitem_orders', 'PK_orders'), ('FK_lineitem_part', 'PK_part'), ('FK_lineitem_supplier', 'PK_supplier')) t(CONSTRAINT_NAME, UNIQUE_CONSTRAINT_NAME)"),
    "sp_databases": ("EXEC sp_databases", "SELECT unnest(['main', 'other']) AS DATABASE_NAME, CAST(NULL AS BIGINT) AS DATABASE_SIZE, CAST(NULL AS VARCHAR) AS REMARKS"),
    "sp_tables": ("EXEC sp_tables @table_name = '%E%'", "SELECT 'main' AS TABLE_QUALIFIER, 'dbo' AS TABLE_OWNER, unnest(['region', 'customer', 'supplier', 'orders', 'lineitem', 'events']) AS TABLE_NAME, 'TABLE' AS TABLE_TYPE, CAST(NULL AS VARCHAR) AS REMARKS"),
    "window_ranking": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders"),
    "window_offset": ("SELECT event_id, LAG(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events", "SELECT event_id, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events"),
    "window_frame": ("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM events"),
    "group_by_rollup": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)"),
    "outer_apply": ("SELECT n.n_name, t.c_custkey FROM nation n OUTER APPLY (SELECT MAX(c.c_custkey) AS c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey) t", "SELECT n_name, (SELECT max(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS c_custkey FROM nation"),
}

_KINDS = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'nvarchar' WHEN 'TIMESTAMP' THEN 'datetime2' ELSE 'sql_variant' END"
_LIST = "(" + ", ".join(f"'{n}'" for n in NAMES) + ")"
_IDS = "CASE table_name " + " ".join(f"WHEN '{n}' THEN {100 + i}" for i, n in enumerate(NAMES)) + " END"
PAIRS |= {
    "is_tables": ("SELECT * FROM INFORMATION_SCHEMA.TABLES", f"SELECT 'main' AS TABLE_CATALOG, 'dbo' AS TABLE_SCHEMA, unnest({list(NAMES)}) AS TABLE_NAME, 'BASE TABLE' AS TABLE_TYPE"),
    "is_columns": ("SELECT TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE, IS_NULLABLE FROM INFORMATION_SCHEMA.COLUMNS", f"SELECT table_name AS TABLE_NAME, column_name AS COLUMN_NAME, CAST(column_index AS BIGINT) AS ORDINAL_POSITION, {_KINDS} AS DATA_TYPE, 'YES' AS IS_NULLABLE FROM duckdb_columns() WHERE table_name IN {_LIST}"),
    "sys_tables": ("SELECT name, object_id, type_desc FROM sys.tables", f"SELECT DISTINCT table_name AS name, {_IDS} AS object_id, 'USER_TABLE' AS type_desc FROM duckdb_columns() WHERE table_name IN {_LIST}"),
    "sys_columns": ("SELECT object_id, name, column_id, system_type_id FROM sys.columns", f"SELECT {_IDS} AS object_id, column_name AS name, CAST(column_index AS BIGINT) AS column_id, CASE data_type WHEN 'INTEGER' THEN 56 WHEN 'BIGINT' THEN 127 WHEN 'DOUBLE' THEN 62 WHEN 'TIMESTAMP' THEN 42 ELSE 231 END AS system_type_id FROM duckdb_columns() WHERE table_name IN {_LIST}"),
    "sys_join": ("SELECT t.name AS t, COUNT(*) AS n FROM sys.tables t JOIN sys.columns c ON c.object_id = t.object_id GROUP BY t.name", f"SELECT table_name AS t, count(*) AS n FROM duckdb_columns() WHERE table_name IN {_LIST} GROUP BY 1"),
    "sp_columns": ("EXEC sp_columns 'orders'", None),
}
#: Of catalog procedures only some columns can be told from DuckDB's catalog.
_SP_COLUMNS = f"SELECT table_name AS TABLE_NAME, column_name AS COLUMN_NAME, {_KINDS} AS TYPE_NAME, CAST(column_index AS BIGINT) AS ORDINAL_POSITION FROM duckdb_columns() WHERE table_name = 'orders'"


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        providers = [_provider(spark, sf_dir)]
        if any(word in text for word in ("other", "sys.databases", "sp_databases")):
            providers.append(_provider(spark, sf_dir, "other", ["customer"]))
        return Session(spark, providers).sql(text)

    return run


def sp_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("EXEC sp_columns 'orders'").select("TABLE_NAME", "COLUMN_NAME", "TYPE_NAME", "ORDINAL_POSITION")


def params_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("SELECT c_custkey FROM customer WHERE c_mktsegment = @seg AND c_custkey <= @most", {"@seg": "MACHINERY", "@most": 500})


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.register_function("plus_tax", lambda price: price * 1.5, "double")
    return s.sql("SELECT o_orderkey, PLUS_TAX(o_totalprice) AS taxed FROM orders WHERE o_orderstatus = 'P'")


def fn_getdate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("SELECT r_name, GETDATE() AS now FROM region")


def src_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = MemoryProvider("mem").add("pets", "id bigint, name string, age int", [(1, "rex", 3), (2, "tom", None), (3, None, 9)], ["id"])
    return Session(spark, [p]).sql("SELECT id, name, age FROM pets WHERE age IS NULL OR age > 2")


def _collection(spark: SparkSession, sf_dir: str) -> str:
    """The events as JSON documents, with a nested value and fields that some of them lack."""
    import uuid

    from larkspur.session import _root

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.struct(
        F.col("event_id").alias("id"), F.col("user_id").alias("user"), "event_type", "value",
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 2).alias("even"), F.when(F.col("event_id") % 1000 == 999, "late").alias("late"), F.struct(F.col("event_id").alias("e"), F.col("event_type").alias("t")).alias("nested"),
    )
    path = f"{_root(spark)}/events-{uuid.uuid4().hex}"
    events.select(F.to_json(doc).alias("value")).write.text(path)
    return path


_DOCUMENTS = "SELECT id, user, event_type, value, even, late, nested FROM events"
_DOCUMENTS_ORACLE = """SELECT event_id AS id, user_id AS "user", event_type, value, CASE WHEN event_id % 2 = 0 THEN event_id * 2 END AS even, CASE WHEN event_id % 1000 = 999 THEN 'late' END AS late,
    '{"e":' || event_id || ',"t":"' || event_type || '"}' AS nested FROM events"""


def src_doc_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, [DocumentProvider(spark, {"events": _collection(spark, sf_dir)})]).sql(_DOCUMENTS.replace("user", "[user]"))


def src_doc_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _collection(spark, sf_dir)
    columns = [{"name": n, "type": t} for n, t in (("id", "bigint"), ("user", "bigint"), ("event_type", "varchar"), ("value", "float"), ("even", "bigint"), ("late", "varchar"), ("nested", "varchar"))]
    entry = {"table": "events", "foreign_keys": [], "columns": columns, "primary_key": ["id"]}
    spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.text(f"{path}-catalog/_catalog.json")
    return Session(spark, [DocumentProvider(spark, {"events": path}, "declared", f"{path}-catalog")]).sql(_DOCUMENTS.replace("user", "[user]"))


def src_doc_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (("id", "bigint"), ("user", "bigint"), ("event_type", "varchar"), ("value", "float"), ("even", "bigint"), ("late", "varchar"), ("nested", "varchar"))
    table = Table("events", [Column(n, t := declared_type(k), kind_of(t)) for n, k in names], ["id"])
    return Session(spark, [DocumentProvider(spark, {"events": _collection(spark, sf_dir)}, "static", tables=[table])]).sql(_DOCUMENTS.replace("user", "[user]"))


def compat_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-valued reading of NOT, NOT IN, SUM and string functions."""
    return session(spark, sf_dir, compat=True).sql(f"SELECT o_orderkey, UPPER(st) AS u, LEN(st) AS n FROM {_NULLS} WHERE NOT st = 'F' AND k NOT IN (1, 2)")


#: What earlier names leave out: (statement, DuckDB's SQL).
PAIRS |= {
    "star_qualified": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", "SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey"),
    "naming_columns": ("SELECT n.n_name, n_nationkey + 1 FROM nation n", "SELECT n_name, n_nationkey + 1 AS expr_2 FROM nation"),
    "naming_aggregates": ("SELECT COUNT(*), SUM(p_size), MAX(p_retailprice) FROM part", 'SELECT COUNT(*) AS "count", CAST(SUM(p_size) AS DOUBLE) AS agg, MAX(p_retailprice) AS p_retailprice FROM part'),
    "null_in_expressions": ("SELECT n_nationkey, NULL AS x, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END AS y, n_nationkey + NULL AS z FROM nation", "SELECT n_nationkey, NULL AS x, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END AS y, CAST(NULL AS BIGINT) AS z FROM nation"),
    "join_semi_keys": ("SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000"),
    "semi_anti": ("SELECT s_suppkey, 'semi' AS k FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT s_suppkey, 'anti' FROM supplier WHERE NOT s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT s_suppkey, 'none' FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9500)",
        "SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN 'semi' ELSE 'anti' END AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT s_suppkey, 'none' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)"),
    "join_null_keys": (f"SELECT a.o_orderkey AS x, b.n_name AS y FROM {_NULLS.replace(' AS x', ' AS a')} LEFT JOIN (SELECT NULLIF(n_nationkey, 5) AS k, n_name FROM nation) b ON a.k = b.k", "SELECT o_orderkey AS x, n_name AS y FROM (SELECT o_orderkey, NULLIF(o_custkey % 10, 3) AS k FROM orders) a LEFT JOIN (SELECT NULLIF(n_nationkey, 5) AS k, n_name FROM nation) b ON a.k = b.k"),
    "join_comma_cross_apply": ("SELECT r.r_name, t.n_name FROM region r, nation n CROSS APPLY (SELECT UPPER(n.n_name) AS n_name) t WHERE n.n_regionkey = r.r_regionkey", "SELECT r_name, upper(n_name) AS n_name FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "agg_sum_nothing": (f"SELECT k, SUM(NULLIF(o_orderkey, o_orderkey)) AS s FROM {_NULLS} GROUP BY k", "SELECT DISTINCT NULLIF(o_custkey % 10, 3) AS k, CAST(NULL AS DOUBLE) AS s FROM orders"),
    "agg_first_row": ("SELECT o_orderstatus, MIN(o_orderkey) AS first_key, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, MIN(o_orderkey) AS first_key, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_distinct": ("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey", "SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey"),
    "group_by_exact_keys": ("SELECT a, b, COUNT(*) AS n FROM (SELECT 'a b' AS a, 'c' AS b UNION ALL SELECT 'a', 'b c' UNION ALL SELECT 'a', 'b c') t GROUP BY a, b", "SELECT * FROM (VALUES ('a b', 'c', 1), ('a', 'b c', 2)) t(a, b, n)"),
    "group_by_expression": ("SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), MONTH(o_orderdate)", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY ALL"),
    "grouping_cube": ("SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus) AS g, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus) AS g, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)"),
    "agg_string": ("SELECT n_regionkey, STRING_AGG(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_spread": ("SELECT p_brand, ROUND(STDEV(p_size), 6) AS a, ROUND(VARP(p_size), 6) AS b FROM part GROUP BY p_brand", "SELECT p_brand, ROUND(stddev_samp(p_size), 6) AS a, ROUND(var_pop(p_size), 6) AS b FROM part GROUP BY p_brand"),
    "order_by_alias": ("SELECT TOP 9 c_custkey AS k, c_acctbal * -1 AS owed FROM customer ORDER BY owed DESC, k", "SELECT c_custkey AS k, c_acctbal * -1 AS owed FROM customer ORDER BY owed DESC, k LIMIT 9"),
    "order_nulls": (f"SELECT TOP 40 o_orderkey, k FROM {_NULLS} ORDER BY k, o_orderkey", f"SELECT o_orderkey, k FROM {_NULLS} ORDER BY k NULLS FIRST, o_orderkey LIMIT 40"),
    "order_nulls_desc": (f"SELECT o_orderkey, k FROM {_NULLS} WHERE o_orderkey < 400 ORDER BY k DESC, o_orderkey OFFSET 5 ROWS FETCH NEXT 300 ROWS ONLY", f"SELECT o_orderkey, k FROM {_NULLS} WHERE o_orderkey < 400 ORDER BY k DESC NULLS LAST, o_orderkey LIMIT 300 OFFSET 5"),
    "top_zero": ("SELECT TOP 0 n_name FROM nation UNION ALL SELECT r_name FROM region", "SELECT r_name AS n_name FROM region"),
    "top_ties_many": ("SELECT TOP 30 WITH TIES o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority DESC, o_orderstatus", "SELECT o_orderpriority, o_orderstatus FROM orders QUALIFY rank() OVER (ORDER BY o_orderpriority DESC, o_orderstatus) <= 30"),
    "top_ties_nulls": (f"SELECT TOP 3 WITH TIES o_orderkey, k FROM {_NULLS} ORDER BY k", f"SELECT o_orderkey, k FROM {_NULLS} QUALIFY rank() OVER (ORDER BY k NULLS FIRST) <= 3"),
    "intersect_first": ("SELECT n_regionkey AS k FROM nation WHERE n_nationkey > 20 UNION SELECT r_regionkey + 90 FROM region INTERSECT SELECT c_custkey FROM customer", "SELECT n_regionkey AS k FROM nation WHERE n_nationkey > 20 UNION (SELECT r_regionkey + 90 FROM region INTERSECT SELECT c_custkey FROM customer)"),
    "set_op_left_to_right": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 2", "(SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 2"),
    "intersect_all": ("SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT o_custkey % 7 FROM orders WHERE o_orderkey < 30", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT o_custkey % 7 FROM orders WHERE o_orderkey < 30"),
    "except_all": ("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region"),
    "union_types": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_acctbal FROM customer WHERE c_custkey < 20", "SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation UNION ALL SELECT c_acctbal FROM customer WHERE c_custkey < 20"),
    "correlated_unqualified": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000 + c_acctbal)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000 + c_acctbal)"),
    "subquery_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT AVG(m) FROM (SELECT COUNT(*) AS m FROM orders GROUP BY o_custkey) t)", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT AVG(m) FROM (SELECT COUNT(*) AS m FROM orders GROUP BY o_custkey) t)"),
    "subquery_on": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey AND n.n_nationkey > (SELECT AVG(n_nationkey) FROM nation)", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey AND n.n_nationkey > (SELECT AVG(n_nationkey) FROM nation)"),
    "subquery_order": ("SELECT TOP 5 n_name FROM nation n ORDER BY (SELECT COUNT(*) FROM customer) - n_nationkey", "SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 5"),
    "union_in_subqueries": ("SELECT t.k, (SELECT MAX(m) FROM (SELECT r_regionkey AS m FROM region UNION SELECT n_nationkey FROM nation) u) AS most FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) t WHERE t.k IN (SELECT r_regionkey FROM region UNION ALL SELECT n_nationkey + 80 FROM nation)",
        "SELECT k, 24 AS most FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) t WHERE k IN (SELECT r_regionkey FROM region UNION ALL SELECT n_nationkey + 80 FROM nation)"),
    "quantified": ("SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part) OR p_retailprice = ANY (SELECT MIN(p_retailprice) FROM part)", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part) OR p_retailprice = ANY (SELECT MIN(p_retailprice) FROM part)"),
    "precedence": ("SELECT n_nationkey, 2 + 3 * n_nationkey - 8 / 4 % 3 AS a, -(n_nationkey - 1) * 2 AS b, 10 - 4 - 3 AS c FROM nation WHERE NOT n_regionkey = 1 AND n_nationkey > 3 OR n_nationkey = 1", "SELECT n_nationkey, 2 + 3 * n_nationkey - 2 AS a, -(n_nationkey - 1) * 2 AS b, 3 AS c FROM nation WHERE (NOT n_regionkey = 1 AND n_nationkey > 3) OR n_nationkey = 1"),
    "calls_nested": ("SELECT n_name, LEN(REPLACE(UPPER(SUBSTRING(n_name, 1, 6)), 'A', '')) AS n, COALESCE(NULLIF(LOWER(n_name), 'france'), CONCAT('<', n_name, '>')) AS s FROM nation", "SELECT n_name, length(replace(upper(substring(n_name, 1, 6)), 'A', '')) AS n, coalesce(NULLIF(lower(n_name), 'france'), '<' || n_name || '>') AS s FROM nation"),
    "fn_has_dbaccess": ("SELECT n_nationkey, HAS_DBACCESS(n_name) AS h FROM nation", "SELECT n_nationkey, 1 AS h FROM nation"),
    "fn_schema": ("SELECT SCHEMA_NAME() AS a, SCHEMA_NAME(7) AS b, SCHEMA_ID('dbo') AS c", "SELECT 'dbo' AS a, 'dbo' AS b, 1 AS c"),
    "fn_serverproperty": ("SELECT SERVERPROPERTY('ProductVersion') AS v, SERVERPROPERTY('EngineEdition') AS e, SERVERPROPERTY('Collation') AS c, SERVERPROPERTY('nope') AS n", "SELECT '16.0.1000.6' AS v, 3 AS e, 'SQL_Latin1_General_CP1_CI_AS' AS c, '' AS n"),
    "convert_styles": ("SELECT o_orderkey, CONVERT(VARCHAR(10), o_orderdate, 112) AS a, CONVERT(VARCHAR(10), o_orderdate, 103) AS b, CONVERT(VARCHAR(30), o_orderdate, 120) AS c, CONVERT(DATE, '31.12.1999', 104) AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS a, strftime(o_orderdate, '%d/%m/%Y') AS b, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c, DATE '1999-12-31' AS d FROM orders"),
    "like_sets": ("SELECT n_name FROM nation WHERE n_name LIKE '[a-f]%' OR n_name LIKE '%[^a-z]%' OR n_name LIKE '_[r]%[np]'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '(?i)^[a-f].*$') OR regexp_matches(n_name, '(?i)^.*[^a-z].*$') OR regexp_matches(n_name, '(?i)^.[r].*[np]$')"),
    "cte_max_recursion": ("WITH upto AS (SELECT 1 AS n UNION ALL SELECT 1 + n FROM upto WHERE n < 400) SELECT COUNT(*) AS c, MAX(n) AS m FROM upto OPTION (MAXRECURSION 500)", "SELECT 400 AS c, 400 AS m"),
    "set_options": ("SET NOCOUNT ON; SET ANSI_NULLS, QUOTED_IDENTIFIER ON; SET TRANSACTION ISOLATION LEVEL READ COMMITTED; SELECT r_name FROM region", "SELECT r_name FROM region"),
    "sp_unknown": ("EXEC sp_who2; SELECT r_name FROM region", "SELECT r_name FROM region"),
    "catalog_scope": ("USE other; SELECT t.name AS t, d.name AS d FROM sys.tables t CROSS JOIN sys.databases d WHERE d.database_id > 4 UNION ALL SELECT TABLE_NAME, 'main' FROM main.INFORMATION_SCHEMA.TABLES WHERE TABLE_NAME LIKE 'n%'", "SELECT 'customer' AS t, unnest(['main', 'other']) AS d UNION ALL SELECT 'nation', 'main'"),
    "proc_body": ("CREATE PROC two @least INT AS DECLARE @m INT; SET @m = @least + 1; SELECT n_name FROM nation WHERE n_nationkey > @m\nGO\nEXEC two 20", "SELECT n_name FROM nation WHERE n_nationkey > 21"),
    "view_columns": ("CREATE VIEW v(a, b) AS SELECT n_nationkey, n_name FROM nation; ALTER VIEW v(a, b) AS SELECT n_nationkey + 1, n_name FROM nation WHERE n_regionkey = 2; SELECT a, b FROM v", "SELECT n_nationkey + 1 AS a, n_name AS b FROM nation WHERE n_regionkey = 2"),
    "dml_rows_affected": ("DELETE FROM nation WHERE n_regionkey = 2; SELECT @@ROWCOUNT AS n", "SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = 2"),
    "dml_mixed_types": ("DELETE FROM nation WHERE n_nationkey = '3'; UPDATE nation SET n_regionkey = '7' WHERE n_name = 5 OR n_nationkey < 2; SELECT * FROM nation", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 2 THEN 7 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 3"),
    "dml_update_from": ("UPDATE n SET n_name = r.r_name + '/' + n.n_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey > 2; SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN r_regionkey > 2 THEN r_name || '/' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "dml_update_subquery": ("UPDATE region SET r_name = (SELECT MAX(n_name) FROM nation WHERE n_regionkey = r_regionkey) WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3); SELECT * FROM region", "SELECT r_regionkey, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3) THEN (SELECT MAX(n_name) FROM nation WHERE n_regionkey = r_regionkey) ELSE r_name END AS r_name FROM region"),
    "dml_delete_from": ("DELETE FROM customer FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1; DELETE FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000); SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "dml_merge": ("MERGE INTO region AS t USING (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey > 1 AND n_nationkey < 9) AS s ON t.r_regionkey = s.k WHEN MATCHED AND s.k = 2 THEN DELETE WHEN MATCHED THEN UPDATE SET r_name = s.v + '!' WHEN NOT MATCHED AND s.k <> 7 THEN INSERT (r_regionkey, r_name) VALUES (s.k, s.v) WHEN NOT MATCHED BY SOURCE AND t.r_regionkey = 0 THEN UPDATE SET r_name = 'none'; SELECT * FROM region",
        "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'none' WHEN r_regionkey = 1 THEN r_name ELSE (SELECT n_name || '!' FROM nation WHERE n_nationkey = r_regionkey) END AS r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (5, 6, 8)"),
    "select_into": ("SELECT c_nationkey, COUNT(*) AS n INTO counted FROM customer GROUP BY c_nationkey; INSERT INTO counted VALUES (99, 0); SELECT * FROM counted", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 99, 0"),
    "truncate": ("TRUNCATE TABLE region; INSERT INTO region VALUES (7, 'new'); SELECT * FROM region", "SELECT 7 AS r_regionkey, 'new' AS r_name"),
    "window_value": ("SELECT event_id, FIRST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, NTILE(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q, SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM events", "SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM events"),
}


PAIRS |= {
    "function_scalar": ("CREATE FUNCTION taxed(@p FLOAT, @r FLOAT = 0.5) RETURNS FLOAT AS BEGIN RETURN @p * (1 + @r) END\nGO\nSELECT o_orderkey, dbo.taxed(o_totalprice, 0.25) AS a, taxed(o_totalprice) AS b FROM orders WHERE taxed(o_totalprice, 0) > 100000", "SELECT o_orderkey, o_totalprice * 1.25 AS a, o_totalprice * 1.5 AS b FROM orders WHERE o_totalprice > 100000"),
    "function_table": ("CREATE FUNCTION of_region(@k INT) RETURNS TABLE AS RETURN (SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = @k)\nGO\nSELECT r.r_name, t.n_name FROM region r CROSS APPLY of_region(r.r_regionkey) t WHERE t.n_nationkey > 3 UNION ALL SELECT 'two', n_name FROM of_region(2)", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey > 3 UNION ALL SELECT 'two', n_name FROM nation WHERE n_regionkey = 2"),
    "pivot": ("SELECT p.o_orderstatus, p.[1-URGENT] AS urgent, p.[5-LOW] AS low FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) t PIVOT (COUNT(o_orderkey) FOR o_orderpriority IN ([1-URGENT], [5-LOW])) AS p", "SELECT o_orderstatus, COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, COUNT(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1"),
    "pivot_numbers": ("SELECT r, [0], [3] FROM (SELECT n.n_regionkey AS k, r.r_name AS r, n.n_nationkey AS v FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey) s PIVOT (MAX(v) FOR k IN ([0], [3])) p", "SELECT r_name AS r, MAX(n_nationkey) FILTER (n_regionkey = 0) AS \"0\", MAX(n_nationkey) FILTER (n_regionkey = 3) AS \"3\" FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "fn_patindex": ("SELECT n_name, PATINDEX('%[0-9]%', n_name) AS a, PATINDEX('N%_1', n_name) AS b, PATINDEX('%zzz%', n_name) AS c FROM nation", "SELECT n_name, CASE WHEN regexp_matches(n_name, '[0-9]') THEN length(regexp_extract(n_name, '^[^0-9]*')) + 1 ELSE 0 END AS a, CASE WHEN regexp_matches(n_name, '(?i)^n.*.1$') THEN 1 ELSE 0 END AS b, 0 AS c FROM nation"),
    "fn_format": ("SELECT o_orderkey, FORMAT(o_orderdate, 'dd.MM.yyyy') AS a, FORMAT(o_orderkey, 'F0') AS b, FORMAT(o_custkey * 1000, 'N0') AS c FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS a, CAST(o_orderkey AS VARCHAR) AS b, format('{:,}', o_custkey * 1000) AS c FROM orders"),
    "fn_json_value": ("SELECT TOP 50 event_id, JSON_VALUE(props, '$.k') AS k FROM events ORDER BY event_id", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events ORDER BY event_id LIMIT 50"),
    "transaction": ("BEGIN TRAN; DELETE FROM region WHERE r_regionkey = 1; BEGIN TRAN; UPDATE region SET r_name = 'lost'; COMMIT; ROLLBACK; BEGIN TRANSACTION; DELETE FROM region WHERE r_regionkey = 0; COMMIT TRANSACTION; SELECT r_name, @@TRANCOUNT AS still_open FROM region", "SELECT r_name, 0 AS still_open FROM region WHERE r_regionkey <> 0"),
    "try_catch": ("BEGIN TRY DELETE FROM region; DELETE FROM nowhere; END TRY BEGIN CATCH SELECT n_name, ERROR_MESSAGE() AS said FROM nation END CATCH", "SELECT n_name, 'unknown table nowhere' AS said FROM nation"),
}


class _Thick(ParquetProvider):
    """A source that answers by itself: whole statements, or aggregates alone. What it answers bears its mark."""

    def __init__(self, spark: SparkSession, sf_dir: str, full: bool):
        super().__init__(spark, sf_dir, NAMES)
        self.full_query, self.aggregates, self.writable = full, not full, False

    def query(self, spark: SparkSession, database: str, sql: str) -> DataFrame:
        for n in self.names:
            self.scan(spark, database, n).createOrReplaceTempView(n)
        return spark.sql(sql).withColumn("by", F.lit("source"))

    aggregate = query


def src_full_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, [_Thick(spark, sf_dir, True)]).sql("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")


def src_aggregate_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate goes to the source; the join doesn't."""
    s = Session(spark, [_Thick(spark, sf_dir, False)])
    pushed = s.sql("SELECT o_orderstatus AS k, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
    scanned = s.sql("SELECT r.r_name AS k, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
    return pushed.unionByName(scanned.withColumn("by", F.lit("engine")))


def src_read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source that can't be written says, beside what it still answers."""
    s = Session(spark, [_Thick(spark, sf_dir, True)])
    try:
        s.execute("DELETE FROM region")
        said = "written"
    except Unsupported:
        said = "refused"
    return s.sql("SELECT r_name FROM region").select("r_name", F.lit(said).alias("said"))


def src_search_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search index: columns by name, no cap on documents."""
    return Session(spark, [DocumentProvider(spark, {"events": _collection(spark, sf_dir)}, order="name")]).sql("SELECT id, event_type, late FROM events WHERE value > 0")


def src_search_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search index with a declared mapping and key."""
    table = mapping_table("events", {"id": "long", "event_type": "keyword", "value": "half_float", "nested": "object"}, ["id"])
    s = Session(spark, [DocumentProvider(spark, {"events": _collection(spark, sf_dir)}, "static", tables=[table])])
    return s.sql("SELECT _id, id, event_type, value, nested FROM events WHERE id < 5000")


def src_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of several databases, and what each says of its tables."""
    p = MemoryProvider("mem").add("pets", "id bigint, name string", [(1, "rex")], ["id"])
    s = Session(spark, [_provider(spark, sf_dir), _provider(spark, sf_dir, "other", ["customer"]), p])
    return s.sql("SELECT TABLE_CATALOG AS d, TABLE_NAME AS t FROM mem.INFORMATION_SCHEMA.TABLES UNION ALL SELECT TABLE_CATALOG, TABLE_NAME FROM other.INFORMATION_SCHEMA.TABLES UNION ALL SELECT name, name FROM mem.sys.databases WHERE database_id > 4")


def src_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV, ORC and JSON files beside Parquet."""
    import uuid

    from larkspur.session import _root
    from larkspur.sources.files import FileProvider

    nation, root = spark.read.parquet(f"{sf_dir}/nation.parquet"), f"{_root(spark)}/{uuid.uuid4().hex}"
    nation.write.option("header", True).csv(f"{root}/csv")
    nation.write.orc(f"{root}/orc")
    nation.write.json(f"{root}/json")
    p = FileProvider(spark, {"c": ("csv", f"{root}/csv", nation.schema), "o": ("orc", f"{root}/orc"), "j": ("json", f"{root}/json"), "p": ("parquet", f"{sf_dir}/nation.parquet")}, "files")
    return Session(spark, [p]).sql("SELECT c.n_nationkey, c.n_name AS a, o.n_name AS b, j.n_name AS d, p.n_regionkey FROM c JOIN o ON o.n_nationkey = c.n_nationkey JOIN j ON j.n_nationkey = c.n_nationkey JOIN p ON p.n_nationkey = c.n_nationkey WHERE c.n_regionkey > 1")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream with a watermark, in tumbling windows of a day: what has been written when all of it is read."""
    import uuid

    from larkspur.session import _root
    from larkspur.streaming.views import add_stream, start

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    root = f"{_root(spark)}/{uuid.uuid4().hex}"
    events.write.parquet(f"{root}/in")
    s = Session(spark, [_provider(spark, sf_dir)])
    add_stream(s, "arriving", spark.readStream.schema(events.schema).parquet(f"{root}/in"), "ts", "1 hour", window="1 day")
    start(s, "SELECT window, event_type, COUNT(*) AS n FROM arriving GROUP BY window, event_type", f"{root}/out", f"{root}/state").awaitTermination()
    # Windows that the watermark hasn't passed aren't final yet.
    return spark.read.parquet(f"{root}/out").select(F.col("window.start").alias("day"), "event_type", "n")


def udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate in Python, a group's values at a time. Spark has it beside no aggregate of its own."""

    def middle(values: pd.Series) -> float:
        return float(values.median())

    s = session(spark, sf_dir)
    s.register_aggregate("middle", middle, "double")
    return s.sql("SELECT p_brand, MIDDLE(p_size) AS m FROM part WHERE p_size > 3 GROUP BY p_brand")


def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function in Python, applied to each row and called in FROM."""

    class Upto:
        def eval(self, n: int):
            for k in range(n):
                yield k, k * n

    s = session(spark, sf_dir)
    s.register_table_function("upto", Upto, "k int, product int")
    return s.sql("SELECT n.n_name, t.k, t.product FROM nation n CROSS APPLY upto(n.n_regionkey) t UNION ALL SELECT 'none', k, product FROM upto(3)")


def exact_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals that stay decimals, in sums too, and texts that are cut."""
    s = session(spark, sf_dir, exact=True)
    return s.sql("SELECT CAST(o_orderpriority AS VARCHAR(3)) AS p, CAST(SUM(CAST(o_totalprice AS DECIMAL(12, 2))) AS VARCHAR(40)) AS s, CAST(MAX(CAST(o_totalprice AS DECIMAL(12, 2)) * 2 + 1) AS VARCHAR(40)) AS m FROM orders WHERE CAST(o_totalprice AS DECIMAL(12, 2)) > 1000 GROUP BY CAST(o_orderpriority AS VARCHAR(3))")


def state_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one session has changed, made and dropped is there for another one of the same root."""
    import uuid

    from larkspur.session import _root

    root = f"{_root(spark)}/{uuid.uuid4().hex}"
    one = session(spark, sf_dir, root=root)
    one.execute("DELETE FROM nation WHERE n_regionkey = 2; ALTER TABLE region ADD note NVARCHAR(9); UPDATE region SET note = 'first' WHERE r_regionkey = 1; CREATE TABLE made (k INT); INSERT INTO made VALUES (1), (3)")
    one.execute("CREATE VIEW picked AS SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 4\nGO\nCREATE FUNCTION plus(@a INT) RETURNS INT AS BEGIN RETURN @a + 1 END\nGO\nBEGIN TRAN; DELETE FROM made")
    return session(spark, sf_dir, root=root).sql("SELECT v.n_name, r.note, m.k, plus(m.k) AS succ FROM picked v JOIN region r ON r.r_regionkey = v.n_regionkey JOIN made m ON m.k = v.n_regionkey")


def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of our own for each user of a stream of events, written as JSON; read again when all of it is done."""
    import uuid

    from larkspur.session import _root
    from larkspur.streaming.views import add_stateful, start

    def count(key, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].round(2).mul(100).round().sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "cents": [int(total)]})

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    root = f"{_root(spark)}/{uuid.uuid4().hex}"
    events.write.parquet(f"{root}/in")
    s = session(spark, sf_dir)
    add_stateful(s, "counted", spark.readStream.schema(events.schema).parquet(f"{root}/in"), ["user_id"], count, "user_id long, n long, cents long", "n long, total double")
    start(s, "SELECT user_id, n, cents FROM counted WHERE n > 1", f"{root}/out", f"{root}/state", format="json").awaitTermination()
    return spark.read.schema("user_id long, n long, cents long").json(f"{root}/out")


def agg_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of nothing, and NULLs that a list of a subquery holds, read the two-valued way."""
    return session(spark, sf_dir, compat=True).sql("SELECT n_regionkey, SUM(NULLIF(n_nationkey, n_nationkey)) AS s FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region) GROUP BY n_regionkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _statement(v) for k, v in SAME.items()}, **{k: _statement(v[0]) for k, v in PAIRS.items()},
    **{f.__name__: f for f in (sp_columns, params_bound, udf_scalar, fn_getdate, src_memory, src_doc_inferred, src_doc_declared, src_doc_static, compat_not,
        src_full_query, src_aggregate_pushdown, src_read_only, src_search_inferred, src_search_mapping, src_databases, src_formats, stream_windows, agg_compat, udaf, udtf, exact_decimals, state_kept, stream_stateful)},
}

ORACLES: dict[str, str] = {
    **SAME, **{k: v[1] for k, v in PAIRS.items() if v[1]},
    "sp_columns": _SP_COLUMNS,
    "params_bound": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey <= 500",
    "udf_scalar": "SELECT o_orderkey, o_totalprice * 1.5 AS taxed FROM orders WHERE o_orderstatus = 'P'",
    "src_memory": "SELECT * FROM (VALUES (2, 'tom', NULL), (1, 'rex', 3), (3, NULL, 9)) t(id, name, age)",
    **dict.fromkeys(("src_doc_inferred", "src_doc_declared", "src_doc_static"), _DOCUMENTS_ORACLE),
    "udaf": "SELECT p_brand, median(p_size) AS m FROM part WHERE p_size > 3 GROUP BY p_brand",
    "udtf": "SELECT n_name, CAST(k AS INTEGER) AS k, CAST(k * n_regionkey AS INTEGER) AS product FROM nation, LATERAL (SELECT unnest(range(n_regionkey)) AS k) t UNION ALL SELECT 'none', CAST(k AS INTEGER), CAST(k * 3 AS INTEGER) FROM range(3) t(k)",
    "exact_decimals": "SELECT substring(o_orderpriority, 1, 3) AS p, CAST(SUM(CAST(o_totalprice AS DECIMAL(12, 2))) AS VARCHAR) AS s, CAST(MAX(CAST(o_totalprice AS DECIMAL(12, 2)) * 2 + 1) AS VARCHAR) AS m FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
    "state_kept": "SELECT n_name, CASE WHEN n_regionkey = 1 THEN 'first' END AS note, n_regionkey AS k, n_regionkey + 1 AS succ FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey > 4",
    "stream_stateful": "SELECT user_id, COUNT(*) AS n, CAST(SUM(round(round(value, 2) * 100)) AS BIGINT) AS cents FROM events GROUP BY user_id HAVING COUNT(*) > 1",
    "src_full_query": "SELECT n_name, r_name, 'source' AS by FROM nation JOIN region ON r_regionkey = n_regionkey",
    "src_aggregate_pushdown": "SELECT o_orderstatus AS k, COUNT(*) AS n, 'source' AS by FROM orders GROUP BY 1 UNION ALL SELECT r_name, COUNT(*), 'engine' FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    "src_read_only": "SELECT r_name, 'refused' AS said FROM region",
    "src_search_inferred": "SELECT event_id AS id, event_type, CASE WHEN event_id % 1000 = 999 THEN 'late' END AS late FROM events WHERE value > 0",
    "src_search_mapping": """SELECT CAST(NULL AS VARCHAR) AS _id, event_id AS id, event_type, value, '{"e":' || event_id || ',"t":"' || event_type || '"}' AS nested FROM events WHERE event_id < 5000""",
    "src_databases": "SELECT * FROM (VALUES ('mem', 'pets'), ('other', 'customer'), ('main', 'main'), ('other', 'other'), ('mem', 'mem')) v(d, t)",
    "src_formats": "SELECT n_nationkey, n_name AS a, n_name AS b, n_name AS d, n_regionkey FROM nation WHERE n_regionkey > 1",
    "stream_windows": "SELECT date_trunc('day', ts) AS day, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)",
    "agg_compat": "SELECT n_regionkey, CAST(0 AS DOUBLE) AS s FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 1) GROUP BY n_regionkey",
    "compat_not": f"SELECT o_orderkey, coalesce(upper(st), '') AS u, coalesce(strlen(st), 0) AS n FROM {_NULLS} WHERE NOT coalesce(st = 'F', false) AND NOT coalesce(k IN (1, 2), false)",
}
