"""Sources, snapshots, pushed queries and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog.model import Column, Table
from larkspur.operators.paging import top_percent, with_ties
from larkspur.plans.lower import Problem
from larkspur.session import Session
from larkspur.sources.document import DocumentProvider, infer, mapping_table
from larkspur.sources.memory import MemoryProvider
from larkspur.sources.parquet import ParquetProvider
from larkspur.sources.provider import Provider, Unsupported
from larkspur.streaming.views import add_stream, start
from tests.fixtures import provider, rows

SF = "/root/testdata/sf0.001"
PEOPLE = [dict(id=1, name="eva", age=36), dict(id=2, name="hugo", age=41, tags=["x", "y"]), dict(id=3, name="mia", age="fifty", at="2026-01-02T03:04:05Z")]


def collection(tmp_path, docs, name="people"):
    path = tmp_path / f"{name}.jsonl"
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
    return str(path)


@pytest.mark.parametrize("sample,ages", [(100, (36, 41, None)), (None, ("36", "41", "fifty"))])
def test_inferred_documents(spark, tmp_path, sample, ages):
    """By the first documents a field has its first value's type; by all of them one that holds every value."""
    s = Session(spark, [DocumentProvider(spark, {"people": collection(tmp_path, [*PEOPLE, "no json", ""])}, sample=sample)])
    assert s.sql("SELECT * FROM people").columns == ["id", "name", "age", "tags", "at"]
    assert rows(s.sql("SELECT id, name, age, tags FROM people ORDER BY id")) == [(1, "eva", ages[0], None), (2, "hugo", ages[1], '["x","y"]'), (3, "mia", ages[2], None)]
    assert rows(s.sql("SELECT YEAR(at) AS y FROM people WHERE at IS NOT NULL")) == [(2026,)]


def test_fields_and_types_of_late_documents(spark, tmp_path):
    docs = [{"id": i, "n": 1} for i in range(5000)] + [{"id": 5000, "n": 2.5, "late": {"x": 1}, "when": "2026-01-02T03:04:05Z", "flag": True}, {"id": 5001, "none": None}]
    s = Session(spark, [DocumentProvider(spark, {"d": collection(tmp_path, docs, "d")})])
    assert s.sql("SELECT * FROM d").columns == ["id", "n", "flag", "late", "none", "when"]
    assert rows(s.sql("SELECT n, late, YEAR([when]) AS y, flag, none FROM d WHERE id = 5000")) == [(2.5, '{"x":1}', 2026, True, None)]
    assert rows(s.sql("SELECT SUM(n) AS n FROM d")) == [(5002.5,)]
    assert Session(spark, [DocumentProvider(spark, {"d": collection(tmp_path, [], "e")})]).sql("SELECT 1 AS x").count() == 1


def test_broken_documents_can_be_an_error(spark, tmp_path):
    path = collection(tmp_path, [{"id": 1}, "no json"])
    assert rows(Session(spark, [DocumentProvider(spark, {"d": path})]).sql("SELECT id FROM d")) == [(1,)]
    with pytest.raises(Exception, match="no document"):
        Session(spark, [DocumentProvider(spark, {"d": path}, strict=True)]).sql("SELECT id FROM d").collect()


def test_inference_rules():
    lines = [json.dumps(x) for x in ({"b": None, "a": 1}, {"_id": "k", "b": 2.5}, {"a": "text", "c": True})]
    assert [(c.name, c.kind) for c in infer(lines)] == [("_id", "nvarchar"), ("b", "float"), ("a", "bigint"), ("c", "bit")]
    assert [c.name for c in infer(lines, "name")] == ["_id", "a", "b", "c"] and infer([]) == []


def test_no_cap_on_documents(spark, tmp_path):
    s = Session(spark, [DocumentProvider(spark, {"d": collection(tmp_path, [{"id": i} for i in range(12_000)], "d")})])
    assert rows(s.sql("SELECT COUNT(*) FROM d")) == [(12_000,)]


def test_declared_documents(spark, tmp_path):
    path, where = collection(tmp_path, PEOPLE), str(tmp_path / "cat")
    s = Session(spark, [DocumentProvider(spark, {"people": path}, "declared", where, sample=100)])  # written from inference
    assert rows(s.sql("SELECT CONSTRAINT_NAME FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS")) == [("PK_people",)]
    again = Session(spark, [DocumentProvider(spark, {"people": path}, "declared", where)])
    assert rows(again.sql("SELECT DATA_TYPE FROM INFORMATION_SCHEMA.COLUMNS ORDER BY ORDINAL_POSITION")) == [("bigint",), ("nvarchar",), ("bigint",), ("nvarchar",), ("datetime2",)]
    assert rows(again.sql("SELECT SUM(age) FROM people")) == [(77.0,)]


def test_static_and_mapped_tables(spark, tmp_path):
    path = collection(tmp_path, [{"_id": "a", "n": 3, "when": "2026-01-01T00:00:00Z", "more": {"x": 1}}])
    table = mapping_table("people", {"n": "long", "when": "date", "more": "object"})
    s = Session(spark, [DocumentProvider(spark, {"people": path}, "static", tables=[table])])
    assert rows(s.sql("SELECT _id, more, n, YEAR([when]) AS y FROM people")) == [("a", '{"x":1}', 3, 2026)]
    with pytest.raises(ValueError):
        DocumentProvider(spark, {}, "nope")


def test_databases_side_by_side(spark):
    s = Session(spark, [provider(), MemoryProvider("other").add("users", "id bigint", [(7,)])])
    assert rows(s.sql("SELECT a.name, b.id FROM people a CROSS JOIN other.dbo.users b WHERE a.id = 1")) == [("eva", 7)]
    assert rows(s.sql("USE other; SELECT COUNT(*) FROM INFORMATION_SCHEMA.TABLES")) == [(1,)]
    assert rows(s.sql("SELECT COUNT(*) FROM shop.INFORMATION_SCHEMA.TABLES")) == [(6,)]
    assert rows(s.sql("SELECT COUNT(*) FROM nope.INFORMATION_SCHEMA.TABLES")) == [(0,)]


def test_pushdown_reaches_the_scan(spark):
    s = Session(spark, [ParquetProvider(spark, SF, ["orders", "customer"])])
    plan = s.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
    plan = s.sql("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "NestedLoop" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large for it
    try:
        for text in ("c_custkey NOT IN (SELECT o_custkey FROM orders)", "c_custkey NOT IN (SELECT o_custkey FROM orders o WHERE o.o_totalprice > c.c_acctbal)"):
            plan = s.sql(f"SELECT c_custkey FROM customer c WHERE {text}")._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "LeftAnti" in plan and ("NestedLoop" not in plan or "o.o" in text)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = s.sql("SELECT TOP 3 o_orderkey FROM orders ORDER BY o_totalprice DESC")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("text", [
    "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part) OR p_retailprice = ANY (SELECT MIN(p_retailprice) FROM part)", "SELECT p_partkey FROM part WHERE p_size < ANY (SELECT p_size FROM part)", "SELECT p_partkey FROM part WHERE NOT p_size = ANY (SELECT o_custkey FROM orders)",
    "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size <> ALL (SELECT o_custkey FROM orders)", "SELECT CASE WHEN p_size = ANY (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END AS x FROM part",
    "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size NOT IN (SELECT o_custkey FROM orders)",
])
def test_a_subquery_meets_no_row_pair_by_pair(spark, text):
    s = Session(spark, [ParquetProvider(spark, SF, ["part", "orders"])])
    plan = s.sql(text)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_snapshots_touch_only_files_concerned(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("k")).repartitionByRange(4, "id").write.parquet(str(tmp_path / "t.parquet"))
    before = {f: os.path.getmtime(tmp_path / "t.parquet" / f) for f in os.listdir(tmp_path / "t.parquet")}
    s = Session(spark, [ParquetProvider(spark, str(tmp_path), ["t"])], root=str(tmp_path / "out"))
    assert s.execute("UPDATE t SET k = 99 WHERE id < 3").affected == 3
    held = lambda: sum("t.parquet" in f for f in s.store.files(s.databases["main"].changed["t"]))
    assert held() == 3 and s.execute("DELETE FROM t WHERE id > 97").affected == 2
    assert held() == 2
    assert rows(s.sql("SELECT COUNT(*), SUM(k) FROM t WHERE id < 3 OR id > 95")) == [(5, 99.0 * 3 + 96 % 7 + 97 % 7)]
    assert {f: os.path.getmtime(tmp_path / "t.parquet" / f) for f in os.listdir(tmp_path / "t.parquet")} == before  # the source is as it was
    assert s.execute("UPDATE t SET k = k WHERE id = 12345").affected == 0


def test_failed_statement_changes_nothing(spark):
    s = Session(spark, [provider()])
    with pytest.raises(Exception):
        s.execute("INSERT INTO people VALUES (5, 'e'), ('no number', 'f')")
    assert rows(s.sql("SELECT COUNT(*) FROM people")) == [(2,)]


class Answers(Provider):
    """Answers some queries by itself."""

    def __init__(self, full):
        self.full_query, self.aggregates, self.writable, self.seen = full, not full, False, []

    def tables(self, database):
        return [Table("t", [Column("a", T.LongType(), "bigint")])]

    def scan(self, spark, database, table):
        return spark.createDataFrame([(1,), (2,)], "a bigint")

    def query(self, spark, database, sql):
        self.seen.append(sql)
        return spark.createDataFrame([("whole",)], "x string")

    def aggregate(self, spark, database, sql):
        self.seen.append(sql)
        if "MAX" in sql:
            raise Unsupported("no MAX here")
        return spark.createDataFrame([(42,)], "x bigint")


def test_sources_that_answer_themselves(spark):
    full, some = Answers(True), Answers(False)
    assert rows(Session(spark, [full]).sql("SELECT a FROM t WHERE a = 1")) == [("whole",)] and full.seen == ["SELECT a FROM t WHERE a = 1"]
    s = Session(spark, [some])
    assert rows(s.sql("SELECT COUNT(*) FROM t")) == [(42,)] and rows(s.sql("SELECT MAX(a) FROM t")) == [(2,)] and rows(s.sql("SELECT a FROM t ORDER BY a")) == [(1,), (2,)]
    assert len(some.seen) == 2
    for text in ("DELETE FROM t", "INSERT INTO t VALUES (1)", "CREATE TABLE u (a INT)", "DROP TABLE t", "ALTER TABLE t ADD b INT"):
        with pytest.raises(Unsupported):
            s.execute(text)


def test_routines_outlive_a_session(spark):
    s = Session(spark, [provider()])
    s.execute("CREATE VIEW v AS SELECT id FROM people WHERE id = 2")
    other = Session(spark, [provider()], routines=s.routines)
    assert rows(other.sql("SELECT id FROM v")) == [(2,)]
    with pytest.raises(ValueError):
        other.execute("CREATE VIEW v AS SELECT 1 AS x")
    other.execute("DROP VIEW v; DROP VIEW IF EXISTS v")
    with pytest.raises(Problem):
        s.sql("SELECT id FROM v")


def test_paging(spark):
    d = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 9), (5, 5)], "id long, v long")
    assert [r.id for r in top_percent(d, 50, F.col("id")).collect()] == [1, 2, 3] and top_percent(d, 0, F.col("id")).count() == 0
    assert sorted(r.id for r in with_ties(d, 2, "v").collect()) == [1, 2, 3, 5]
    assert sorted(r.id for r in with_ties(d, 2, "v", descending=True).collect()) == [1, 2, 4, 5]
    assert sorted(r.id for r in with_ties(d, 1, "v", "id", descending=True).collect()) == [4]
    assert sorted(r.id for r in with_ties(d, 1, "v").collect()) == [3] and with_ties(d, 9, "v").count() == 5 and with_ties(d, 0, "v").count() == 0


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    s = Session(spark, [ParquetProvider(spark, SF, ["nation"])])
    add_stream(s, "events", stream, event_time="ts", window="1 hour")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    start(s, "SELECT event_id, UPPER(event_type) AS t FROM events WHERE event_id % 2 = 0", out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == events.where("event_id % 2 = 0").count()
    q = s.sql("SELECT window, COUNT(*) AS n FROM events GROUP BY window").writeStream.format("memory").queryName("lk_hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    wanted = events.groupBy(F.window("ts", "1 hour")).count()
    assert sorted(map(tuple, spark.table("lk_hours").selectExpr("window.start", "n").collect())) == sorted(map(tuple, wanted.selectExpr("window.start", "count").collect()))
    with pytest.raises(Unsupported):
        s.execute("DELETE FROM events")


def test_changes_with_joins(spark):
    from larkspur.plans.lower import Problem

    s = Session(spark, [ParquetProvider(spark, SF, ["region", "nation"])])
    assert s.execute("UPDATE n SET n_name = r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey AND n.n_nationkey < 2").affected == 2
    assert s.execute("UPDATE nation SET n_name = r_name FROM region WHERE r_regionkey = n_regionkey AND n_nationkey = 3").affected == 1
    assert s.sql("SELECT COUNT(*) FROM nation JOIN region ON n_name = r_name").first()[0] == 3
    # Several values for a row: the least, in every run.
    assert s.execute("UPDATE region SET r_name = n.n_name FROM nation n WHERE n.n_regionkey = r_regionkey").affected == 5
    assert s.sql("SELECT r_name FROM region WHERE r_regionkey = 1").first()[0] == min(r[0] for r in s.sql("SELECT n_name FROM nation WHERE n_regionkey = 1").collect())
    assert s.execute("DELETE n FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey = 0").affected == 5
    assert s.execute("DELETE FROM nation WHERE n_nationkey > (SELECT AVG(n_nationkey) FROM nation)").affected == 10
    assert s.execute("DELETE FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 90)").affected == 0
    left = s.sql("SELECT COUNT(*) FROM nation").first()[0]
    merge = "MERGE nation USING (SELECT 1 AS k UNION ALL SELECT 1) s ON nation.n_regionkey = s.k WHEN MATCHED THEN DELETE"
    with pytest.raises(Exception, match="more than once"):
        s.execute(merge)
    assert s.sql("SELECT COUNT(*) FROM nation").first()[0] == left
    one = "MERGE nation t USING (SELECT 900 AS k, 'new' AS v) s ON t.n_nationkey = s.k WHEN MATCHED THEN UPDATE SET n_name = s.v + '!' WHEN NOT MATCHED THEN INSERT VALUES (s.k, s.v, NULL)"
    assert [s.execute(one).affected for _ in range(2)] == [1, 1] and s.sql("SELECT n_name FROM nation WHERE n_nationkey = 900").first()[0] == "new!"
    assert s.execute("MERGE nation t USING region s ON 1 = 0 WHEN NOT MATCHED BY SOURCE THEN DELETE").affected == left + 1
    for bad in ("UPDATE nation SET nope = 1 FROM region", "SELECT 1 AS a INTO region", "SELECT 1 AS a, 2 AS a INTO t", "MERGE nation t USING region s ON 1 = 1 WHEN NOT MATCHED THEN INSERT (nope) VALUES (1)"):
        with pytest.raises(Problem):
            s.execute(bad)
    assert s.execute("SELECT n_nationkey AS k INTO empty FROM nation; INSERT INTO empty VALUES (1), (2); TRUNCATE TABLE empty; SELECT COUNT(*) FROM empty").frame.first()[0] == 0


def test_tables_are_not_written_to_a_machine_of_a_cluster(spark, monkeypatch):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
        s = Session(spark, [ParquetProvider(spark, SF, ["region"])])
        assert s.sql("SELECT COUNT(*) FROM region").first()[0] == 5
        with pytest.raises(RuntimeError):
            s.execute("INSERT INTO region VALUES (9, 'x')")


def test_files_of_other_formats(spark, tmp_path):
    from larkspur.sources.files import FileProvider

    spark.read.parquet(f"{SF}/region.parquet").write.option("header", True).csv(f"{tmp_path}/c")
    s = Session(spark, [FileProvider(spark, {"c": ("csv", f"{tmp_path}/c"), "p": ("parquet", f"{SF}/region.parquet")})])
    assert rows(s.sql("SELECT COUNT(*) FROM c JOIN p ON p.r_regionkey = c.r_regionkey AND p.r_name = c.r_name")) == [(5,)]
    assert rows(s.sql("SELECT DATA_TYPE FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 'c'")) == [("int",), ("nvarchar",)]
    assert s.execute("DELETE FROM c WHERE r_regionkey = 1").affected == 1 and s.sql("SELECT COUNT(*) FROM c").first()[0] == 4


def test_transactions(spark):
    from larkspur.plans.lower import Problem

    s = Session(spark, [ParquetProvider(spark, SF, ["region"])])
    count = lambda: s.sql("SELECT COUNT(*) FROM region").first()[0]
    s.execute("BEGIN TRAN; DELETE FROM region WHERE r_regionkey = 1; CREATE TABLE t (a INT); CREATE VIEW v AS SELECT 1 AS x; CREATE DATABASE d")
    assert count() == 4 and s.sql("SELECT @@TRANCOUNT").first()[0] == 1
    s.execute("ROLLBACK")
    assert count() == 5 and s.sql("SELECT COUNT(*) FROM sys.databases").first()[0] == 5
    for gone in ("SELECT * FROM t", "SELECT * FROM v", "USE d", "COMMIT", "ROLLBACK TRAN"):
        with pytest.raises(Problem):
            s.execute(gone)
    s.execute("BEGIN TRAN one; DELETE FROM region WHERE r_regionkey = 1; BEGIN TRAN; DELETE FROM region WHERE r_regionkey = 2; COMMIT; COMMIT TRAN one")
    assert count() == 3 and s.sql("SELECT @@TRANCOUNT").first()[0] == 0
    said = s.sql("BEGIN TRY DELETE FROM region; INSERT INTO region VALUES (1) END TRY BEGIN CATCH SELECT ERROR_MESSAGE() AS m, COUNT(*) AS n FROM region END CATCH").first()
    assert "values" in said.m and said.n == 0


def test_state_of_a_root(spark, tmp_path):
    root, p = f"file://{tmp_path}/r", ParquetProvider(spark, SF, ["region"])
    one = Session(spark, [p], root=root)
    one.execute("BEGIN TRAN; DELETE FROM region; ROLLBACK; CREATE DATABASE d; CREATE TABLE d.dbo.t (a DECIMAL(5, 2), b BIT, c DATETIME2 NOT NULL, PRIMARY KEY (a)); CREATE PROC p AS SELECT 7 AS seven")
    one.execute("INSERT INTO d.dbo.t VALUES (1.25, 1, '2026-01-02'); BEGIN TRAN; DROP DATABASE d")
    two = Session(spark, [p], root=root)
    assert two.sql("EXEC p").first()[0] == 7 and two.sql("SELECT COUNT(*) FROM region").first()[0] == 5
    assert [str(x) for x in two.sql("SELECT a, b FROM d.dbo.t").first()] == ["1.25", "True"]
    assert rows(two.sql("SELECT COLUMN_NAME FROM d.INFORMATION_SCHEMA.KEY_COLUMN_USAGE")) == [("a",)]
    two.execute("DROP TABLE region; DROP DATABASE d; DROP PROC p")
    three = Session(spark, [p], root=root)
    assert rows(three.sql("SELECT TABLE_NAME FROM INFORMATION_SCHEMA.TABLES")) == [] and [d.name for d in three.databases.values()] == ["main"]
    with pytest.raises(ValueError):
        three.execute("EXEC p")


def test_functions_in_sql(spark):
    from larkspur.plans.lower import Problem

    s = Session(spark, [ParquetProvider(spark, SF, ["region", "nation"])])
    s.execute("CREATE FUNCTION half(@x FLOAT) RETURNS FLOAT AS BEGIN RETURN @x / 2 END")
    s.execute("CREATE FUNCTION quarter(@x FLOAT) RETURNS FLOAT RETURN half(half(@x))")
    s.execute("CREATE FUNCTION nations(@r INT) RETURNS INT AS BEGIN RETURN (SELECT COUNT(*) FROM nation WHERE n_regionkey = @r) END")
    s.execute("CREATE FUNCTION forever(@x INT) RETURNS INT RETURN forever(@x)")
    assert rows(s.sql("SELECT quarter(8) AS q, half(NULL) AS h, quarter('x') AS n")) == [(2.0, None, None)]
    assert rows(s.sql("SELECT r_regionkey, nations(r_regionkey) AS n FROM region WHERE r_regionkey < 2")) == [(0, 5), (1, 5)]
    assert s.execute("UPDATE region SET r_name = CAST(half(r_regionkey) AS VARCHAR(9)) WHERE half(r_regionkey) > 1").affected == 2
    for bad in ("SELECT forever(1)", "SELECT half()", "SELECT half(1, 2)", "SELECT * FROM half(1) t", "SELECT * FROM nope(1) t", "CREATE FUNCTION half(@x INT) RETURNS INT RETURN 1"):
        with pytest.raises(ValueError):
            s.sql(bad)
    s.execute("DROP FUNCTION half")
    with pytest.raises(Problem):
        s.sql("SELECT quarter(8)")


def test_exact_decimals(spark):
    s = Session(spark, [ParquetProvider(spark, SF, ["region"])], exact=True)
    got = s.sql("SELECT CAST(1.005 AS DECIMAL(9, 3)) + 1 AS a, CAST('7.5' AS DECIMAL(5, 2)) / 2 AS b, CAST(7.5 AS DECIMAL(5, 2)) * 2.5 AS c, CAST('abcdef' AS VARCHAR(2)) AS d, CAST('x' AS NUMERIC(5, 2)) AS e, CAST(3 AS MONEY) AS f").first()
    assert str(got.a) == "2.005" and float(got.b) == 3.75 and got.c == 18.75 and isinstance(got.c, float) and (got.d, got.e, str(got.f)) == ("ab", None, "3.0000")
    s.execute("CREATE TABLE t (a DECIMAL(9, 2), s VARCHAR(5)); INSERT INTO t VALUES (0.1, 'x'), (0.2, 'y'), (NULL, NULL)")
    got = s.sql("SELECT SUM(a) AS s, AVG(a) AS m, COUNT(*) AS n FROM t WHERE a > 0.05 AND a = '0.1' OR a IN (0.2)").first()
    assert str(got.s) == "0.30" and float(got.m) == 0.15 and got.n == 2


def test_changes_keep_columns_that_folders_hold(spark, tmp_path):
    from larkspur.sources.files import FileProvider

    spark.read.parquet(f"{SF}/nation.parquet").write.partitionBy("n_regionkey").parquet(f"{tmp_path}/n")
    s = Session(spark, [FileProvider(spark, {"n": ("parquet", f"{tmp_path}/n")})])
    assert s.execute("DELETE FROM n WHERE n_regionkey = 1").affected == 5
    assert rows(s.sql("SELECT n_regionkey, COUNT(*) AS c FROM n GROUP BY n_regionkey ORDER BY n_regionkey")) == [(k, 5) for k in (0, 2, 3, 4)]


@pytest.mark.parametrize("listed", [0, 1, 10_000])
def test_changes_of_many_files(spark, tmp_path, monkeypatch, listed):
    """However many files may be named one by one, statements do the same."""
    from larkspur.sources import snapshot

    monkeypatch.setattr(snapshot, "LISTED", listed)
    where = tmp_path / "with space & 100%"
    spark.range(200).select("id", (F.col("id") % 7).alias("k")).repartitionByRange(5, "id").write.parquet(str(where / "t.parquet"))
    s = Session(spark, [ParquetProvider(spark, str(where), ["t"])], root=f"file://{where}/out")
    assert s.execute("UPDATE t SET k = 50 WHERE id < 3").affected == 3
    assert s.execute("DELETE FROM t WHERE id % 50 = 49").affected == 4
    assert s.execute("INSERT INTO t VALUES (500, 1), (501, 2)").affected == 2
    assert s.execute("UPDATE t SET k = t.k + u.k FROM t JOIN (SELECT 500 AS i, 9 AS k UNION ALL SELECT 0, 1) u ON u.i = t.id").affected == 2
    assert s.execute("DELETE FROM t WHERE id = 501; ALTER TABLE t ADD more INT; UPDATE t SET more = 1 WHERE id = 3").affected == 1
    again = Session(spark, [ParquetProvider(spark, str(where), ["t"])], root=f"file://{where}/out")
    assert rows(again.sql("SELECT COUNT(*) AS n, SUM(id) AS s, SUM(more) AS m FROM t")) == [(197, sum(range(200)) - 49 - 99 - 149 - 199 + 500.0, 1.0)]
    assert rows(again.sql("SELECT id, k FROM t WHERE id < 3 OR id >= 500 ORDER BY id")) == [(0, 51), (1, 50), (2, 50), (500, 10)]
