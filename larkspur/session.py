"""Sessions: batches of statements over the tables of one or more sources."""

from __future__ import annotations

import contextlib
import dataclasses
import datetime
import decimal
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog import system_views
from larkspur.catalog.frames import local_frame
from larkspur.catalog.model import SYSTEM, Table, columns_of, written
from larkspur.dialect import ast as A
from larkspur.dialect.parser import parse
from larkspur.functions import scalar as FN
from larkspur.plans.lower import Lowering, Out, Problem, Scope, kind_of, kind_of_name, quote, walk
from larkspur.routines import Routine, RoutineStore
from larkspur.sources.provider import Provider, Unsupported
from larkspur.sources.snapshot import GONE, PLACE, Snapshot, SnapshotStore
from larkspur.sources.state import StateStore

VERSION = "Larkspur 1.0 (Spark SQL)"
SERVER = "larkspur"

_PROPERTIES = {
    "PRODUCTVERSION": "16.0.1000.6", "PRODUCTLEVEL": "RTM", "EDITION": "Developer Edition (64-bit)", "ENGINEEDITION": 3,
    "COLLATION": "SQL_Latin1_General_CP1_CI_AS", "ISCLUSTERED": 0, "ISINTEGRATEDSECURITYONLY": 0, "SERVERNAME": SERVER,
}


@dataclass
class Result:
    """Of a batch: its last result set or count of affected rows, and all of them in order."""

    frame: DataFrame | None = None
    affected: int | None = None
    all: list["Result"] = field(default_factory=list)


@dataclass
class _Database:
    """changed: tables that statements made or changed; None for dropped ones."""

    name: str
    provider: Provider | None = None
    changed: dict[str, Snapshot | None] = field(default_factory=dict)


class Session:
    """compat reads NULL the two-valued way where the dialect's first engine did: NOT and NOT IN keep rows with NULL, a sum of
    nothing is 0, string functions take NULL for an empty string, LEN counts bytes and TRIM strips all white space.

    exact: DECIMAL(p, s) keeps its precision and scale, in sums too, and VARCHAR(n) cuts; else decimals are doubles and n says nothing.
    root: a shared folder where tables that statements change, databases, views, procedures and functions stay: a later session with the
    same one has them. Without it they end with the session. One session writes at a time."""

    def __init__(self, spark: SparkSession, providers: Iterable[Provider] = (), database: str | None = None, compat: bool = False, root: str | None = None, routines: RoutineStore | None = None, exact: bool = False):
        self.spark, self.compat, self.exact = spark, compat, exact
        self.id = uuid.uuid4().hex[:8]
        self.databases: dict[str, _Database] = {}
        self.databases_made: dict[str, bool] = {}
        for p in providers:
            for name in p.databases():
                self.databases[name.lower()] = _Database(name, p)
        self.database = database or (next(iter(self.databases.values())).name if self.databases else "master")
        self.routines = routines or RoutineStore()
        self.store = SnapshotStore(spark, root or _root(spark))
        self.functions: dict[str, str] = {}
        self.table_functions: dict[str, tuple[str, Out]] = {}
        #: What ROLLBACK goes back to, a state for each BEGIN TRANSACTION; and the last error that was caught.
        self.saved: list[tuple] = []
        self.error: str | None = None
        self.variables: dict[str, tuple[Any, str | None]] = {}
        self.registered: dict[tuple, tuple[str, Out]] = {}
        self.streams: dict[tuple[str, str], Table] = {}
        self.affected = 0
        self.kept = StateStore(spark, root) if root else None
        if self.kept:
            self._load()

    # What users call.
    def sql(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The last result set of a batch."""
        frame = self.execute(text, params).frame
        if frame is None:
            raise Problem("the batch has no result set")
        return frame

    def execute(self, text: str, params: dict[str, Any] | None = None) -> Result:
        """Runs a batch; the first error ends it. params: values of @names, bound and never put into the text."""
        self.variables = {k.lstrip("@").lower(): (v, _kind_of_value(v)) for k, v in (params or {}).items()}
        return self._run(parse(text))

    def call(self, name: str, *args: Any, **named: Any) -> Result:
        return self._exec(A.Exec(name.split("."), [(None, _lit(a)) for a in args] + [(k.lower(), _lit(v)) for k, v in named.items()]))

    def table(self, name: str) -> DataFrame:
        parts = name.split(".")
        found = self.relation(parts)
        if found is None:
            raise Problem(f"unknown table {name}")
        return self.spark.table(found[0].strip("`"))

    def explain(self, text: str, params: dict[str, Any] | None = None) -> str:
        """The Spark SQL that a query becomes."""
        self.variables = {k.lstrip("@").lower(): (v, _kind_of_value(v)) for k, v in (params or {}).items()}
        return Lowering(self, self.variables).query(parse(text)[-1])[0]

    def register_function(self, name: str, function: Callable, return_type: T.DataType | str, vectorized: bool = True) -> None:
        """A scalar function for queries. vectorized: it takes and gives pandas Series, a batch at a time."""
        spark_name = f"lk_{self.id}_{name.lower()}"
        self.spark.udf.register(spark_name, F.pandas_udf(function, return_type) if vectorized else F.udf(function, return_type))
        self.functions[name.upper()] = spark_name

    def register_aggregate(self, name: str, function: Callable, return_type: T.DataType | str) -> None:
        """An aggregate for queries: function takes pandas Series, with type hints to say so, and gives one value for a group."""
        self.register_function(name, function, return_type)

    def register_table_function(self, name: str, handler: type, return_type: T.StructType | str) -> None:
        """A table function for FROM and APPLY: a class whose eval() yields rows."""
        spark_name = f"lk_{self.id}_{name.lower()}"
        struct = return_type if isinstance(return_type, T.StructType) else T.StructType.fromDDL(return_type)
        self.spark.udtf.register(spark_name, F.udtf(handler, returnType=struct))
        self.table_functions[name.upper()] = (spark_name, [(f.name, kind_of(f.dataType, self.exact)) for f in struct.fields])

    # What lowering asks.
    def routine_function(self, name: str) -> tuple | None:
        r = self.routines.get("FUNCTION", self.database, name)
        return (r.params, *r.tree) if r else None

    def table_function(self, name: str) -> tuple[str, Out] | None:
        return self.table_functions.get(name.upper())

    def user_function(self, name: str) -> str | None:
        return self.functions.get(name)

    def count(self, sql: str, args: dict[str, Any]) -> int:
        return self.spark.sql(f"SELECT count(*) FROM ({sql})", args=args or None).first()[0]

    @contextlib.contextmanager
    def within(self, database: str):
        held, self.database = self.database, database
        try:
            yield
        finally:
            self.database = held

    def view(self, parts: list[str]) -> tuple[A.Query, str] | None:
        database, schema, name = self._split(parts)
        if schema.lower() in ("sys", "information_schema"):
            return None
        r = self.routines.get("VIEW", database, name)
        return (r.tree, r.database) if r else None

    def relation(self, parts: list[str]) -> tuple[str, Out] | None:
        database, schema, name = self._split(parts)
        if schema.lower() in ("sys", "information_schema"):
            return self._system(database, f"{schema}.{name}".lower())
        db = self.databases.get(database.lower())
        table = self._find(db, name) if db else None
        if table is None:
            return None
        key = (db.name.lower(), name.lower())
        if key not in self.registered:
            self.registered[key] = self._register(f"{db.name}_{name}", self._scan(db, table), table)
        return self.registered[key]

    def constant(self, name: str, args: list[Any]) -> tuple[bool, Any]:
        """(whether it is one, its value): what a call with constant arguments says of the session or the catalog."""
        if not args:
            user, now = "larkspur", {
                "@@VERSION": VERSION, "@@SPID": 1, "@@SERVERNAME": SERVER, "@@LANGUAGE": "us_english", "@@ROWCOUNT": self.affected, "@@ERROR": 0, "ERROR_MESSAGE": self.error,
                "@@TRANCOUNT": len(self.saved), "@@FETCH_STATUS": 0, "DB_NAME": self.database, "ORIGINAL_DB_NAME": self.database, "HOST_NAME": SERVER, "APP_NAME": SERVER,
            }
            if name in now:
                return True, now[name]
            if name in ("SYSTEM_USER", "CURRENT_USER", "SESSION_USER", "USER", "SUSER_NAME", "SUSER_SNAME", "USER_NAME"):
                return True, user
            if name == "DB_ID":
                return True, self._database_id(self.database)
            if name.startswith("@@"):
                raise Problem(f"unknown variable {name}")
            return False, None
        first = args[0]
        if name == "DB_ID":
            return True, self._database_id(str(first))
        if name == "DB_NAME":
            names = [*SYSTEM, *self._names()]
            return True, names[first - 1] if isinstance(first, int) and 0 < first <= len(names) else None
        if name == "OBJECT_ID":
            parts = str(first).replace("[", "").replace("]", "").split(".")
            database, _, table = self._split(parts)
            return True, system_views.object_id(self._tables(database), table)
        if name == "SERVERPROPERTY":
            return True, _PROPERTIES.get(str(first).upper(), "")
        if name == "DATABASEPROPERTYEX":
            return True, "ON"
        return False, None

    # Catalog.
    def _split(self, parts: list[str]) -> tuple[str, str, str]:
        if len(parts) > 3:
            raise Problem(f"a name has three parts at most: {'.'.join(parts)}")
        return (parts[-3] if len(parts) == 3 and parts[-3] else self.database), (parts[-2] if len(parts) > 1 else ""), parts[-1]

    def _names(self) -> list[str]:
        return [d.name for d in self.databases.values()]

    def _database_id(self, name: str) -> int | None:
        return system_views.database_id(self._names(), name)

    def _tables(self, database: str) -> list[Table]:
        db = self.databases.get(database.lower())
        if db is None:
            return []
        found = [t for t in (db.provider.tables(db.name) if db.provider else []) if t.name.lower() not in db.changed]
        tables = found + [s.table for s in db.changed.values() if s is not None]
        for t in tables:
            t.database = db.name
        return tables

    def _find(self, db: _Database, name: str) -> Table | None:
        if (db.name.lower(), name.lower()) in self.streams:
            return self.streams[db.name.lower(), name.lower()]
        if name.lower() in db.changed:
            s = db.changed[name.lower()]
            return s.table if s else None
        if db.provider is None:
            return None
        one = getattr(db.provider, "find", None)  # without reading what other tables are like
        if one is not None:
            known = one(name)
            return db.provider.table(known) if known else None
        return next((t for t in db.provider.tables(db.name) if t.name.lower() == name.lower()), None)

    def _scan(self, db: _Database, table: Table) -> DataFrame:
        s = db.changed.get(table.name.lower())
        return self.store.scan(s) if s is not None else db.provider.scan(self.spark, db.name, table.name)

    def _register(self, name: str, frame: DataFrame, table: Table | None = None) -> tuple[str, Out]:
        view = f"lk_{self.id}_{''.join(c if c.isalnum() else '_' for c in name)}"
        frame.createOrReplaceTempView(view)
        schema = table.schema if table else frame.schema
        return quote(view), [(f.name, kind_of(f.dataType, self.exact)) for f in schema.fields]

    def _system(self, database: str, name: str) -> tuple[str, Out] | None:
        found = system_views.view(name, self._tables(database), self._names())
        if found is None:
            return None
        schema, rows = found
        return self._register(f"{database}_{name}", local_frame(self.spark, rows, schema))

    # Statements.
    def _run(self, statements: list[A.Node]) -> Result:
        last = Result()
        for s in statements:
            one = self._one(s)
            if one is None:
                continue
            if one.affected is not None:
                self.affected = one.affected
            if one.frame is not None or one.affected is not None:
                last = Result(one.frame, one.affected, [*last.all, *(one.all or [one])])
        return last

    def _one(self, s: A.Node) -> Result | None:
        return getattr(self, "_on_" + type(s).__name__.lower())(s)

    def _lower(self, **how: Any) -> Lowering:
        return Lowering(self, self.variables, **how)

    def _on_query(self, q: A.Query) -> Result:
        if isinstance(q.body, A.Select) and q.body.into:
            return self._into(q)
        pushed = self._push(q)
        if pushed is not None:
            return Result(pushed)
        lowering = self._lower()
        sql, _ = lowering.query(q)
        return Result(self.spark.sql(sql, args=lowering.args or None))

    def _push(self, q: A.Query) -> DataFrame | None:
        """Whole queries, or aggregates over one table, for a source that answers them itself."""
        db = self.databases.get(self.database.lower())
        if db is None or db.provider is None or db.changed or self.variables or not (db.provider.full_query or db.provider.aggregates):
            return None
        refs = [n for n in walk(q) if isinstance(n, A.TableRef)]
        if not refs or any(len(r.parts) > 2 or self.view(r.parts) or self._find(db, r.parts[-1]) is None for r in refs):
            return None
        if db.provider.full_query:
            return db.provider.query(self.spark, db.name, q.text)
        calls = any(isinstance(n, A.Func) and n.name in FN.AGGREGATES for n in walk(q))
        if calls and isinstance(q.body, A.Select) and isinstance(q.body.source, A.TableRef) and len(refs) == 1:
            with contextlib.suppress(Unsupported):
                return db.provider.aggregate(self.spark, db.name, q.text)
        return None

    def _on_use(self, s: A.Use) -> None:
        known = self.databases.get(s.name.lower())
        if known is None and s.name.lower() not in SYSTEM:
            raise Problem(f"unknown database {s.name}")
        self.database = known.name if known else s.name.lower()

    def _on_setoption(self, s: A.SetOption) -> None:
        return None

    def _value(self, e: A.Node, t: A.TypeName | None) -> Any:
        if isinstance(e, A.Lit) and e.kind in ("int", "str", "null", "float") and (t is None or _plain(e, t)):
            return e.value
        lowering = self._lower()
        sql = lowering.expr(e, Scope())
        if t is not None:
            sql = lowering.cast(sql, t)
        value = self.spark.sql(f"SELECT {sql[0]} AS v", args=lowering.args or None).first()[0]
        return float(value) if isinstance(value, decimal.Decimal) else value

    def _on_declare(self, s: A.Declare) -> None:
        value = self._value(s.value, s.type) if s.value is not None else None
        self.variables[s.name] = (value, kind_of_name(s.type))
        self.types = {**getattr(self, "types", {}), s.name: s.type}

    def _on_setvar(self, s: A.SetVar) -> None:
        if s.name not in self.variables:
            raise Problem(f"@{s.name} isn't declared")
        self.variables[s.name] = (self._value(s.value, getattr(self, "types", {}).get(s.name)), self.variables[s.name][1])

    def _holds(self, e: A.Node) -> bool:
        lowering = self._lower()
        test = lowering.test(e, Scope())
        return bool(self.spark.sql(f"SELECT CASE WHEN {test} THEN true ELSE false END AS v", args=lowering.args or None).first()[0])

    def _on_if(self, s: A.If) -> Result:
        return self._run(s.then if self._holds(s.test) else s.other)

    def _on_while(self, s: A.While) -> Result:
        last = Result()
        while self._holds(s.test):
            last = self._run(s.body)
        return last

    # Writes.
    def _target(self, parts: list[str]) -> tuple[_Database, Table]:
        database, schema, name = self._split(parts)
        db = self.databases.get(database.lower())
        table = self._find(db, name) if db and schema.lower() not in ("sys", "information_schema") else None
        if table is None:
            raise Problem(f"unknown table {'.'.join(parts)}")
        self._writable(db)
        if (db.name.lower(), name.lower()) in self.streams:
            raise Unsupported(f"{name} is a stream")
        return db, table

    @staticmethod
    def _writable(db: _Database) -> None:
        if db.provider is not None and not db.provider.writable:
            raise Unsupported(f"{db.name} can't be written")

    def _snapshot(self, db: _Database, table: Table) -> Snapshot:
        s = db.changed.get(table.name.lower())
        if s is None:
            table.database = db.name
            s = self.store.adopt(table, db.provider.scan(self.spark, db.name, table.name), db.provider.paths(table.name))
        return s

    def _commit(self, db: _Database, name: str, snapshot: Snapshot | None) -> None:
        """The one step that makes a change visible."""
        db.changed[name.lower()] = snapshot
        self.registered.pop((db.name.lower(), name.lower()), None)
        self._keep()

    def _keep(self) -> None:
        """What is in force now becomes what later sessions find; within a transaction nothing does."""
        if self.kept and not self.saved:
            self.kept.save(self.databases_made, [(d.name, d.changed) for d in self.databases.values()], list(self.routines.held.values()))

    def _load(self) -> None:
        made, changed, routines = self.kept.load()
        for name, there in made.items():
            self.databases_made[name] = there
            if there:
                self.databases.setdefault(name.lower(), _Database(name))
            else:
                self.databases.pop(name.lower(), None)
        for name, tables in changed:
            if name.lower() in self.databases:
                self.databases[name.lower()].changed = tables
        held, self.kept = self.kept, None
        for database, text in routines:
            with self.within(database):
                for s in parse(text):
                    s.replace = "CREATE OR ALTER"
                    self._one(s)
        self.kept = held

    def _on_transaction(self, s: A.Transaction) -> None:
        """Tables, databases and routines are values that statements replace, so a transaction only has to remember the old ones."""
        if s.action == "BEGIN":
            self.saved.append(({k: dataclasses.replace(d, changed=dict(d.changed)) for k, d in self.databases.items()}, dict(self.databases_made), dict(self.routines.held), self.database))
        elif not self.saved:
            raise Problem(f"{s.action} without BEGIN TRANSACTION")
        elif s.action == "COMMIT":
            self.saved.pop()
            self._keep()
        else:  # all the way, as the innermost has no say of its own
            self.databases, self.databases_made, self.routines.held, self.database = self.saved[0]
            self.saved, self.registered = [], {k: v for k, v in self.registered.items() if k in self.streams}

    def _on_try(self, s: A.Try) -> Result:
        try:
            return self._run(s.body)
        except Exception as x:  # whatever ends a statement
            self.error = str(x).splitlines()[0] if str(x) else type(x).__name__
            return self._run(s.handler)

    def _on_insert(self, s: A.Insert) -> Result:
        db, table = self._target(s.table)
        names = s.columns or [c.name for c in table.columns]
        columns = [table.column(n) for n in names]
        if None in columns or len({c.name for c in columns}) != len(columns):
            raise Problem(f"{table.name} has no such columns, or one is named twice: {', '.join(names)}")
        place = {c.name: i for i, c in enumerate(columns)}
        if s.rows is not None:
            if any(len(r) != len(columns) for r in s.rows):
                raise Problem(f"each row must have {len(columns)} values")
            lowering = self._lower(row=True)
            types = {c.name: c.type.simpleString() for c in table.columns}
            cell = lambda r, c: f"CAST({lowering.expr(r[place[c]], Scope())[0] if c in place else 'NULL'} AS {types[c]})"
            rows = ", ".join(f"({', '.join(cell(r, c.name) for c in table.columns)})" for r in s.rows)
            frame = self.spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(quote(c.name) for c in table.columns)})")
        else:
            given = self._on_query(s.query).frame
            if len(given.columns) != len(columns):
                raise Problem(f"the query has {len(given.columns)} columns, not {len(columns)}")
            given = given.toDF(*[f"c{i}" for i in range(len(columns))])
            frame = given.select(*[(F.col(f"c{place[c.name]}") if c.name in place else F.lit(None)).cast(c.type).alias(c.name) for c in table.columns])
        snapshot, n = self.store.insert(self._snapshot(db, table), frame)
        self._commit(db, table.name, snapshot)
        return Result(affected=n)

    def _row_scope(self, table: Table) -> Scope:
        scope = Scope()
        scope.add(table.name, [(c.name, kind_of(c.type, self.exact)) for c in table.columns])
        return scope

    def _change(self, parts: list[str], where: A.Node | None, sets: list[tuple[str, A.Node]] | None) -> Result:
        db, table = self._target(parts)
        lowering, scope = self._lower(row=True), self._row_scope(table)
        test = F.expr(lowering.test(where, scope)) if where is not None else F.lit(True)
        values = None
        if sets is not None:
            values = {}
            for name, e in sets:
                column = table.column(name)
                if column is None:
                    raise Problem(f"{table.name} has no column {name}")
                values[column.name] = F.expr(lowering.expr(e, scope)[0])
        snapshot, n = self.store.rewrite(self._snapshot(db, table), test, values)
        if n:
            self._commit(db, table.name, snapshot)
        return Result(affected=n)

    def _on_update(self, s: A.Update) -> Result:
        if s.source is None and not _queries([s.where, *[e for _, e in s.sets]]):
            return self._change(s.table, s.where, s.sets)
        return self._change_from(s.table, s.source, s.where, s.sets)

    def _on_delete(self, s: A.Delete) -> Result:
        if s.source is None and not _queries([s.where]):
            return self._change(s.table, s.where, None)
        return self._change_from(s.table, s.source, s.where, None)

    def _placed(self, ref: A.TableRef, lowering: Lowering) -> tuple[_Database, Table, Snapshot, DataFrame]:
        """The target of a statement that joins; lowering is told to read it with the place of each row."""
        db, table = self._target(ref.parts)
        snapshot, rows = self.store.placed(self._snapshot(db, table))
        lowering.instead[id(ref)] = self._register(f"{db.name}_{table.name}_{uuid.uuid4().hex[:8]}_rows", rows, table)
        return db, table, snapshot, rows

    def _set_columns(self, table: Table, sets: list[tuple[str, A.Node]]) -> list[tuple[str, A.Node]]:
        for name, _ in sets:
            if table.column(name) is None:
                raise Problem(f"{table.name} has no column {name}")
        return sets

    def _change_from(self, parts: list[str], source: A.Node | None, where: A.Node | None, sets: list[tuple[str, A.Node]] | None) -> Result:
        """UPDATE and DELETE with FROM, or with subqueries. The target is what FROM calls by this name, else one more table of it. Of several
        values for a row the least are taken, so that every run gives the same."""
        refs = [n for n in walk(source) if isinstance(n, A.TableRef)] if source is not None else []
        named = [n for n in refs if (n.alias or n.parts[-1]).lower() == parts[-1].lower()] or [n for n in refs if [x.lower() for x in n.parts] == [x.lower() for x in parts]]
        target = named[0] if named else A.TableRef(parts, None)
        if not named:
            source = target if source is None else A.Join("CROSS", target, source, None)
        lowering = self._lower()
        db, table, snapshot, rows = self._placed(target, lowering)
        scope, alias = Scope(), quote(target.alias or target.parts[-1])
        tail = lowering.source(source, scope)
        values = [f"{lowering.expr(e, scope)[0]} AS c{i}" for i, (_, e) in enumerate(self._set_columns(table, sets or []))]
        places = [f"{alias}.`{p}`" for p in PLACE]
        test = f" WHERE {lowering.filter(where, scope)}" if where is not None else ""
        found = self.spark.sql(f"SELECT {', '.join([*places, *values])} FROM {tail}{test}", args=lowering.args or None)
        numbers = range(len(values))
        one = found.groupBy(*PLACE).agg(F.min(F.struct(F.lit(0), *[F.col(f"c{i}") for i in numbers])).alias("v"))
        changes = one.select(*PLACE, F.lit(sets is None).alias(GONE), *[F.col(f"v.c{i}").alias(f"c{i}") for i in numbers], *[F.lit(True).alias(f"s{i}") for i in numbers])
        return self._applied(db, table, snapshot, rows, changes, [n for n, _ in sets or []])

    def _applied(self, db: _Database, table: Table, snapshot: Snapshot, rows: DataFrame, changes: DataFrame, sets: list[str], added: DataFrame | None = None) -> Result:
        snapshot, n = self.store.apply(snapshot, rows, changes, sets, added)
        if n:
            self._commit(db, table.name, snapshot)
        return Result(affected=n)

    def _on_merge(self, s: A.Merge) -> Result:
        """MERGE: of the clauses of a kind the first whose condition holds. A target row that several source rows would change is an
        error, as nothing says which of them is meant."""
        lowering = self._lower()
        db, table, snapshot, rows = self._placed(s.target, lowering)
        scope, alias = Scope(), quote(s.target.alias or s.target.parts[-1])
        target, source = lowering.source(s.target, scope), lowering.source(s.source, scope)
        on = lowering.test(s.on, scope)
        sets: list[str] = []
        for c in s.clauses:
            for name, _ in self._set_columns(table, c.sets or []):
                if name.lower() not in [x.lower() for x in sets]:
                    sets.append(name)

        def cases(kind: str) -> tuple[str, list[A.When]]:
            own = [c for c in s.clauses if c.on == kind]
            whens = " ".join(f"WHEN {lowering.test(c.test, scope) if c.test is not None else 'true'} THEN {i}" for i, c in enumerate(own))
            return (f"CASE {whens} END" if own else "cast(NULL as int)"), own

        parts = []
        for kind, tail in (("matched", f"{target} JOIN {source} ON {on}"), ("source", f"{target} LEFT ANTI JOIN {source} ON {on}")):
            which, own = cases(kind)
            if not own:
                continue
            columns = [f"{alias}.`{p}`" for p in PLACE]
            columns.append(f"CASE {which} " + " ".join(f"WHEN {i} THEN {'false' if c.sets is not None else 'true'}" for i, c in enumerate(own)) + f" END AS `{GONE}`")
            for k, name in enumerate(sets):
                given = [(i, e) for i, c in enumerate(own) for n, e in c.sets or [] if n.lower() == name.lower()]
                kind_ = table.column(name).type.simpleString()
                value = f"CASE {which} " + " ".join(f"WHEN {i} THEN CAST({lowering.expr(e, scope)[0]} AS {kind_})" for i, e in given) + " END" if given else f"CAST(NULL AS {kind_})"
                columns += [f"{value} AS c{k}", (f"coalesce({which} IN ({', '.join(str(i) for i, _ in given)}), false)" if given else "false") + f" AS s{k}"]
            parts.append(f"SELECT {', '.join(columns)} FROM {tail} WHERE {which} IS NOT NULL")
        nothing = f"SELECT {', '.join(f'{alias}.`{p}`' for p in PLACE)}, true AS `{GONE}`" + "".join(f", CAST(NULL AS {table.column(n).type.simpleString()}) AS c{k}, false AS s{k}" for k, n in enumerate(sets)) + f" FROM {target} WHERE false"
        changes = self.spark.sql(" UNION ALL ".join(parts) or nothing, args=lowering.args or None)
        twice = F.count(F.lit(1)) > 1
        rest = [c for c in changes.columns if c not in PLACE]
        changes = changes.groupBy(*PLACE).agg(F.when(twice, F.raise_error(F.lit("MERGE would change a row more than once"))).otherwise(F.first(F.struct(*rest))).alias("v")).select(*PLACE, "v.*")

        added = None
        which, own = cases("target")
        if own:
            picked = lambda cells, i: f"SELECT {cells} FROM {source} LEFT ANTI JOIN {target} ON {on} WHERE {which} = {i}"
            for i, c in enumerate(own):
                names = c.columns or [x.name for x in table.columns]
                if any(table.column(n) is None for n in names) or len(names) != len(c.values):
                    raise Problem(f"{table.name} has no such columns, or as many values aren't given: {', '.join(names)}")
                given = {n.lower(): lowering.expr(e, scope)[0] for n, e in zip(names, c.values)}
                cells = ", ".join(f"CAST({given.get(x.name.lower(), 'NULL')} AS {x.type.simpleString()}) AS {quote(x.name)}" for x in table.columns)
                new = self.spark.sql(picked(cells, i), args=lowering.args or None)
                added = new if added is None else added.unionByName(new)
        return self._applied(db, table, snapshot, rows, changes, sets, added)

    def _on_truncate(self, s: A.Truncate) -> Result:
        db, table = self._target(s.table)
        self._commit(db, table.name, self.store.truncate(self._snapshot(db, table)))
        return Result(affected=0)

    def _into(self, q: A.Query) -> Result:
        """SELECT ... INTO: a new table with the rows and column types of the query."""
        database, _, name = self._split(q.body.into)
        db = self.databases.get(database.lower())
        if db is None:
            raise Problem(f"unknown database {database}")
        self._writable(db)
        if self._find(db, name) is not None:
            raise Problem(f"{name} exists already")
        lowering = self._lower()
        sql, _ = lowering.query(q)
        frame = self.spark.sql(sql, args=lowering.args or None)
        if len({c.lower() for c in frame.columns}) != len(frame.columns):
            raise Problem("a column is named twice")
        columns = [dataclasses.replace(c, nullable=True) for c in columns_of(frame.schema)]
        snapshot, n = self.store.insert(self.store.create(Table(name, columns, [], [], db.name)), frame)
        self._commit(db, name, snapshot)
        return Result(affected=n)

    def _on_createtable(self, s: A.CreateTable) -> Result:
        database, _, name = self._split(s.table)
        db = self.databases.get(database.lower())
        if db is None:
            raise Problem(f"unknown database {database}")
        self._writable(db)
        if self._find(db, name) is not None:
            raise Problem(f"{name} exists already")
        columns = [written(c.name, c.type.name, c.type.args, c.nullable) for c in s.columns]
        if len({c.name.lower() for c in columns}) != len(columns):
            raise Problem("a column is named twice")
        self._commit(db, name, self.store.create(Table(name, columns, s.key, [], db.name)))
        return Result(affected=0)

    def _on_alteradd(self, s: A.AlterAdd) -> Result:
        db, table = self._target(s.table)
        for c in s.columns:
            if table.column(c.name):
                raise Problem(f"{table.name} has a column {c.name} already")
        columns = [written(c.name, c.type.name, c.type.args) for c in s.columns]
        self._commit(db, table.name, self.store.add_columns(self._snapshot(db, table), columns))
        return Result(affected=0)

    def _on_alterdrop(self, s: A.AlterDrop) -> Result:
        db, table = self._target(s.table)
        for n in s.columns:
            if table.column(n) is None:
                raise Problem(f"{table.name} has no column {n}")
        if len({n.lower() for n in s.columns}) >= len(table.columns):
            raise Problem("a table keeps one column at least")
        self._commit(db, table.name, self.store.drop_columns(self._snapshot(db, table), {n.lower() for n in s.columns}))
        return Result(affected=0)

    def _on_droptable(self, s: A.DropTable) -> Result:
        try:
            db, table = self._target(s.table)
        except Problem:
            if s.if_exists:
                return Result(affected=0)
            raise
        self._commit(db, table.name, None)
        return Result(affected=0)

    def _on_database(self, s: A.Database) -> Result:
        known = s.name.lower() in self.databases or s.name.lower() in SYSTEM
        if s.action == "CREATE":
            if known:
                raise Problem(f"{s.name} exists already")
            self.databases[s.name.lower()] = _Database(s.name)
            self.databases_made[s.name] = True
        elif s.name.lower() in SYSTEM:
            raise Problem(f"{s.name} can't be dropped")
        elif known:
            db = self.databases.pop(s.name.lower())
            self.databases_made[db.name] = False
            self.registered = {k: v for k, v in self.registered.items() if k[0] != db.name.lower()}
            if self.database.lower() == db.name.lower():
                self.database = "master"
        elif not s.if_exists:
            raise Problem(f"unknown database {s.name}")
        self._keep()
        return Result(affected=0)

    # Routines.
    def _on_createview(self, s: A.CreateView) -> Result:
        database, _, name = self._split(s.name)
        db = self.databases.get(database.lower())
        if db is not None and self._find(db, name) is not None:
            raise Problem(f"{name} is a table")
        self.routines.put(Routine("VIEW", database, name, s.text, s.query), s.replace)
        self._keep()
        return Result(affected=0)

    def _on_createfunction(self, s: A.CreateFunction) -> Result:
        database, _, name = self._split(s.name)
        self.routines.put(Routine("FUNCTION", database, name, s.text, (s.returns, s.body), s.params), s.replace)
        self._keep()
        return Result(affected=0)

    def _on_createproc(self, s: A.CreateProc) -> Result:
        database, _, name = self._split(s.name)
        self.routines.put(Routine("PROCEDURE", database, name, s.text, s.body, s.params), s.replace)
        self._keep()
        return Result(affected=0)

    def _on_droproutine(self, s: A.DropRoutine) -> Result:
        database, _, name = self._split(s.name)
        self.routines.drop(s.kind, database, name, s.if_exists)
        self._keep()
        return Result(affected=0)

    def _on_exec(self, s: A.Exec) -> Result:
        return self._exec(s)

    def _exec(self, s: A.Exec) -> Result:
        database, _, name = self._split(s.name)
        routine = self.routines.get("PROCEDURE", database, name)
        if routine is not None:
            return self._procedure(routine, s.args)
        name = name.lower()
        if name == "sp_executesql":
            return self._executesql(s.args)
        if name in ("sp_databases", "sp_tables", "sp_columns", "sp_columns_90"):
            schema, rows = self._catalog_procedure(name, s.args)
            return Result(local_frame(self.spark, rows, schema))
        if name.startswith("sp_"):
            return Result(affected=0)
        raise Problem(f"unknown procedure {'.'.join(s.name)}")

    def _catalog_procedure(self, name: str, args: list[tuple[str | None, A.Node]]) -> tuple[T.StructType, list[tuple]]:
        if name == "sp_databases":
            return system_views.sp_databases(self._names())
        order = ["table_name", "table_owner", "table_qualifier"] + ["column_name"] * name.startswith("sp_columns")
        given = {(k or order[i]): self._value(v, None) for i, (k, v) in enumerate(args) if k or i < len(order)}
        tables = self._tables(given.get("table_qualifier") or self.database)
        if name == "sp_tables":
            return system_views.sp_tables(tables, given.get("table_name"))
        return system_views.sp_columns(tables, given.get("table_name"), given.get("column_name"))

    def _procedure(self, r: Routine, args: list[tuple[str | None, A.Node]]) -> Result:
        """Arguments are bound by place or name; one that is left out has its default, or NULL."""
        if len(args) > len(r.params):
            raise Problem(f"{r.name} takes {len(r.params)} arguments")
        names = [p[0] for p in r.params]
        given: dict[str, A.Node] = {}
        for i, (name, e) in enumerate(args):
            name = (name or names[i]).lower()
            if name not in names:
                raise Problem(f"{r.name} has no parameter @{name}")
            given[name] = e
        bound = {}
        for name, type_, default in r.params:
            e = given.get(name, default)
            bound[name] = (self._value(e, type_) if e is not None else None, kind_of_name(type_))
        held, self.variables = self.variables, bound
        try:
            with self.within(r.database):
                return self._run(r.tree)
        finally:
            self.variables = held

    def _executesql(self, args: list[tuple[str | None, A.Node]]) -> Result:
        """sp_executesql: a text, definitions of its parameters, and their values."""
        if not args:
            raise Problem("sp_executesql needs a statement")
        text = str(self._value(args[0][1], None))
        bound: dict[str, tuple[Any, str | None]] = {}
        if len(args) > 1:
            for i, d in enumerate(parse(f"DECLARE {self._value(args[1][1], None)}")):
                value = next((e for k, e in args[2:] if k == d.name), args[2 + i][1] if len(args) > 2 + i and args[2 + i][0] is None else None)
                bound[d.name] = (self._value(value, d.type) if value is not None else None, kind_of_name(d.type))
        held, self.variables = self.variables, bound
        try:
            return self._run(parse(text))
        finally:
            self.variables = held


def _root(spark: SparkSession) -> str:
    """Where changed tables go: a folder that all executors share; none (writing is then an error) on a cluster that names none."""
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/larkspur-tables/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        return ""
    return f"file://{tempfile.mkdtemp(prefix='larkspur_tables_')}"


def _queries(nodes: Iterable[A.Node | None]) -> bool:
    return any(isinstance(x, A.Query) for n in nodes for x in walk(n))


def _kind_of_value(v: Any) -> str | None:
    for types, kind in ((bool, "bool"), (int, "int"), ((float, decimal.Decimal), "float"), (str, "str"), (datetime.datetime, "time"), (datetime.date, "date"), ((bytes, bytearray), "bin")):
        if isinstance(v, types):
            return kind
    return None


def _plain(e: A.Lit, t: A.TypeName) -> bool:
    kind = kind_of_name(t)
    return e.kind == "null" or (e.kind == kind and t.name != "BIT" and kind in ("int", "str")) or (e.kind == "float" and kind == "float")


def _lit(v: Any) -> A.Node:
    kind = {bool: "int", int: "int", float: "float", str: "str", type(None): "null"}.get(type(v))
    if kind is None:
        raise Problem(f"an argument of type {type(v).__name__} isn't supported")
    return A.Lit(int(v) if isinstance(v, bool) else v, kind)
