"""Tables that statements change: folders of immutable Parquet files, and which of their files aren't in force any more.

An INSERT adds a folder; UPDATE and DELETE rewrite only files that hold a row concerned; adding and dropping columns touches no file.
Each column has a physical name of its own, so one that is dropped never comes back under its old name. The list of folders is
replaced only after the new files are written, so a statement is done as a whole or not at all; files in use are never
overwritten. No list of a table's files is ever made here: a folder is read as such, and the few files of it that are not in force
are filtered out by their path, before any is opened. A change of more than LISTED files rewrites the table instead.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field, replace
from urllib.parse import unquote, urlparse

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog.model import Column, Table


#: Where a row lies, and whether it goes.
PLACE, GONE = ("__lk_file", "__lk_row"), "__lk_gone"


#: Files that are named one by one, at most.
LISTED = 10_000


@dataclass(frozen=True)
class Part:
    """A folder (or a file), and the files in it that aren't in force."""

    path: str
    gone: tuple[str, ...] = ()


@dataclass
class Snapshot:
    """table, the physical name of each of its columns, and parts. base: a scan that files don't hold yet."""

    table: Table
    physical: list[str]
    parts: list[Part] = field(default_factory=list)
    base: DataFrame | None = None


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, table: Table) -> Snapshot:
        return Snapshot(table, [self._name(c.name) for c in table.columns])

    def adopt(self, table: Table, scan: DataFrame, paths: list[str] | None = None) -> Snapshot:
        """A source's table as it is: its own Parquet folders where it names them, or files where it has some, else (as for columns that
        folders' names hold) written once at the first change."""
        names = [c.name for c in table.columns]
        if scan.columns == names:
            paths = paths or scan.inputFiles()
            if paths and (all(f.endswith(".parquet") for f in paths)):
                inside = self.spark.read.option("recursiveFileLookup", True).parquet(paths[0])  # without what folders' names say
                if set(names) <= set(inside.columns):
                    return Snapshot(table, names, [Part(p) for p in paths])
        return Snapshot(table, names, base=scan)

    @staticmethod
    def _name(column: str) -> str:
        return f"{column}_{uuid.uuid4().hex[:8]}"

    def _fields(self, s: Snapshot) -> T.StructType:
        return T.StructType([T.StructField(p, c.type, True) for p, c in zip(s.physical, s.table.columns)])

    def _scans(self, s: Snapshot, parts: list[Part]) -> list[DataFrame]:
        """What is in force: one scan of all whole folders, and one of each that isn't whole."""
        read = self.spark.read.schema(self._fields(s))
        whole = [p.path for p in parts if not p.gone]
        found = [read.parquet(*whole)] if whole else []
        return found + [read.parquet(p.path).where(~F.col("_metadata.file_path").isin(list(p.gone))) for p in parts if p.gone]

    def _logical(self, s: Snapshot, parts: list[Part], *more: SparkColumn) -> DataFrame:
        columns = [*[F.col(f"`{p}`").alias(c.name) for p, c in zip(s.physical, s.table.columns)], *more]
        scans = [x.select(*columns) for x in self._scans(s, parts)]
        if not scans:
            none = self.spark.createDataFrame([], self._fields(s)).select(*columns[: len(s.physical)])
            return none.select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(PLACE, ("string", "long"))]) if more else none
        return functools.reduce(DataFrame.unionAll, scans)

    def _write(self, s: Snapshot, df: DataFrame) -> Part:
        if not self.root:
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        path = f"{self.root}/{s.table.database}/{s.table.name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return Part(path)

    def scan(self, s: Snapshot) -> DataFrame:
        if s.base is not None:
            return s.base.select(*[F.col(f"`{p}`").alias(c.name) for p, c in zip(s.physical, s.table.columns)])
        return self._logical(s, s.parts)

    def files(self, s: Snapshot) -> list[str]:
        """Files in force that hold a row."""
        return [r[0] for r in self.placed(s)[1].select(PLACE[0]).distinct().collect()]

    def settled(self, s: Snapshot) -> Snapshot:
        """s with all its rows in files."""
        if s.base is None:
            return s
        return replace(s, parts=[self._write(s, s.base.select(*[F.col(f"`{p}`") for p in s.physical]))], base=None)

    def insert(self, s: Snapshot, rows: DataFrame) -> tuple[Snapshot, int]:
        """rows: the table's columns, in its order."""
        s = self.settled(s)
        new = self._write(s, rows.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(rows.columns, s.physical)]))
        return replace(s, parts=[*s.parts, new]), self._logical(s, [new]).count()

    def _touched(self, s: Snapshot, places: DataFrame) -> tuple[list[str] | None, int]:
        """The files that rows lie in, None for too many to be named, and how many rows."""
        found = places.groupBy(PLACE[0]).count().limit(LISTED + 1).collect()
        if len(found) > LISTED or sum(len(p.gone) for p in s.parts) + len(found) > LISTED:
            return None, places.count()
        return [r[0] for r in found], sum(r[1] for r in found)

    def _instead(self, s: Snapshot, files: list[str] | None, new: Part) -> list[Part]:
        """The parts with `new` in place of files."""
        if files is None:
            return [new]
        left, parts = {f: _same(f) for f in files}, []
        for p in s.parts:
            own = _same(p.path)
            inside = tuple(f for f, path in left.items() if path == own or path.startswith(own.rstrip("/") + "/"))
            if not (len(inside) == 1 and left[inside[0]] == own):  # else the part is that file
                parts.append(replace(p, gone=(*p.gone, *inside)))
        return [*parts, new]

    def rewrite(self, s: Snapshot, where: SparkColumn, sets: dict[str, SparkColumn] | None) -> tuple[Snapshot, int]:
        """UPDATE (sets) or DELETE (no sets) of the rows where holds, over logical names. One pass finds the files concerned and
        counts rows."""
        s, rows = self.placed(s)
        hit = F.coalesce(where, F.lit(False))
        files, count = self._touched(s, rows.where(hit))
        if not count:
            return s, 0
        rows = self._logical(s, s.parts if files is None else [Part(unquote(f)) for f in files])
        if sets is None:
            changed = rows.where(~hit)
        else:
            changed = rows.select(*[(F.when(hit, sets[c.name].cast(c.type)).otherwise(F.col(f"`{c.name}`")) if c.name in sets else F.col(f"`{c.name}`")).alias(c.name) for c in s.table.columns])
        physical = changed.select(*[F.col(f"`{c.name}`").alias(p) for p, c in zip(s.physical, s.table.columns)])
        return replace(s, parts=self._instead(s, files, self._write(s, physical))), count

    def placed(self, s: Snapshot) -> tuple[Snapshot, DataFrame]:
        """s with all its rows in files, and these rows with their place: file and number in it."""
        s = self.settled(s)
        return s, self._logical(s, s.parts, F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))

    def apply(self, s: Snapshot, rows: DataFrame, changes: DataFrame, sets: list[str], added: DataFrame | None = None) -> tuple[Snapshot, int]:
        """Changes rows by their place. s and rows: of placed(). changes: one row a place, with GONE (the row goes) and values c0, c1, ... for
        the columns in sets; a column of which its flag s0, s1, ... isn't true keeps its value. Only files that hold a changed row are written."""
        path = f"{self.root}/{s.table.database}/{s.table.name}/changes-{uuid.uuid4().hex}"
        changes.write.parquet(path)
        changes = self.spark.read.schema(changes.schema).parquet(path)
        files, done = self._touched(s, changes)
        if done:
            _, some = self.placed(s if files is None else replace(s, parts=[Part(unquote(f)) for f in files]))
            joined = some.join(changes, list(PLACE), "left").where(~F.coalesce(F.col(GONE), F.lit(False)))
            number = {n.lower(): i for i, n in enumerate(sets)}
            cells = []
            for p, c in zip(s.physical, s.table.columns):
                old, i = F.col(f"`{c.name}`"), number.get(c.name.lower())
                cells.append((old if i is None else F.when(F.col(f"s{i}"), F.col(f"c{i}").cast(c.type)).otherwise(old)).alias(p))
            s = replace(s, parts=self._instead(s, files, self._write(s, joined.select(*cells))))
        if added is not None:
            s, n = self.insert(s, added)
            done += n
        return s, done

    def truncate(self, s: Snapshot) -> Snapshot:
        return replace(s, parts=[], base=None)

    def add_columns(self, s: Snapshot, columns: list[Column]) -> Snapshot:
        """They are null in the rows there are: files without a column read as null."""
        s = self.settled(s)
        table = replace(s.table, columns=[*s.table.columns, *columns])
        return replace(s, table=table, physical=[*s.physical, *[self._name(c.name) for c in columns]])

    def drop_columns(self, s: Snapshot, names: set[str]) -> Snapshot:
        kept = [(c, p) for c, p in zip(s.table.columns, s.physical) if c.name.lower() not in names]
        table = replace(s.table, columns=[c for c, _ in kept], key=[k for k in s.table.key if k.lower() not in names])
        s = self.settled(s)
        return replace(s, table=table, physical=[p for _, p in kept])


def _same(path: str) -> str:
    return unquote(urlparse(path).path)
