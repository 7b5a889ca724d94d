"""What a session's statements have made, kept for later ones: a numbered file of JSON for each change, of which the last holds."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from larkspur.catalog.model import Column, ForeignKey, Table
from larkspur.routines import Routine
from larkspur.sources.snapshot import Part, Snapshot


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/_state"

    def _path(self, name: str = "") -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, fs: Any) -> list[str]:
        return sorted(x.getPath().getName() for x in fs.listStatus(self._path())) if fs.exists(self._path()) else []

    def save(self, made: dict[str, bool], changed: list[tuple[str, dict[str, Snapshot | None]]], routines: list[Routine]) -> None:
        """A file is written under another name and then renamed, so that no reader sees a part of it."""
        state = {
            "made": made, "routines": [[r.database, r.text] for r in routines],
            "changed": [[name, {k: None if s is None else _packed(s) for k, s in tables.items()}] for name, tables in changed if tables],
        }
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [n for n in self._names(fs) if n.endswith(".json")]
        last = f"{int(names[-1].split('.')[0]) + 1 if names else 1:012d}"
        out = fs.create(self._path(last + ".part"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(self._path(last + ".part"), self._path(last + ".json")):
            raise RuntimeError("another session has changed the same tables")
        for old in names[:-1]:
            fs.delete(self._path(old), False)

    def load(self) -> tuple[dict[str, bool], list[tuple[str, dict[str, Snapshot | None]]], list[list[str]]]:
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [n for n in self._names(fs) if n.endswith(".json")]
        if not names:
            return {}, [], []
        state = json.loads(self.spark.read.text(f"{self.folder}/{names[-1]}", wholetext=True).first()[0])
        changed = [(name, {k: None if s is None else _unpacked(s) for k, s in tables.items()}) for name, tables in state["changed"]]
        return state["made"], changed, state["routines"]


def _packed(s: Snapshot) -> dict:
    t = s.table
    columns = [[c.name, c.type.jsonValue(), c.kind, c.nullable, c.length] for c in t.columns]
    foreign = [[f.columns, f.table, f.references] for f in t.foreign]
    return {"name": t.name, "columns": columns, "key": t.key, "foreign": foreign, "database": t.database, "physical": s.physical, "parts": [[p.path, p.gone] for p in s.parts]}


def _unpacked(x: dict) -> Snapshot:
    types = T.StructType.fromJson({"type": "struct", "fields": [{"name": c[0], "type": c[1], "nullable": True, "metadata": {}} for c in x["columns"]]})
    columns = [Column(c[0], f.dataType, c[2], c[3], c[4]) for c, f in zip(x["columns"], types.fields)]
    foreign = [ForeignKey(tuple(f[0]), f[1], tuple(f[2])) for f in x["foreign"]]
    return Snapshot(Table(x["name"], columns, x["key"], foreign, x["database"]), x["physical"], [Part(path, tuple(gone)) for path, gone in x["parts"]])
