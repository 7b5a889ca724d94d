"""Views and procedures of a session."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from larkspur.dialect import ast as A


@dataclass
class Routine:
    """kind: VIEW or PROCEDURE. text: as it was written."""

    kind: str
    database: str
    name: str
    text: str
    tree: Any
    params: list[tuple[str, A.TypeName, A.Node | None]] = field(default_factory=list)


class RoutineStore:
    def __init__(self):
        self.held: dict[tuple[str, str, str], Routine] = {}

    @staticmethod
    def key(kind: str, database: str, name: str) -> tuple[str, str, str]:
        return kind, database.lower(), name.lower()

    def get(self, kind: str, database: str, name: str) -> Routine | None:
        return self.held.get(self.key(kind, database, name))

    def put(self, routine: Routine, how: str) -> None:
        """how: CREATE (must be new), ALTER (must be there) or CREATE OR ALTER."""
        key = self.key(routine.kind, routine.database, routine.name)
        if how == "CREATE" and key in self.held:
            raise ValueError(f"{routine.name} exists already")
        if how == "ALTER" and key not in self.held:
            raise ValueError(f"unknown {routine.kind.lower()} {routine.name}")
        self.held[key] = routine

    def drop(self, kind: str, database: str, name: str, if_exists: bool) -> None:
        if self.held.pop(self.key(kind, database, name), None) is None and not if_exists:
            raise ValueError(f"unknown {kind.lower()} {name}")
