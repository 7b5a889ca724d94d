"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    pass


@dataclass
class Lit(Node):
    """kind: int, float, str, hex or null."""

    value: Any
    kind: str


@dataclass
class Col(Node):
    parts: list[str]
    quoted: bool = False


@dataclass
class Star(Node):
    qualifier: list[str] | None = None


@dataclass
class Var(Node):
    name: str


@dataclass
class Un(Node):
    op: str
    arg: Node


@dataclass
class Bin(Node):
    """op: + - * / % & | ^"""

    op: str
    left: Node
    right: Node


@dataclass
class Cmp(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Logic(Node):
    """op: AND or OR"""

    op: str
    args: list[Node]


@dataclass
class Not(Node):
    arg: Node


@dataclass
class In(Node):
    arg: Node
    items: list[Node] | None
    query: "Query | None"
    negated: bool


@dataclass
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool


@dataclass
class Like(Node):
    arg: Node
    pattern: Node
    escape: str | None
    negated: bool


@dataclass
class IsNull(Node):
    arg: Node
    negated: bool


@dataclass
class Exists(Node):
    query: "Query"


@dataclass
class Scalar(Node):
    query: "Query"


@dataclass
class Quantified(Node):
    """arg op ANY/ALL (query)"""

    op: str
    arg: Node
    all: bool
    query: "Query"


@dataclass
class Case(Node):
    operand: Node | None
    whens: list[tuple[Node, Node]]
    other: Node | None


@dataclass
class Cast(Node):
    """style: of CONVERT."""

    arg: Node
    type: "TypeName"
    style: Node | None = None


@dataclass
class TypeName(Node):
    name: str
    args: list[int] = field(default_factory=list)


@dataclass
class Frame(Node):
    text: str


@dataclass
class Over(Node):
    partition: list[Node]
    order: list["Order"]
    frame: str | None


@dataclass
class Func(Node):
    name: str
    args: list[Node]
    star: bool = False
    distinct: bool = False
    over: Over | None = None
    within: list["Order"] | None = None


@dataclass
class Order(Node):
    expr: Node
    desc: bool


@dataclass
class Item(Node):
    expr: Node
    alias: str | None


@dataclass
class TableRef(Node):
    parts: list[str]
    alias: str | None


@dataclass
class Derived(Node):
    query: "Query"
    alias: str
    columns: list[str] | None = None


@dataclass
class TableCall(Node):
    """A function in FROM."""

    parts: list[str]
    args: list[Node]
    alias: str
    columns: list[str] | None = None


@dataclass
class Pivot(Node):
    """A relation whose values of one column become columns."""

    source: Node
    call: Func
    column: str
    values: list[str]
    alias: str


@dataclass
class Join(Node):
    """kind: INNER, LEFT, RIGHT, FULL, CROSS, CROSS APPLY, OUTER APPLY"""

    kind: str
    left: Node
    right: Node
    on: Node | None


@dataclass
class Select(Node):
    items: list[Node]
    distinct: bool = False
    top: Node | None = None
    percent: bool = False
    ties: bool = False
    source: Node | None = None
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    grouping: str | None = None
    having: Node | None = None
    into: list[str] | None = None


@dataclass
class SetOp(Node):
    """op: UNION, INTERSECT or EXCEPT"""

    op: str
    all: bool
    left: Node
    right: Node


@dataclass
class Cte(Node):
    name: str
    columns: list[str] | None
    query: "Query"


@dataclass
class Query(Node):
    body: Node
    ctes: list[Cte] = field(default_factory=list)
    order: list[Order] = field(default_factory=list)
    offset: Node | None = None
    fetch: Node | None = None
    text: str = ""
    recursion: int | None = None


@dataclass
class Insert(Node):
    table: list[str]
    columns: list[str] | None
    rows: list[list[Node]] | None
    query: Query | None


@dataclass
class Update(Node):
    table: list[str]
    sets: list[tuple[str, Node]]
    where: Node | None
    source: Node | None = None


@dataclass
class Delete(Node):
    table: list[str]
    where: Node | None
    source: Node | None = None


@dataclass
class When(Node):
    """A clause of MERGE. on: matched, target (a row that the target lacks) or source (one that the source lacks). test: its AND.
    sets: of an update; columns and values: of an insert; none of them: a delete."""

    on: str
    test: Node | None
    sets: list[tuple[str, Node]] | None = None
    columns: list[str] | None = None
    values: list[Node] | None = None


@dataclass
class Merge(Node):
    target: TableRef
    source: Node
    on: Node
    clauses: list[When]


@dataclass
class Truncate(Node):
    table: list[str]


@dataclass
class ColumnDef(Node):
    name: str
    type: TypeName
    nullable: bool = True


@dataclass
class CreateTable(Node):
    table: list[str]
    columns: list[ColumnDef]
    key: list[str]


@dataclass
class AlterAdd(Node):
    table: list[str]
    columns: list[ColumnDef]


@dataclass
class AlterDrop(Node):
    table: list[str]
    columns: list[str]


@dataclass
class DropTable(Node):
    table: list[str]
    if_exists: bool


@dataclass
class Database(Node):
    """action: CREATE or DROP"""

    action: str
    name: str
    if_exists: bool = False


@dataclass
class Use(Node):
    name: str


@dataclass
class SetOption(Node):
    pass


@dataclass
class Declare(Node):
    name: str
    type: TypeName
    value: Node | None


@dataclass
class SetVar(Node):
    name: str
    value: Node


@dataclass
class CreateView(Node):
    name: list[str]
    query: Query
    text: str
    replace: str


@dataclass
class CreateProc(Node):
    name: list[str]
    params: list[tuple[str, TypeName, Node | None]]
    body: list[Node]
    text: str
    replace: str


@dataclass
class CreateFunction(Node):
    """returns: a type, or None for a table. body: an expression or a query."""

    name: list[str]
    params: list[tuple[str, TypeName, Node | None]]
    returns: TypeName | None
    body: Node
    text: str
    replace: str


@dataclass
class Transaction(Node):
    """action: BEGIN, COMMIT or ROLLBACK"""

    action: str


@dataclass
class Try(Node):
    body: list[Node]
    handler: list[Node]


@dataclass
class DropRoutine(Node):
    kind: str
    name: list[str]
    if_exists: bool


@dataclass
class Exec(Node):
    name: list[str]
    args: list[tuple[str | None, Node]]


@dataclass
class If(Node):
    test: Node
    then: list[Node]
    other: list[Node]


@dataclass
class While(Node):
    test: Node
    body: list[Node]
