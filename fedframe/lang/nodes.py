"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

# --- expressions ---------------------------------------------------------


@dataclass(frozen=True)
class Literal:
    value: str | int | float | bool | None


@dataclass(frozen=True)
class Interval:
    amount: int
    unit: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Name:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull:
    operand: Expr
    negated: bool


@dataclass(frozen=True)
class Between:
    operand: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class InList:
    operand: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery:
    operand: Expr
    query: Query
    negated: bool


@dataclass(frozen=True)
class Quantified:
    operand: Expr
    op: str
    every: bool
    query: Query


@dataclass(frozen=True)
class Exists:
    query: Query


@dataclass(frozen=True)
class Scalar:
    query: Query


@dataclass(frozen=True)
class Case:
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast:
    operand: Expr
    type: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Extract:
    unit: str
    operand: Expr


@dataclass(frozen=True)
class WindowSpec:
    partition: tuple[Expr, ...] = ()
    order: tuple[OrderKey, ...] = ()
    frame: str | None = None


@dataclass(frozen=True)
class Over:
    operand: Expr
    window: WindowSpec | str


@dataclass(frozen=True)
class Array:
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Object:
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class AiQuery:
    config: str
    model: str | None
    prompt: Expr


Expr = Union[Literal, Interval, Param, Name, Star, Unary, Binary, IsNull, Between, InList, InQuery, Quantified, Exists, Scalar, Case, Cast, Call, Extract, Over, Array, Object, AiQuery]

# --- queries ---------------------------------------------------------------


@dataclass(frozen=True)
class OrderKey:
    expr: Expr
    descending: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    schema: str | None = None
    connection: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: Query
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str
    source: Table | Derived
    on: Expr | None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    sources: tuple[Table | Derived, ...] = ()
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    windows: tuple[tuple[str, WindowSpec], ...] = ()
    order: tuple[OrderKey, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class SetOp:
    op: str
    all: bool
    left: Query
    right: Query
    order: tuple[OrderKey, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Cte:
    name: str
    columns: tuple[str, ...]
    query: Query


@dataclass(frozen=True)
class With:
    recursive: bool
    ctes: tuple[Cte, ...]
    body: Statement


Query = Union[Select, SetOp, With]

# --- statements --------------------------------------------------------------


@dataclass(frozen=True)
class Persist:
    query: Query
    target: Table
    conflict: str | None = None


@dataclass(frozen=True)
class Insert:
    target: Table
    rows: tuple[Object, ...] = ()
    query: Query | None = None


@dataclass(frozen=True)
class Update:
    target: Table
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    target: Table
    where: Expr | None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    default: Expr | None = None
    primary_key: bool = False


@dataclass(frozen=True)
class CreateTable:
    target: Table
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool


@dataclass(frozen=True)
class AlterTable:
    """action: add, drop, rename, rename_table or alter."""

    target: Table
    action: str
    column: ColumnDef | None = None
    name: str | None = None
    new_name: str | None = None
    changes: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class DropTable:
    target: Table
    if_exists: bool
    cascade: bool


@dataclass(frozen=True)
class CreateDatabase:
    name: str
    connection: str | None
    if_not_exists: bool


@dataclass(frozen=True)
class DropDatabase:
    name: str
    connection: str | None
    if_exists: bool


@dataclass(frozen=True)
class ShowTables:
    connection: str | None


@dataclass(frozen=True)
class Describe:
    target: Table


@dataclass(frozen=True)
class Explain:
    statement: Statement


@dataclass(frozen=True)
class Assign:
    name: str
    expr: Expr


Statement = Union[Query, Persist, Insert, Update, Delete, CreateTable, AlterTable, DropTable, CreateDatabase, DropDatabase, ShowTables, Describe, Explain, Assign]
