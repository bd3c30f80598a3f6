"""Tables, enums, sequences, relations and constraints, declared once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from . import types
from .expr import ColumnRef, Expr, QueryError
from .types import ColumnType

ACTIONS = ("CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION")
INDEX_METHODS = ("btree", "hash", "gist", "spgist", "gin", "brin", "hnsw", "ivfflat")


@dataclass(frozen=True)
class Enum:
    """An ordered set of strings."""

    name: str
    values: tuple[str, ...]
    schema: str = "public"

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))
        if len(set(self.values)) != len(self.values):
            raise QueryError(f"enum {self.name} repeats a value")

    def column(self) -> Col:
        return Col(types.enum_column(self))


@dataclass(frozen=True)
class Sequence:
    """A counter that the store keeps."""

    name: str
    start: int = 1
    increment: int = 1
    minimum: int | None = None
    maximum: int | None = None
    cycle: bool = False
    cache: int = 1
    schema: str = "public"


@dataclass(frozen=True)
class Reference:
    target: Callable[[], ColumnRef] | ColumnRef
    on_delete: str = "CASCADE"

    def __post_init__(self):
        if self.on_delete not in ACTIONS:
            raise QueryError(f"ON DELETE is one of {', '.join(ACTIONS)}")

    def resolve(self) -> ColumnRef:
        return self.target if isinstance(self.target, ColumnRef) else self.target()


@dataclass(frozen=True)
class Col:
    """A column's declaration; modifiers return changed copies."""

    type: ColumnType
    nullable: bool = True
    is_unique: bool = False
    is_primary: bool = False
    has_default: bool = False
    default_value: Any = None
    generated: str | None = None
    expression: Any = None
    reference: Reference | None = None
    checks: tuple = ()
    insert_fn: Callable[[], Any] | None = None
    update_fn: Callable[[], Any] | None = None
    opclass_name: str | None = None

    def not_null(self) -> Col:
        return replace(self, nullable=False)

    def unique(self) -> Col:
        return replace(self, is_unique=True)

    def primary_key(self) -> Col:
        return replace(self, is_primary=True, nullable=False)

    def default(self, value: Any) -> Col:
        return replace(self, has_default=True, default_value=value)

    def generated_always(self, expression: Any = None) -> Col:
        """Numbered by the store, or computed by an expression of the row; never inserted."""
        return replace(self, generated="always", expression=expression, nullable=False if expression is None else self.nullable)

    def generated_by_default(self) -> Col:
        return replace(self, generated="default", nullable=False)

    def references(self, target: Callable[[], ColumnRef] | ColumnRef, on_delete: str = "CASCADE") -> Col:
        return replace(self, reference=Reference(target, on_delete))

    def check(self, fn: Callable[[ColumnRef], Expr]) -> Col:
        return replace(self, checks=(*self.checks, fn))

    def on_insert(self, fn: Callable[[], Any]) -> Col:
        return replace(self, insert_fn=fn)

    def on_update(self, fn: Callable[[], Any]) -> Col:
        return replace(self, update_fn=fn)

    def opclass(self, name: str) -> Col:
        return replace(self, opclass_name=name)

    def array(self, *sizes: int | None) -> Col:
        return replace(self, type=self.type.array(*sizes))

    @property
    def numbered(self) -> bool:
        return self.type.serial or self.generated is not None and self.expression is None


def pk() -> Col:
    """A bigint primary key that the store numbers."""
    return Col(types.bigint()).primary_key().generated_always()


@dataclass(frozen=True)
class Index:
    columns: tuple[str, ...]
    method: str = "btree"
    is_unique: bool = False
    opclasses: tuple = ()
    name: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "columns", (self.columns,) if isinstance(self.columns, str) else tuple(self.columns))
        if not self.columns:
            raise QueryError("an index needs a column")

    def named(self, table: str) -> str:
        return self.name or f"{table}_{'_'.join(self.columns)}_index"


@dataclass(frozen=True)
class PrimaryKey:
    columns: tuple[str, ...]
    name: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        if len(self.columns) < 2:
            raise QueryError("a composite primary key needs two columns at least")


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]
    name: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        if len(self.columns) < 2:
            raise QueryError("a composite unique constraint needs two columns at least")


@dataclass(frozen=True)
class Check:
    name: str
    condition: Callable[[Table], Expr]


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    target: Callable[[], tuple[ColumnRef, ...]]
    on_delete: str = "CASCADE"
    name: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "columns", (self.columns,) if isinstance(self.columns, str) else tuple(self.columns))
        if self.on_delete not in ACTIONS:
            raise QueryError(f"ON DELETE is one of {', '.join(ACTIONS)}")

    def resolve(self) -> tuple[ColumnRef, ...]:
        got = self.target()
        return got if isinstance(got, tuple) else (got,)


class Named:
    """Something with columns that a query can read: a table or a named query. Columns are attributes (or items, where an attribute of the table itself has the name, such as ``schema``)."""

    def __init__(self, name: str, columns: dict[str, ColumnType | None]):
        self.table_name = name
        self.c = {n: ColumnRef(name, n, t) for n, t in columns.items()}

    def __getattr__(self, name: str) -> ColumnRef:
        try:
            return self.__dict__["c"][name]
        except KeyError:
            raise AttributeError(f"{self.__dict__.get('table_name')} has no column {name}") from None

    def __getitem__(self, name: str) -> ColumnRef:
        return self.c[name]


class Table(Named):
    """columns: name -> Col or ColumnType; extra: indexes and constraints."""

    def __init__(self, name: str, columns: dict[str, Col | ColumnType], *, extra: tuple = (), schema: str = "public", source: str | None = None):
        self.columns = {n: c if isinstance(c, Col) else Col(c) for n, c in columns.items()}
        super().__init__(name, {n: c.type for n, c in self.columns.items()})
        self.schema, self.source = schema, source or name
        self.extra = tuple(extra)
        if unknown := [c for e in self.extra if not isinstance(e, Check) for c in e.columns if c not in self.columns]:
            raise QueryError(f"{name} has no column {unknown[0]}")
        self.key_columns = next((e.columns for e in self.extra if isinstance(e, PrimaryKey)), tuple(n for n, c in self.columns.items() if c.is_primary))

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.type.spark, True) for n, c in self.columns.items()])

    def foreign_keys(self) -> list[tuple[tuple[str, ...], tuple[ColumnRef, ...], str]]:
        """(own columns, target columns, action) of all foreign keys."""
        out = [((n,), (c.reference.resolve(),), c.reference.on_delete) for n, c in self.columns.items() if c.reference]
        return out + [(e.columns, e.resolve(), e.on_delete) for e in self.extra if isinstance(e, ForeignKey)]

    def unique_sets(self) -> list[tuple[str, ...]]:
        out = [self.key_columns] if self.key_columns else []
        out += [(n,) for n, c in self.columns.items() if c.is_unique and (n,) not in out]
        out += [e.columns for e in self.extra if isinstance(e, Unique)]
        return out + [e.columns for e in self.extra if isinstance(e, Index) and e.is_unique]

    def checks(self) -> list[tuple[str, Expr]]:
        out = [(f"{self.table_name}_{n}_check", fn(self.c[n])) for n, c in self.columns.items() for fn in c.checks]
        return out + [(e.name, e.condition(self)) for e in self.extra if isinstance(e, Check)]


@dataclass(frozen=True)
class Relation:
    kind: str
    table: Callable[[], Table] | Table
    column: Callable[[], ColumnRef] | ColumnRef | None = None

    def target(self) -> Table:
        return self.table if isinstance(self.table, Table) else self.table()

    def via(self) -> ColumnRef | None:
        return self.column if isinstance(self.column, (ColumnRef, type(None))) else self.column()


def many(table: Callable[[], Table] | Table, via: Callable[[], ColumnRef] | ColumnRef | None = None) -> Relation:
    """All rows of another table that refer to this one."""
    return Relation("many", table, via)


def one(table: Callable[[], Table] | Table, via: Callable[[], ColumnRef] | ColumnRef | None = None) -> Relation:
    """The row of another table that refers to this one, or null."""
    return Relation("one", table, via)


def fk(table: Callable[[], Table] | Table, via: Callable[[], ColumnRef] | ColumnRef | None = None) -> Relation:
    """The row that this table refers to, or null; via: this table's column."""
    return Relation("fk", table, via)


@dataclass(frozen=True)
class Relations:
    """A table's relations by name."""

    table: Table
    items: dict[str, Relation] = field(hash=False)


def relations(table: Table, items: dict[str, Relation]) -> Relations:
    return Relations(table, items)
