"""Expressions: trees that know whether they aggregate, and become Spark columns only when a plan is lowered."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from .types import ColumnType


class QueryError(ValueError):
    """A query that can't be meant."""


@dataclass
class Scope:
    """What names stand for while a plan is lowered: table aliases, argument values, and expressions that are columns already."""

    aliases: dict[str, str] = field(default_factory=dict)
    args: dict[str, Any] = field(default_factory=dict)
    done: dict[Any, str] = field(default_factory=dict)

    def argument(self, arg: Arg) -> Any:
        if arg.name not in self.args:
            raise QueryError(f"no value for argument {arg.name}")
        value = self.args[arg.name]
        if arg.type is not None and (why := arg.type.accepts(value)):
            raise QueryError(f"argument {arg.name}: {why}")
        return value

    def value(self, v: Any) -> Any:
        return self.argument(v) if isinstance(v, Arg) else v


class Expr:
    """op and params name the operation; kind: category of values; integral: whether they are whole numbers."""

    aggregates = False

    def __init__(self, op: str, children: tuple = (), render: Callable[..., SparkColumn] | None = None, *, params: tuple = (), kind: str = "any", integral: bool = False, type: ColumnType | None = None):
        self.op, self.children, self.params, self.kind, self.integral, self.type = op, tuple(map(as_expr, children)), params, kind, integral, type
        self._render = render

    @property
    def is_aggregate(self) -> bool:
        return self.aggregates or any(c.is_aggregate for c in self.children)

    @property
    def key(self) -> tuple:
        return (self.op, self.params, tuple(c.key for c in self.children))

    def lower(self, scope: Scope) -> SparkColumn:
        if scope.done and (name := scope.done.get(self.key)):
            return F.col(f"`{name}`")
        return self._render(*(c.lower(scope) for c in self.children))

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children:
            yield from c.walk()

    __hash__ = object.__hash__


class Aggregate(Expr):
    aggregates = True


class Filter(Expr):
    """A boolean expression."""


class Literal(Expr):
    def __init__(self, value: Any):
        super().__init__("literal", params=(repr(value), type(value).__name__), kind=_kind_of(value), integral=isinstance(value, int) and not isinstance(value, bool))
        self.value = value

    def lower(self, scope: Scope) -> SparkColumn:
        return literal(self.value)


class Arg(Expr):
    """A named argument of a prepared query, bound by its name."""

    def __init__(self, name: str, type: ColumnType | None = None, kind: str = "any", integral: bool = False):
        super().__init__("arg", params=(name,), kind=type.category if type else kind, integral=type.integral if type else integral, type=type)
        self.name = name

    def lower(self, scope: Scope) -> SparkColumn:
        value = literal(scope.argument(self))
        return value.cast(self.type.spark) if self.type is not None else value

    @staticmethod
    def number(name: str) -> Arg:
        return Arg(name, kind="numeric")

    @staticmethod
    def bigint(name: str) -> Arg:
        return Arg(name, kind="numeric", integral=True)


class Raw(Filter):
    """A piece of Spark SQL; {0}, {1} ... stand for the given expressions or values."""

    def __init__(self, text: str, *values: Any):
        super().__init__("raw", values, params=(text,))
        self.text = text

    def lower(self, scope: Scope) -> SparkColumn:
        if not self.children:
            return F.expr(self.text)
        names = []
        for c in self.children:
            if isinstance(c, ColumnRef):
                names.append(c.quoted(scope))
            else:
                names.append(_sql_literal(scope.argument(c) if isinstance(c, Arg) else c.value if isinstance(c, Literal) else _not_literal()))
        return F.expr(self.text.format(*names))


def _not_literal():
    raise QueryError("raw SQL takes columns, values and arguments")


def sql(text: str, *values: Any) -> Raw:
    return Raw(text, *values)


def _sql_literal(v: Any) -> str:
    """A value as SQL text, quoted; never taken over as it is."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, Decimal)):
        return str(v)
    if isinstance(v, float):
        return f"double('{v!r}')"
    if isinstance(v, dt.datetime):
        return f"timestamp'{v.isoformat(sep=' ')}'"
    if isinstance(v, dt.date):
        return f"date'{v.isoformat()}'"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{v.hex()}'"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise QueryError(f"{type(v).__name__} has no SQL literal")


def literal(v: Any) -> SparkColumn:
    """A Python value as a column; lists become arrays."""
    if isinstance(v, (list, tuple)):
        return F.array(*map(literal, v))
    if isinstance(v, dt.datetime) and v.tzinfo is None:
        return F.lit(v).cast("timestamp_ntz")
    return F.lit(v)


def _kind_of(v: Any) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float, Decimal)):
        return "numeric"
    if isinstance(v, str):
        return "text"
    if isinstance(v, (dt.date, dt.datetime)):
        return "datetime"
    return "any"


def as_expr(v: Any) -> Expr:
    return v if isinstance(v, Expr) else Literal(v)


class ColumnRef(Expr):
    """A column of a table or of a named query."""

    def __init__(self, table: str, name: str, type: ColumnType | None = None):
        super().__init__("column", params=(table, name), kind=type.category if type else "any", integral=bool(type and type.integral), type=type)
        self.table, self.name = table, name

    def quoted(self, scope: Scope) -> str:
        return f"`{scope.aliases.get(self.table, self.table)}`.`{self.name}`"

    def lower(self, scope: Scope) -> SparkColumn:
        if scope.done and (name := scope.done.get(self.key)):
            return F.col(f"`{name}`")
        return F.col(self.quoted(scope))

    def arg(self, name: str) -> Arg:
        """An argument of this column's type."""
        return Arg(name, self.type)


def ordered(e: Expr, c: SparkColumn) -> SparkColumn:
    """What e sorts by: enums by their declaration."""
    enum = e.type.enum if e.type is not None else None
    return F.array_position(F.array(*map(F.lit, enum.values)), c) if enum is not None else c


def require(e: Expr, kinds: tuple[str, ...], what: str) -> None:
    if e.kind not in (*kinds, "any"):
        raise QueryError(f"{what} takes {' or '.join(kinds)} values, not {e.kind}")
