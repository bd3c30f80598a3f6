"""Predicates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..expr import Arg, ColumnRef, Expr, Filter, Literal, QueryError, Scope, as_expr, ordered, require, sql
from ..functions.geo import haversine, near, point_literal

#: Points nearer than this, in metres, count as equal.
SAME_POINT = 1e-5


def _compare(op: str, l: Any, r: Any, fn, by_order: bool = False) -> Filter:
    l, r = as_expr(l), as_expr(r)
    if isinstance(l, Literal):
        raise QueryError("the left side is a column or a function")
    enum = next((e for e in (l, r) if e.type is not None and e.type.enum is not None), None)
    if by_order and enum is not None:
        return Filter(op, (l, r), lambda a, b: fn(ordered(enum, a), ordered(enum, b)), kind="boolean")
    return Filter(op, (l, r), fn, kind="boolean")


def eq(l: Any, r: Any) -> Filter:
    """l = r; never true for null."""
    return _compare("eq", l, r, lambda a, b: a == b)


def ne(l: Any, r: Any) -> Filter:
    return _compare("ne", l, r, lambda a, b: a != b)


def gt(l: Any, r: Any) -> Filter:
    return _compare("gt", l, r, lambda a, b: a > b, True)


def gte(l: Any, r: Any) -> Filter:
    return _compare("gte", l, r, lambda a, b: a >= b, True)


def lt(l: Any, r: Any) -> Filter:
    return _compare("lt", l, r, lambda a, b: a < b, True)


def lte(l: Any, r: Any) -> Filter:
    return _compare("lte", l, r, lambda a, b: a <= b, True)


def is_null(e: Any) -> Filter:
    return Filter("is_null", (e,), lambda c: c.isNull(), kind="boolean")


def is_not_null(e: Any) -> Filter:
    return Filter("is_not_null", (e,), lambda c: c.isNotNull(), kind="boolean")


class InQuery(Filter):
    """Whether a value is among those of a query's only column: a left semi join, or within other conditions a join that marks rows."""

    def __init__(self, e: Expr, query: Any):
        super().__init__("in_query", (e,), params=(id(query),), kind="boolean")
        self.query = query

    def lower(self, scope: Scope):
        if self.key not in scope.done:
            raise QueryError("is_in with a query belongs in where or having")
        return F.coalesce(F.col(scope.done[self.key]), F.lit(False))


def is_in(e: Any, values: Any) -> Filter:
    """One of some values, or of a query's; of no values: false."""
    e = as_expr(e)
    if hasattr(values, "frame"):
        return InQuery(e, values)
    values = list(values)
    if not values:
        return Filter("false", render=lambda: F.lit(False), kind="boolean")
    return Filter("in", (e, *values), lambda c, *v: c.isin(*v), kind="boolean")


def not_in(e: Any, values: Any) -> Filter:
    """None of some values; of no values: true."""
    if hasattr(values, "frame"):
        raise QueryError("not_in takes a list")
    values = list(values)
    if not values:
        return Filter("true", render=lambda: F.lit(True), kind="boolean")
    return Filter("not_in", (e, *values), lambda c, *v: ~c.isin(*v), kind="boolean")


def _joined(op: str, items: tuple, empty: bool, fn) -> Filter:
    live = tuple(i for i in items if i is not None)

    def render(*cols):
        out = F.lit(empty) if not cols else cols[0]
        for c in cols[1:]:
            out = fn(out, c)
        return out

    return Filter(op, live, render, kind="boolean")


def and_(*conditions: Expr | None) -> Filter:
    """All of them; None is skipped, and nothing left is true."""
    return _joined("and", conditions, True, lambda a, b: a & b)


def or_(*conditions: Expr | None) -> Filter:
    """Any of them; None is skipped, and nothing left is false."""
    return _joined("or", conditions, False, lambda a, b: a | b)


def _text(op: str, e: Any, pattern: Any, fn) -> Filter:
    e, pattern = as_expr(e), as_expr(pattern)
    require(e, ("text",), op)
    return Filter(op, (e, pattern), fn, kind="boolean")


def starts_with(e: Any, prefix: Any) -> Filter:
    return _text("starts_with", e, prefix, lambda c, p: c.startswith(p))


def ends_with(e: Any, suffix: Any) -> Filter:
    return _text("ends_with", e, suffix, lambda c, s: c.endswith(s))


def contains(e: Any, part: Any) -> Filter:
    """Has part in it, literally."""
    return _text("contains", e, part, lambda c, s: c.contains(s))


def like(e: Any, pattern: str | Arg) -> Filter:
    """Case-sensitive LIKE with % and _, and backslash as escape."""
    return _text("like", e, pattern, lambda c, p: F.like(c, p))


def _flat(e: Expr, c):
    for _ in range(max(0, len(e.type.dims) - 1) if e.type is not None else 0):
        c = F.flatten(c)
    return c


def _flat_values(values: Any) -> Any:
    if isinstance(values, (list, tuple)) and values and isinstance(values[0], (list, tuple)):
        return _flat_values([x for v in values for x in v])
    return values


def _array(op: str, e: ColumnRef, values: Any, fn) -> Filter:
    e = as_expr(e)
    require(e, ("array",), op)
    values = _flat_values(values)
    inner = e.type.element.spark if e.type is not None and e.type.element is not None else None

    def render(c, v):
        return fn(_flat(e, c), v.cast(f"array<{inner.simpleString()}>") if inner is not None else v)

    return Filter(op, (e, values), render, kind="boolean")


def _all_in(a, b):
    """Every element of a is in b; a null element is in nothing."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(F.forall(a, lambda x: F.coalesce(F.array_contains(b, x), F.lit(False))))


def array_contains(column: ColumnRef, values: Any) -> Filter:
    """The array holds all these values, in whatever order and number."""
    return _array("array_contains", column, values, lambda c, v: _all_in(v, c))


def array_contained_by(column: ColumnRef, values: Any) -> Filter:
    """All of the array's elements are among these values."""
    return _array("array_contained_by", column, values, lambda c, v: _all_in(c, v))


def array_overlaps(column: ColumnRef, values: Any) -> Filter:
    """The array has an element among these values."""
    return _array("array_overlaps", column, values, lambda c, v: F.when(c.isNotNull() & v.isNotNull(), F.exists(c, lambda x: F.coalesce(F.array_contains(v, x), F.lit(False)))))


def _element(op: str, column: ColumnRef, value: Any, fn) -> Filter:
    e = as_expr(column)
    require(e, ("array",), op)
    return Filter(op, (e, value), lambda c, v: fn(_flat(e, c), v), kind="boolean")


def array_has(column: ColumnRef, value: Any) -> Filter:
    """Some element equals the value."""
    return _element("array_has", column, value, lambda c, v: F.exists(c, lambda x: x == v))


def array_all(column: ColumnRef, value: Any) -> Filter:
    """Every element equals the value; true for the empty array."""
    return _element("array_all", column, value, lambda c, v: F.forall(c, lambda x: x == v))


def _spatial(op: str, column: Any, point: Any, fn, params: tuple = (), more: tuple = ()) -> Filter:
    e, p = as_expr(column), point_literal(point)
    require(e, ("geography",), op)
    return Filter(op, (e, p, *more), fn, params=params, kind="boolean")


def st_dwithin(column: Any, point: Any, metres: Any) -> Filter:
    """At most so many metres from a point, on the ellipsoid."""
    return _spatial("st_dwithin", column, point, near, more=(metres,))


def st_intersects(column: Any, point: Any) -> Filter:
    """The same point."""
    return _spatial("st_intersects", column, point, lambda a, b: haversine(a, b) <= SAME_POINT)


def st_contains(column: Any, point: Any) -> Filter:
    """The same point (a point contains only itself)."""
    return _spatial("st_contains", column, point, lambda a, b: haversine(a, b) <= SAME_POINT)


def st_within(column: Any, point: Any) -> Filter:
    """The same point (a point is within itself only)."""
    return _spatial("st_within", column, point, lambda a, b: haversine(a, b) <= SAME_POINT)


__all__ = [
    "and_", "array_all", "array_contained_by", "array_contains", "array_has", "array_overlaps", "contains", "ends_with", "eq", "gt", "gte", "is_in", "is_not_null", "is_null", "like", "lt", "lte", "ne", "not_in", "or_", "sql",
    "st_contains", "st_dwithin", "st_intersects", "st_within", "starts_with",
]
