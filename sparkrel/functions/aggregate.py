"""Aggregates. Nulls don't count; an empty input sums to null and counts to 0."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import Aggregate, ColumnRef, Expr, QueryError, as_expr, require


def _operand(e: Any, what: str) -> Expr:
    e = as_expr(e)
    if e.is_aggregate:
        raise QueryError(f"{what} of an aggregate")
    return e


def count(what: ColumnRef | str = "*") -> Aggregate:
    """All rows, or those where a column isn't null."""
    if what == "*":
        return Aggregate("count*", render=lambda: F.count(F.lit(1)), kind="numeric", integral=True)
    if not isinstance(what, ColumnRef):
        raise QueryError("count takes a column or '*'")
    return Aggregate("count", (what,), F.count, kind="numeric", integral=True)


def count_distinct(column: ColumnRef) -> Aggregate:
    """Exactly how many values a column has."""
    if not isinstance(column, ColumnRef):
        raise QueryError("count_distinct takes a column")
    return Aggregate("count_distinct", (column,), F.countDistinct, kind="numeric", integral=True)


def sum_(e: Any) -> Aggregate:
    """Sum; of bigints as decimal(38,0), which doesn't overflow."""
    e = _operand(e, "sum")
    require(e, ("numeric",), "sum")
    wide = e.type is not None and isinstance(e.type.spark, T.LongType)
    return Aggregate("sum", (e,), (lambda c: F.sum(c.cast("decimal(38,0)"))) if wide else F.sum, kind="numeric", integral=e.integral)


def avg(e: Any) -> Aggregate:
    e = _operand(e, "avg")
    require(e, ("numeric",), "avg")
    return Aggregate("avg", (e,), F.avg, kind="numeric")


def _extreme(name: str, e: Any, fn, by) -> Aggregate:
    e = _operand(e, name)
    enum = e.type.enum if e.type is not None else None
    render = fn if enum is None else lambda c: by(c, F.array_position(F.array(*map(F.lit, enum.values)), c))
    return Aggregate(name, (e,), render, kind=e.kind, integral=e.integral, type=e.type)


def min_(e: Any) -> Aggregate:
    """Smallest value; of an enum the one declared first."""
    return _extreme("min", e, F.min, F.min_by)


def max_(e: Any) -> Aggregate:
    """Largest value; of an enum the one declared last."""
    return _extreme("max", e, F.max, F.max_by)
