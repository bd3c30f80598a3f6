"""One-line queries: counts, existence, first row, single aggregates, distinct values. Each has a lazy DataFrame and a value."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import ColumnRef, Expr, Scope
from ..functions.aggregate import avg, count, max_, min_, sum_
from ..schema import Named
from .select import Order, asc, filtered

if TYPE_CHECKING:
    from ..engine import Engine


class Shortcuts:
    def __init__(self, engine: Engine):
        self.engine = engine

    def _agg(self, table: Named, fn: Expr, where: Expr | None) -> DataFrame:
        return self.engine.from_(table).select({"value": fn}).where(where).frame()

    def count(self, table: Named, where: Expr | None = None) -> int:
        return self.count_df(table, where).first()[0]

    def count_df(self, table: Named, where: Expr | None = None) -> DataFrame:
        return self._agg(table, count("*"), where)

    def exists(self, table: Named, where: Expr | None = None) -> bool:
        return not self._rows(table, where).limit(1).isEmpty()

    def exists_df(self, table: Named, where: Expr | None = None) -> DataFrame:
        return self._rows(table, where).limit(1).agg((F.count(F.lit(1)) > 0).alias("value"))

    def _rows(self, table: Named, where: Expr | None) -> DataFrame:
        return filtered(self.engine.frame(table, {}).alias(table.table_name), where, Scope())

    def first(self, table: Named, where: Expr | None = None) -> dict | None:
        row = self.first_df(table, where).first()
        return None if row is None else row.asDict(True)

    def first_df(self, table: Named, where: Expr | None = None) -> DataFrame:
        """Some row; no order is promised."""
        return self._rows(table, where).limit(1)

    def distinct_df(self, table: Named, column: ColumnRef, where: Expr | None = None) -> DataFrame:
        """A column's values in ascending order, null last."""
        return self.engine.from_(table).select({column.name: column}).where(where).group_by(column).order_by(Order(column)).frame()

    def distinct(self, table: Named, column: ColumnRef, where: Expr | None = None) -> list[Any]:
        return [r[0] for r in self.distinct_df(table, column, where).collect()]

    def sum_df(self, table: Named, column: Expr, where: Expr | None = None) -> DataFrame:
        return self._agg(table, sum_(column), where)

    def avg_df(self, table: Named, column: Expr, where: Expr | None = None) -> DataFrame:
        return self._agg(table, avg(column), where)

    def min_df(self, table: Named, column: Expr, where: Expr | None = None) -> DataFrame:
        return self._agg(table, min_(column), where)

    def max_df(self, table: Named, column: Expr, where: Expr | None = None) -> DataFrame:
        return self._agg(table, max_(column), where)

    def sum(self, *a: Any) -> Any:
        return self.sum_df(*a).first()[0]

    def avg(self, *a: Any) -> Any:
        return self.avg_df(*a).first()[0]

    def min(self, *a: Any) -> Any:
        return self.min_df(*a).first()[0]

    def max(self, *a: Any) -> Any:
        return self.max_df(*a).first()[0]


__all__ = ["Shortcuts", "asc"]
