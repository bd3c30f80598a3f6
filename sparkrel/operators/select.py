"""Select queries: an immutable description, lowered to one DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..expr import Arg, ColumnRef, Expr, QueryError, Scope, ordered
from ..schema import Named
from .filters import InQuery

if TYPE_CHECKING:
    from ..engine import Engine


@dataclass(frozen=True)
class Order:
    what: Expr | str
    descending: bool = False

    def sorted(self, c):
        return c.desc_nulls_first() if self.descending else c.asc_nulls_last()


def asc(what: Expr | str) -> Order:
    """Ascending, nulls last."""
    return Order(what)


def desc(what: Expr | str) -> Order:
    """Descending, nulls first."""
    return Order(what, True)


def orders_of(what: tuple) -> tuple[Order, ...]:
    items = what[0] if len(what) == 1 and isinstance(what[0], (list, tuple)) else what
    return tuple(o if isinstance(o, Order) else Order(o) for o in items)


def listed(query: InQuery, scope: Scope, name: str) -> DataFrame:
    """The values of a condition's query, as one column."""
    found = query.query.frame(scope.args)
    if len(found.columns) != 1:
        raise QueryError("is_in takes a query with one column")
    return found.select(F.col(f"`{found.columns[0]}`").alias(name))


def filtered(df: DataFrame, condition: Expr | None, scope: Scope, aggregates: bool = False) -> DataFrame:
    """df where a condition holds. A query in it becomes a left semi join if all depends on it, else a left join that marks the rows whose value it has (a null is as good as false here: nothing negates a condition)."""
    if condition is None:
        return df
    if condition.is_aggregate and not aggregates:
        raise QueryError("aggregates belong in having")
    if isinstance(condition, InQuery):
        return df.join(listed(condition, scope, "__in"), condition.children[0].lower(scope) == F.col("__in"), "left_semi")
    if condition.op == "and":
        plain = [c for c in condition.children if not any(isinstance(x, InQuery) for x in c.walk())]
        for c in plain:
            df = df.filter(c.lower(scope))
        for c in condition.children:
            if c not in plain:
                df = filtered(df, c, scope, aggregates)
        return df
    for query in (x for x in condition.walk() if isinstance(x, InQuery)):
        mark = f"__in{len(scope.done)}"
        values = listed(query, scope, f"{mark}_value").distinct().withColumn(mark, F.lit(True))
        df = df.join(values, query.children[0].lower(scope) == F.col(f"{mark}_value"), "left")
        scope.done[query.key] = mark
    return df.filter(condition.lower(scope))


@dataclass(frozen=True)
class Select:
    """from_ .. join .. select .. where .. group_by .. having .. order_by .. limit .. offset; every call returns a new one."""

    engine: Engine
    base: Named
    joins: tuple = ()
    items: dict[str, Expr] | None = field(default=None, hash=False)
    condition: Expr | None = None
    groups: tuple | None = None
    having_: Expr | None = None
    orders: tuple[Order, ...] = ()
    limit_: Any = None
    offset_: Any = None
    distinct_: tuple = ()
    suffix: bool = False

    def inner_join(self, table: Named, on: Expr) -> Select:
        return replace(self, joins=(*self.joins, ("inner", table, on)))

    def left_join(self, table: Named, on: Expr) -> Select:
        return replace(self, joins=(*self.joins, ("left", table, on)))

    def select(self, items: dict[str, Expr] | None = None, *, suffix: bool = False) -> Select:
        """Named expressions; without any all columns, which must not clash unless suffix adds the table's name to those of joined tables."""
        return replace(self, items=items, suffix=suffix)

    def where(self, condition: Expr | None) -> Select:
        """The condition; a later call replaces it."""
        if condition is not None and condition.is_aggregate:
            raise QueryError("aggregates belong in having")
        return replace(self, condition=condition)

    def group_by(self, *what: Expr | list | Callable[[dict[str, Expr]], Any]) -> Select:
        """Expressions, or a function from the selected expressions by name to some of them."""
        return replace(self, groups=what)

    def having(self, condition: Expr) -> Select:
        return replace(self, having_=condition)

    def order_by(self, *what: Order | Expr | str | list) -> Select:
        """Orders, by expressions or selected names; a later call replaces them."""
        return replace(self, orders=orders_of(what))

    def limit(self, n: int | Arg) -> Select:
        return replace(self, limit_=n)

    def offset(self, n: int | Arg) -> Select:
        return replace(self, offset_=n)

    def distinct_on(self, *columns: Expr) -> Select:
        """The first row of each key in the order given; the order begins with the keys."""
        return replace(self, distinct_=tuple(columns[0]) if len(columns) == 1 and isinstance(columns[0], (list, tuple)) else columns)

    def _items(self) -> dict[str, Expr]:
        if self.items is not None:
            if not self.items:
                raise QueryError("nothing is selected")
            return dict(self.items)
        out: dict[str, Expr] = {}
        for t in (self.base, *(j[1] for j in self.joins)):
            for n, c in t.c.items():
                name = f"{t.table_name}_{n}" if self.suffix and n in out else n
                if name in out:
                    raise QueryError(f"several tables have a column {n}; name the columns, or use suffix=True")
                out[name] = c
        return out

    def _source(self, scope: Scope) -> DataFrame:
        df = self.engine.frame(self.base, scope.args).alias(self.base.table_name)
        for how, table, on in self.joins:
            df = df.join(self.engine.frame(table, scope.args).alias(table.table_name), on.lower(scope), how)
        return filtered(df, self.condition, scope)

    def _keys(self, items: dict[str, Expr]) -> list[Expr] | None:
        """What to group by: as said, else the selected expressions that don't aggregate if another one does; None: no grouping."""
        if self.groups is not None:
            out: list = []
            for g in self.groups:
                g = g(items) if callable(g) and not isinstance(g, Expr) else g
                out += g if isinstance(g, (list, tuple)) else [g]
            return [items[g] if isinstance(g, str) else g for g in out]
        used = [*items.values(), *([self.having_] if self.having_ is not None else []), *(o.what for o in self.orders if isinstance(o.what, Expr))]
        return [e for e in items.values() if not e.is_aggregate] if any(e.is_aggregate for e in used) else None

    def frame(self, args: dict[str, Any] | None = None) -> DataFrame:
        """The query's result, lazily."""
        scope = Scope(args=args or {})
        items = self._items()
        df = self._source(scope)
        keys = self._keys(items)
        if keys is None and self.having_ is not None:
            raise QueryError("having needs a grouping")
        orders = [Order(items[o.what] if isinstance(o.what, str) else o.what, o.descending) for o in self.orders]
        if keys is not None:
            df, scope = _grouped(df, keys, [*items.values(), *([self.having_] if self.having_ is not None else []), *(o.what for o in orders)], scope)
            if self.having_ is not None:
                df = filtered(df, self.having_, scope, aggregates=True)
        if self.distinct_:
            df, orders = self._first_rows(df, orders, scope)
        df = df.select(*(e.lower(scope).alias(n) for n, e in items.items()), *(ordered(o.what, o.what.lower(scope)).alias(f"__o{i}") for i, o in enumerate(orders)))
        if orders:
            df = df.orderBy(*(o.sorted(F.col(f"__o{i}")) for i, o in enumerate(orders)))
        if self.offset_ is not None:
            df = df.offset(int(scope.value(self.offset_)))
        if self.limit_ is not None:
            df = df.limit(int(scope.value(self.limit_)))
        return df.select(*(F.col(f"`{n}`") for n in items)) if orders else df

    def _first_rows(self, df: DataFrame, orders: list[Order], scope: Scope) -> tuple[DataFrame, list[Order]]:
        keys = {e.key for e in self.distinct_}
        if orders and {o.what.key for o in orders[: len(keys)]} - keys:
            raise QueryError("the order begins with the columns of distinct_on")
        rest = [o.sorted(ordered(o.what, o.what.lower(scope))) for o in orders if o.what.key not in keys]
        w = Window.partitionBy(*(e.lower(scope) for e in self.distinct_)).orderBy(*(rest or [F.lit(0)]))
        return df.withColumn("__first", F.row_number().over(w)).filter("__first = 1"), orders

    @property
    def df(self) -> DataFrame:
        return self.frame()

    def collect(self, **args: Any) -> list[dict]:
        return self.engine.logged(f"select from {self.base.table_name}", args, lambda: [r.asDict(True) for r in self.frame(args).collect()])

    def explain(self) -> None:
        self.frame().explain("formatted")

    def columns(self) -> dict[str, Any]:
        """The result's columns: name -> type, as far as it is known."""
        return {n: e.type for n, e in self._items().items()}


def _grouped(df: DataFrame, keys: list[Expr], used: list[Expr], scope: Scope) -> tuple[DataFrame, Scope]:
    """df grouped, and a scope in which keys and aggregates are its columns."""
    for k in keys:
        if k.is_aggregate:
            raise QueryError("an aggregate can't be a grouping key")
    done: dict[Any, str] = {}
    named = []
    for k in keys:
        if k.key not in done:
            done[k.key] = f"__k{len(named)}"
            named.append(k.lower(scope).alias(done[k.key]))
    aggs = []
    for e in used:
        for x in e.walk():
            if x.aggregates and x.key not in done:
                if any(c.is_aggregate for c in x.children):
                    raise QueryError("an aggregate of an aggregate")
                done[x.key] = f"__a{len(aggs)}"
                aggs.append(x.lower(scope).alias(done[x.key]))
    grouped = Scope(scope.aliases, scope.args, done)
    for e in used:
        _check_grouped(e, done)
    if not aggs:
        return df.select(*named).distinct(), grouped
    return (df.groupBy(*named) if named else df.groupBy()).agg(*aggs), grouped


def _check_grouped(e: Expr, done: dict) -> None:
    if e.key in done:
        return
    if isinstance(e, ColumnRef):
        raise QueryError(f"column {e.table}.{e.name} is neither grouped nor aggregated")
    for c in e.children:
        _check_grouped(c, done)
