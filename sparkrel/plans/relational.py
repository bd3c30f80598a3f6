"""Nested results: each row with its related rows as structs and arrays, in one plan.

A relation's rows are read once, filtered, ranked and limited per parent by a
window over the joining column, collected per parent and joined to it. Limits
of the outermost rows apply before any relation is joined, and then only the
related rows of those that are left are ranked and collected.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..expr import Expr, QueryError, Scope, ordered
from ..operators.select import Order, filtered, orders_of
from ..schema import Relation, Table

if TYPE_CHECKING:
    from ..engine import Engine

OPTIONS = {"columns", "where", "order_by", "limit", "offset", "with_"}


class RelationError(QueryError):
    """A relation that can't be resolved or an option that it doesn't take."""


def picked(table: Table, columns: dict[str, bool] | None) -> list[str]:
    """Names to keep: those set true, or all but those set false."""
    if not columns:
        return list(table.c)
    if unknown := [c for c in columns if c not in table.c]:
        raise RelationError(f"{table.table_name} has no column {unknown[0]}")
    if any(columns.values()):
        return [c for c in table.c if columns.get(c)]
    return [c for c in table.c if c not in columns]


def joining(parent: Table, relation: Relation) -> tuple[str, str]:
    """(the parent's column, the related table's column) that a relation joins."""
    child, via = relation.target(), relation.via()
    owner, other = (parent, child) if relation.kind == "fk" else (child, parent)
    for own, target, _ in owner.foreign_keys():
        if len(own) == 1 and target[0].table == other.table_name and (via is None or via.name == own[0]):
            pair = own[0], target[0].name
            break
    else:
        if via is None or len(other.key_columns) != 1:
            raise RelationError(f"no foreign key leads from {owner.table_name} to {other.table_name}")
        pair = via.name, other.key_columns[0]
    return pair if relation.kind == "fk" else pair[::-1]


def _checked(options: dict, kind: str) -> dict:
    if unknown := set(options) - OPTIONS:
        raise RelationError(f"no option {sorted(unknown)[0]}")
    if kind != "many" and (bad := [k for k in ("where", "order_by", "limit", "offset") if options.get(k) is not None]):
        raise RelationError(f"a {kind} relation takes no {bad[0]}")
    return options


class RelationQuery:
    """find_many and find_first of a table."""

    def __init__(self, engine: Engine, table: Table, options: dict[str, Any], first: bool = False):
        self.engine, self.table, self.options, self.first = engine, table, options, first
        if unknown := set(options) - OPTIONS:
            raise RelationError(f"no option {sorted(unknown)[0]}")

    def frame(self, args: dict[str, Any] | None = None) -> DataFrame:
        scope = Scope(args=args or {})
        o = self.options
        df = filtered(self.engine.frame(self.table, scope.args).alias(self.table.table_name), o.get("where"), scope)
        limit = 1 if self.first else o.get("limit")
        by = [x.sorted(ordered(x.what, x.what.lower(scope))) for x in orders_of((o["order_by"],) if isinstance(o.get("order_by"), (Order, Expr)) else tuple(o.get("order_by") or ()))]
        cut = o.get("with_") and limit is not None and bool(self.table.key_columns)
        if cut:  # ties are broken by the key: the rows that are left are read for each relation, and must be the same
            by_key = [F.col(f"`{self.table.table_name}`.`{c}`").asc() for c in self.table.key_columns]
            df = df.orderBy(*by, *by_key)
        elif by:
            df = df.orderBy(*by)
        if o.get("offset") is not None:
            df = df.offset(int(scope.value(o["offset"])))
        if limit is not None:
            df = df.limit(int(scope.value(limit)))
        df = nested(self.engine, self.table, df, o, scope, self.table.table_name, few=bool(cut))
        if by and o.get("with_"):  # joins don't keep the order
            return df.orderBy(*(F.col(f"__by{i}").desc_nulls_first() if x.descending else F.col(f"__by{i}").asc_nulls_last() for i, x in enumerate(self._orders()))).select(*(c for c in df.columns if not c.startswith("__by")))
        return df

    def _orders(self) -> tuple[Order, ...]:
        o = self.options.get("order_by")
        return orders_of((o,) if isinstance(o, (Order, Expr)) else tuple(o or ()))

    @property
    def df(self) -> DataFrame:
        return self.frame()

    def explain(self, **args: Any) -> None:
        """Prints the physical plan."""
        self.frame(args).explain("formatted")

    def collect(self, **args: Any) -> Any:
        rows = self.engine.logged(f"find in {self.table.table_name}", args, lambda: [r.asDict(True) for r in self.frame(args).collect()])
        return (rows[0] if rows else None) if self.first else rows

    def columns(self) -> dict[str, Any]:
        return {n: self.table.c[n].type if n in self.table.c else None for n in [*picked(self.table, self.options.get("columns")), *(self.options.get("with_") or {})]}


def nested(engine: Engine, table: Table, df: DataFrame, options: dict, scope: Scope, alias: str, keep: str | None = None, few: bool = False) -> DataFrame:
    """df (aliased) with picked columns and its relations; keep: a column to hold on as __key; few: a limit is above, so relations' rows are looked up by df's keys."""
    columns = picked(table, options.get("columns"))
    wanted = options.get("with_") or {}
    related = engine.relations_of(table)
    if unknown := [r for r in wanted if r not in related]:
        raise RelationError(f"{table.table_name} has no relation {unknown[0]}")
    if clash := [r for r in wanted if r in columns]:
        raise RelationError(f"{clash[0]} names a column and a relation")
    keys = {r: joining(table, related[r]) for r in wanted}
    here = Scope({**scope.aliases, table.table_name: alias}, scope.args)
    by = options.get("order_by") if keep is None and wanted else None
    orders = orders_of((by,) if isinstance(by, (Order, Expr)) else tuple(by or ()))
    extra = [F.col(f"`{alias}`.`{p}`").alias(f"__p_{r}") for r, (p, _) in keys.items()]
    extra += [ordered(o.what, o.what.lower(here)).alias(f"__by{i}") for i, o in enumerate(orders)]
    if keep is not None:
        extra.append(F.col(f"`{alias}`.`{keep}`").alias("__key"))
    if "__rank" in df.columns:
        extra.append(F.col("__rank"))
    parents = {r: df.select(F.col(f"`{alias}`.`{p}`").alias("__parent")) if few else None for r, (p, _) in keys.items()}
    df = df.select(*(F.col(f"`{alias}`.`{c}`").alias(c) for c in columns), *extra)
    for r, inner in wanted.items():
        relation = related[r]
        inner = _checked({} if inner is True else inner, relation.kind)
        child = child_rows(engine, relation, keys[r][1], inner, scope, f"{alias}__{r}", parents[r]).withColumnRenamed("__key", f"__c_{r}").withColumnRenamed("__value", r)
        df = df.join(child, F.col(f"__p_{r}") == F.col(f"__c_{r}"), "left").drop(f"__p_{r}", f"__c_{r}")
        if relation.kind == "many":
            df = df.withColumn(r, F.coalesce(F.col(f"`{r}`"), F.array().cast(df.schema[r].dataType)))
    return df.select(*(F.col(f"`{c}`") for c in [*columns, *wanted]), *(c for c in df.columns if c.startswith("__by") or c in ("__key", "__rank")))


def child_rows(engine: Engine, relation: Relation, column: str, options: dict, scope: Scope, alias: str, parents: DataFrame | None = None) -> DataFrame:
    """(__key, __value): a relation's rows for each value of its joining column, or for those of ``parents`` only."""
    table = relation.target()
    here = Scope({**scope.aliases, table.table_name: alias}, scope.args)
    df = engine.frame(table, scope.args).alias(alias).filter(F.col(f"`{alias}`.`{column}`").isNotNull())
    df = filtered(df, options.get("where"), here)
    key = F.col(f"`{alias}`.`{column}`")
    if parents is not None:
        df = df.join(parents, key == F.col("__parent"), "left_semi")
    few = parents is not None
    names = [*picked(table, options.get("columns")), *(options.get("with_") or {})]
    row = F.struct(*(F.col(f"`{n}`") for n in names))
    if relation.kind == "fk":  # the referenced column is unique
        return nested(engine, table, df, options, here, alias, column, few).select("__key", row.alias("__value"))
    by = orders_of((options["order_by"],) if isinstance(options.get("order_by"), (Order, Expr)) else tuple(options.get("order_by") or ()))
    order = [o.sorted(ordered(o.what, o.what.lower(here))) for o in by] or [F.col(f"`{alias}`.`{c}`").asc() for c in (table.key_columns or (column,))]
    limit, offset = (None if options.get(k) is None else int(scope.value(options[k])) for k in ("limit", "offset"))
    if relation.kind == "one":
        limit, offset = 1, None
    if by or limit is not None or offset is not None:
        df = df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        if limit is not None:
            df = df.filter(F.col("__rank") <= limit + (offset or 0))
        if offset:
            df = df.filter(F.col("__rank") > offset)
    df = nested(engine, table, df, options, here, alias, column, few)
    if relation.kind == "one":
        return df.select("__key", row.alias("__value"))
    if "__rank" not in df.columns:
        return df.groupBy("__key").agg(F.collect_list(row).alias("__value"))
    ranked = F.array_sort(F.collect_list(F.struct(F.col("__rank"), row.alias("row"))), lambda a, b: a.getField("__rank") - b.getField("__rank"))
    return df.groupBy("__key").agg(F.transform(ranked, lambda x: x.row).alias("__value"))
