"""The engine: tables, relations and where their rows are."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from .expr import QueryError
from .operators.cte import Cte, With
from .operators.select import Select
from .operators.shortcuts import Shortcuts
from .plans.relational import RelationQuery
from .schema import Enum, Named, Relation, Relations, Sequence, Table

log = logging.getLogger("sparkrel")


class Source(Protocol):
    """Where an engine's rows come from."""

    def load(self, spark: SparkSession, table: Table) -> DataFrame: ...


class Engine:
    """tables and relations may be given as lists or found among a module's (or dict's) values."""

    def __init__(self, spark: SparkSession, source: Source, entities: Any = (), *, logger: logging.Logger | None = None):
        self.spark, self.source = spark, source
        self.log = logger or log
        values = list(vars(entities).values() if hasattr(entities, "__dict__") and not isinstance(entities, (list, tuple, dict)) else entities.values() if isinstance(entities, dict) else entities)
        self.tables = {v.table_name: v for v in values if isinstance(v, Table)}
        self.enums = [v for v in values if isinstance(v, Enum)]
        self.sequences = [v for v in values if isinstance(v, Sequence)]
        self._relations: dict[str, dict[str, Relation]] = {}
        for v in values:
            if isinstance(v, Relations):
                self._relations.setdefault(v.table.table_name, {}).update(v.items)
        self.shortcuts = Shortcuts(self)

    def logged(self, what: str, args: Any, action: Callable[[], Any]) -> Any:
        """action's result; its duration, or what it raised, goes to the log."""
        began = time.perf_counter()
        extra = lambda: {"query": what, "arguments": args, "duration_ms": (time.perf_counter() - began) * 1000}
        try:
            out = action()
        except Exception as e:
            self.log.error("%s failed: %s", what, e, extra=extra())
            raise
        self.log.info("%s", what, extra=extra())
        return out

    def relations_of(self, table: Table) -> dict[str, Relation]:
        return self._relations.get(table.table_name, {})

    def frame(self, what: Named, args: dict[str, Any] | None = None) -> DataFrame:
        """The rows of a table or named query, as declared."""
        if isinstance(what, Cte):
            return what.frame(args or {})
        df = self.source.load(self.spark, what)
        out = []
        for n, c in what.columns.items():
            col = df[n]
            if df.schema[n].dataType != c.type.spark:
                col = col.cast(c.type.spark)
            out.append((c.type.read(col) if c.type.read else col).alias(n))
        return df.select(*out)

    def from_(self, what: Named) -> Select:
        if not isinstance(what, Named):
            raise QueryError("from_ takes a table or a named query")
        return Select(self, what)

    def find_many(self, table: Table, **options: Any) -> RelationQuery:
        """Rows with nested relations: columns, where, order_by, limit, offset, with_."""
        return RelationQuery(self, table, options)

    def find_first(self, table: Table, **options: Any) -> RelationQuery:
        if bad := {"limit", "offset"} & set(options):
            raise QueryError(f"find_first takes no {sorted(bad)[0]}")
        return RelationQuery(self, table, options, first=True)

    def cte(self, name: str, query: Any) -> Cte:
        return Cte(name, query)

    def with_(self, *ctes: Cte) -> With:
        return With(self, ctes)

    def raw(self, sql: str, args: list | dict | None = None, rows: Callable[[DataFrame], Any] | None = None) -> Any:
        """Spark SQL over the tables as views; args bind ?, $1 or :name markers; rows turns the result into something else."""
        if isinstance(args, (list, tuple)) and (numbered := _numbered(sql)) != sql:
            sql, args = numbered, {f"_{k}": v for k, v in enumerate(args, 1)}
        for t in self.tables.values():
            if t.table_name.lower() in sql.lower():
                self.frame(t).createOrReplaceTempView(t.table_name)
        return self.logged(sql, args, lambda: (rows or (lambda df: df))(self.spark.sql(sql, args=args) if args else self.spark.sql(sql)))

    def insert(self, table: Table):
        from .operators.dml import Insert

        return Insert(self, table)

    def update(self, table: Table):
        from .operators.dml import Update

        return Update(self, table)

    def delete(self, table: Table):
        from .operators.dml import Delete

        return Delete(self, table)

    def transaction(self, run: Callable[[Engine], Any]) -> Any:
        """run with an engine whose changes are seen by others at once when it returns, and not at all if it raises."""
        from .sources.store import Store

        if not isinstance(self.source, Store):
            raise QueryError("transactions need a store")
        inner = Engine.__new__(Engine)
        inner.__dict__.update(self.__dict__)
        inner.source = self.source.begin()
        inner.shortcuts = Shortcuts(inner)
        try:
            out = run(inner)
        except BaseException:
            inner.source.rollback()
            raise
        inner.source.commit()
        return out


def _numbered(sql: str) -> str:
    """$1 outside of quotes as a named marker."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|\$(\d+)", lambda m: f":_{m[1]}" if m[1] else m[0], sql)


def entities_of(values: Iterable[Any]) -> list[Any]:
    return [v for v in values if isinstance(v, (Table, Relations, Enum, Sequence))]
