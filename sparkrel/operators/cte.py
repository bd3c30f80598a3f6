"""Named queries (WITH)."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from ..schema import Named

if TYPE_CHECKING:
    from ..engine import Engine


class Cte(Named):
    """A query under a name, whose columns other queries use like a table's."""

    def __init__(self, name: str, query: Any):
        super().__init__(name, query.columns())
        self.query = query

    def frame(self, args: dict[str, Any]) -> DataFrame:
        return self.query.frame(args)


class With:
    """Starts of queries that use named ones."""

    def __init__(self, engine: Engine, ctes: tuple[Cte, ...]):
        self.engine, self.ctes = engine, {c.table_name: c for c in ctes}
        for c in ctes:  # data changes take place once, before the query that reads what they return
            if hasattr(c.query, "execute"):
                c.query.execute()

    def from_(self, what):
        return self.engine.from_(what(_Names(self.ctes)) if callable(what) and not isinstance(what, Named) else what)

    def insert(self, table):
        return self.engine.insert(table)

    def update(self, table):
        return self.engine.update(table)

    def delete(self, table):
        return self.engine.delete(table)


class _Names:
    def __init__(self, ctes: dict[str, Cte]):
        self.__dict__.update(ctes)
