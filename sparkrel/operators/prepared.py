"""Prepared queries: built once with named arguments, run with values."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from ..expr import Arg, QueryError

if TYPE_CHECKING:
    from ..engine import Engine


class Prepared:
    """build(engine, args) is called for the engine that runs it; values bind by name, however often and in whatever order arguments are used."""

    def __init__(self, args: dict[str, Any], build: Callable[[Engine, Any], Any]):
        self.args = {n: a if isinstance(a, Arg) else Arg(n, a) for n, a in args.items()}
        for n, a in self.args.items():
            a.name, a.params = n, (n,)
        self.build = build

    def query(self, engine: Engine) -> Any:
        return self.build(engine, type("Args", (), self.args))

    def run(self, engine: Engine, **values: Any) -> Any:
        if unknown := set(values) - set(self.args):
            raise QueryError(f"no argument {sorted(unknown)[0]}")
        if missing := set(self.args) - set(values):
            raise QueryError(f"no value for argument {sorted(missing)[0]}")
        query = self.query(engine)
        return query.execute(values) if hasattr(query, "execute") else query.frame(values)


def prepare(args: dict[str, Any], build: Callable[[Engine, Any], Any]) -> Prepared:
    """args: name -> Arg or column type."""
    return Prepared(args, build)
