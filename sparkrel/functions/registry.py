"""Own functions: built from Spark columns, used like the others."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column as SparkColumn

from ..expr import Aggregate, Expr, QueryError

_known: dict[str, tuple[Callable[..., SparkColumn], str, bool]] = {}


def register_fn(name: str, build: Callable[..., SparkColumn], *, kind: str = "any", aggregate: bool = False) -> Callable[..., Expr]:
    """Adds a function under a name; build gets Spark columns and returns one."""
    _known[name] = (build, kind, aggregate)
    return lambda *args: call(name, *args)


def call(name: str, *args: Any) -> Expr:
    """A registered function applied to expressions or values."""
    if name not in _known:
        raise QueryError(f"no function {name} is registered")
    build, kind, aggregate = _known[name]
    return (Aggregate if aggregate else Expr)(f"fn:{name}", args, build, kind=kind)
