"""A schema as plain data."""

from __future__ import annotations

from typing import Any

from ..expr import Expr
from ..schema import Check, Col, Enum, Index, Sequence, Table

EMPTY: dict = {"schemas": ["public"], "enums": {}, "sequences": {}, "tables": {}}


def column(c: Col) -> dict:
    value = c.default_value
    return {
        "type": c.type.name,
        "spark": c.type.spark.simpleString(),
        "nullable": c.nullable,
        "unique": c.is_unique,
        "primary": c.is_primary,
        "default": None if not c.has_default else {"expr": repr(value.key)} if isinstance(value, Expr) else {"value": value if isinstance(value, (int, float, str, bool, list, dict, type(None))) else str(value)},
        "generated": c.generated,
    }


def table(t: Table) -> dict:
    return {
        "schema": t.schema,
        "columns": {n: column(c) for n, c in t.columns.items()},
        "primary_key": list(t.key_columns) if len(t.key_columns) > 1 else [],
        "uniques": {getattr(e, "name", None) or f"{t.table_name}_{'_'.join(e.columns)}_key": list(e.columns) for e in t.extra if type(e).__name__ == "Unique"},
        "checks": {n: repr(e.key) for n, e in t.checks()},
        "foreign_keys": {f"{t.table_name}_{'_'.join(own)}_fk": {"columns": list(own), "table": target[0].table, "target": [c.name for c in target], "on_delete": action} for own, target, action in t.foreign_keys()},
        "indexes": {e.named(t.table_name): {"columns": list(e.columns), "method": e.method, "unique": e.is_unique, "opclasses": list(e.opclasses)} for e in t.extra if isinstance(e, Index)},
    }


def snapshot(entities: Any) -> dict:
    """Schemas, enums, sequences and tables of some entities."""
    values = list(entities.values() if isinstance(entities, dict) else entities if isinstance(entities, (list, tuple)) else vars(entities).values())
    tables = {v.table_name: v for v in values if isinstance(v, Table)}
    enums = [v for v in values if isinstance(v, Enum)]
    sequences = [v for v in values if isinstance(v, Sequence)]
    schemas = sorted({"public", *(v.schema for v in (*tables.values(), *enums, *sequences))})
    return {
        "schemas": schemas,
        "enums": {e.name: {"schema": e.schema, "values": list(e.values)} for e in enums},
        "sequences": {s.name: {"schema": s.schema, "start": s.start, "increment": s.increment, "minimum": s.minimum, "maximum": s.maximum, "cycle": s.cycle, "cache": s.cache} for s in sequences},
        "tables": {n: table(t) for n, t in tables.items()},
    }


__all__ = ["Check", "EMPTY", "column", "snapshot", "table"]
