"""Validators of rows, derived from tables."""

from __future__ import annotations

from typing import Any

from .expr import Expr
from .schema import Table


class Validator:
    """Checks a dict for an insert or an update; parse() raises, check() lists what is wrong by column."""

    def __init__(self, table: Table, update: bool):
        self.table, self.update = table, update

    def required(self) -> list[str]:
        """Columns that a row must have."""
        if self.update:
            return []
        return [n for n, c in self.table.columns.items() if not c.nullable and not c.has_default and not c.numbered and c.insert_fn is None and c.generated != "always"]

    def allowed(self) -> list[str]:
        """Columns that a row may have: no generated ones, and no keys in an update."""
        return [n for n, c in self.table.columns.items() if c.generated != "always" and not (self.update and n in self.table.key_columns)]

    def check(self, row: Any) -> dict[str, str]:
        if not isinstance(row, dict):
            return {"": "not a mapping"}
        allowed = self.allowed()
        out = {n: "is missing" for n in self.required() if n not in row}
        for n, v in row.items():
            if n not in allowed:
                out[n] = "is not a column that may be set"
            elif isinstance(v, Expr):
                continue
            elif v is None:
                if not self.table.columns[n].nullable:
                    out[n] = "is null"
            elif why := self.table.columns[n].type.accepts(v):
                out[n] = why
        return out

    def parse(self, row: dict) -> dict:
        if wrong := self.check(row):
            raise ValueError("; ".join(f"{n} {w}" for n, w in wrong.items()))
        return dict(row)


def insert_validator(table: Table) -> Validator:
    return Validator(table, False)


def update_validator(table: Table) -> Validator:
    return Validator(table, True)
