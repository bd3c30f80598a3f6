"""The history of a store's schema: migrations as JSON files, applied in order and reverted in reverse."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from ..sources.store import Store
from . import ddl
from .ddl import MigrationError
from .diff import diff
from .snapshot import EMPTY, snapshot


class Migrations:
    """folder: where the files are; store: whose rows they change (needed to apply them)."""

    def __init__(self, folder: str | Path, store: Store | None = None):
        self.folder, self.store = Path(folder), store

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json")) if self.folder.exists() else []

    def read(self, name: str) -> dict:
        return json.loads((self.folder / f"{name}.json").read_text())

    def write(self, name: str, up: list[dict], down: list[dict]) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / f"{name}.json").write_text(json.dumps({"name": name, "up": up, "down": down}, indent=2))

    def state(self, upto: str | None = None) -> dict:
        """The snapshot after all migrations, or after those up to one."""
        s = EMPTY
        for n in self.names():
            if upto is None or n <= upto:
                s = ddl.replay(s, self.read(n)["up"])
        return s

    def generate(self, entities: Any, name: str | None = None, *, tables: dict | None = None, columns: dict | None = None, ask: Callable[[str, list[str]], str | None] | None = None) -> str | None:
        """Writes the migration from the history's state to the declared schema; None if they agree.

        ask(what, candidates) may name the old table or column that a new one was renamed from.
        """
        old, new = self.state(), snapshot(entities)
        tables, columns = dict(tables or {}), dict(columns or {})
        if ask is not None:
            for n in new["tables"]:
                if n not in old["tables"] and n not in tables.values():
                    gone = [t for t in old["tables"] if t not in new["tables"] and t not in tables]
                    if gone and (was := ask(f"table {n}", gone)):
                        tables[was] = n
            back = {b: a for a, b in tables.items()}
            for n, t in new["tables"].items():
                before = old["tables"].get(back.get(n, n))
                for c in t["columns"] if before else ():
                    gone = [x for x in before["columns"] if x not in t["columns"] and (n, x) not in columns]
                    if c not in before["columns"] and c not in columns.values() and gone and (was := ask(f"column {n}.{c}", gone)):
                        columns[n, was] = c
        up = diff(old, new, tables=tables, columns=columns)
        if not up:
            return None
        names = {b: a for a, b in tables.items()}
        down = self._down(ddl.replay(old, up), old, up, names, columns)
        stamp = name or datetime.now(UTC).strftime("%Y%m%d%H%M%S%f")
        self.write(stamp, up, down)
        return stamp

    @staticmethod
    def _down(new: dict, old: dict, up: list[dict], tables: dict, columns: dict) -> list[dict]:
        added = {(o["name"], o["add"]) for o in up if o["op"] == "alter_enum" and o["add"]}
        if added:  # values can't be removed: the way back keeps them
            old = json.loads(json.dumps(old))
            for n, _ in added:
                if n in old["enums"]:
                    old["enums"][n]["values"] = new["enums"][n]["values"]
        return diff(new, old, tables=tables, columns={(tables.get(t, t), b): a for (t, a), b in columns.items()})

    # the store

    def applied(self) -> list[dict]:
        return self.store.manifest()["migrations"]

    def status(self) -> list[tuple[str, bool]]:
        done = {m["name"] for m in self.applied()}
        return [(n, n in done) for n in self.names()]

    def _in_transaction(self, run: Callable[[Store], None]) -> None:
        inner = self.store.begin()
        try:
            run(inner)
        except BaseException:
            inner.rollback()
            raise
        inner.commit()

    def migrate(self) -> list[str]:
        """Applies what isn't applied, in order; if one fails, none of this run's stays."""
        todo = [n for n, done in self.status() if not done]

        def run(s: Store) -> None:
            state = s.manifest().get("state", EMPTY)
            for n in todo:
                state = ddl.carry_out(s, state, self.read(n)["up"])
                seen = s.manifest()["migrations"]
                s.apply({}, migrations=[*seen, {"id": len(seen) + 1, "name": n, "created_at": datetime.now(UTC).isoformat()}])

        if todo:
            self._in_transaction(run)
        return todo

    def push(self, entities: Any, **options: Any) -> list[str]:
        """generate, then migrate."""
        self.generate(entities, **options)
        return self.migrate()

    def down(self, target: str) -> list[str]:
        """Reverts the newest migrations back to target, that one included."""
        done = [m["name"] for m in self.applied()]
        if target not in done:
            raise MigrationError(f"{target} is not applied")
        todo = sorted((n for n in done if n >= target), reverse=True)

        def run(s: Store) -> None:
            state = s.manifest().get("state", EMPTY)
            for n in todo:
                state = ddl.carry_out(s, state, self.read(n)["down"])
                s.apply({}, migrations=[m for m in s.manifest()["migrations"] if m["name"] != n])

        self._in_transaction(run)
        return todo

    def squash(self, first: str, last: str, *, force: bool = False) -> str:
        """Makes one migration, under the last one's name, of a range of them."""
        names = [n for n in self.names() if first <= n <= last]
        if first not in names or last not in names:
            raise MigrationError("no such range of migrations")
        done = {m["name"] for m in self.applied()} if self.store is not None else set()
        if len({n in done for n in names}) > 1:
            raise MigrationError("some of these migrations are applied and others aren't")
        if not force and any(o["op"] == "custom" for n in names for o in self.read(n)["up"]):
            raise MigrationError("statements of one's own are lost when migrations are squashed; force it to do so")
        earlier = [n for n in self.names() if n < first]
        old = self.state(earlier[-1]) if earlier else EMPTY
        new = self.state(last)
        up = diff(old, new)
        self.write(last, up, self._down(new, old, up, {}, {}))
        for n in names[:-1]:
            (self.folder / f"{n}.json").unlink()
        if self.store is not None and last in done:
            self.store.apply({}, migrations=[m for m in self.applied() if m["name"] not in names[:-1]])
        return last


def valid_name(name: str) -> bool:
    return re.fullmatch("[A-Za-z0-9_-]+", name) is not None
