"""The operations that lead from one snapshot to another."""

from __future__ import annotations

import logging
from graphlib import CycleError, TopologicalSorter

from . import ddl
from .ddl import MigrationError

log = logging.getLogger("sparkrel")


def by_dependency(tables: dict[str, dict]) -> list[str]:
    """Tables in an order in which each comes after those it refers to, as far as there is one."""
    graph = {n: sorted({f["table"] for f in t["foreign_keys"].values() if f["table"] in tables and f["table"] != n}) for n, t in sorted(tables.items())}
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError:
        log.warning("tables refer to each other in a circle")
        return sorted(tables)


def diff(old: dict, new: dict, *, tables: dict[str, str] | None = None, columns: dict[tuple[str, str], str] | None = None) -> list[dict]:
    """tables: old name -> new name of renamed tables; columns: (new table, old name) -> new name."""
    ops: list[dict] = [ddl.create_schema(s) for s in new["schemas"] if s not in old["schemas"]]
    renames = [ddl.rename_table(a, b) for a, b in (tables or {}).items()]
    ops += renames
    old = ddl.replay(old, renames)
    dropped = [n for n in reversed(by_dependency(old["tables"])) if n not in new["tables"]]
    ops += [ddl.drop_table(n) for n in dropped]
    for n, e in new["enums"].items():
        if n not in old["enums"]:
            ops.append(ddl.create_enum(n, e["values"], e["schema"]))
        else:
            ops += _enum(n, old["enums"][n]["values"], e["values"])
    for n, s in new["sequences"].items():
        if n in old["sequences"] and old["sequences"][n] != s:
            ops.append(ddl.drop_sequence(n))
        if old["sequences"].get(n) != s:
            ops.append(ddl.create_sequence(n, **s))
    late: list[dict] = []
    made: set[str] = set()
    for n in by_dependency(new["tables"]):
        if n in old["tables"]:
            ops += _table(n, old["tables"][n], new["tables"][n], {a: b for (t, a), b in (columns or {}).items() if t == n})
        else:
            t = new["tables"][n]
            circular = {k: f for k, f in t["foreign_keys"].items() if f["table"] != n and f["table"] not in made and f["table"] not in old["tables"]}
            ops.append(ddl.create_table(n, {**t, "foreign_keys": {k: f for k, f in t["foreign_keys"].items() if k not in circular}}))
            for k, f in circular.items():
                late += ddl.alter_table(n).add_foreign_key(k, f["columns"], f["table"], f["target"], f["on_delete"])
        made.add(n)
    ops += late
    ops += [ddl.drop_sequence(n) for n in old["sequences"] if n not in new["sequences"]]
    ops += [ddl.drop_enum(n) for n in old["enums"] if n not in new["enums"]]
    return ops + [ddl.drop_schema(s) for s in old["schemas"] if s not in new["schemas"]]


def _enum(name: str, old: list[str], new: list[str]) -> list[dict]:
    if [v for v in new if v in old] != old:
        raise MigrationError(f"values of enum {name} can't be removed or reordered")
    out = []
    for i, v in enumerate(new):
        if v not in old:
            out.append(ddl.alter_enum(name, add=v, after=new[i - 1]) if i else ddl.alter_enum(name, add=v, before=next((x for x in new if x in old), None)))
    return out


def _table(name: str, old: dict, new: dict, renamed: dict[str, str]) -> list[dict]:
    a = ddl.alter_table(name)
    for x, y in renamed.items():
        a.rename_column(x, y)
    old = ddl.replay({"schemas": [], "enums": {}, "sequences": {}, "tables": {name: old}}, list(a))["tables"][name]
    changed = lambda kind: [k for k, v in old[kind].items() if new[kind].get(k) != v]
    for i in changed("indexes"):
        a.ops.append(ddl.drop_index(name, i))
    for kind in ("foreign_keys", "checks", "uniques"):
        for c in changed(kind):
            a.drop_constraint(c)
    for c in old["columns"]:
        if c not in new["columns"]:
            a.drop_column(c)
    for c, d in new["columns"].items():
        if c not in old["columns"]:
            a.add_column(c, d)
            continue
        was = old["columns"][c]
        if (was["type"], was["spark"]) != (d["type"], d["spark"]):
            a.alter_column_type(c, d["type"], d["spark"])
        if was["default"] != d["default"]:
            a.drop_default(c) if d["default"] is None else a.set_default(c, d["default"])
        if was["nullable"] != d["nullable"]:
            a.drop_not_null(c) if d["nullable"] else a.set_not_null(c)
        if was["unique"] != d["unique"]:
            a.add_unique(c) if d["unique"] else a.drop_unique(c)
    if old["primary_key"] != new["primary_key"]:
        a.add_primary_key_constraint(new["primary_key"])
    for kind in ("uniques", "checks", "foreign_keys"):
        for k, v in new[kind].items():
            if old[kind].get(k) != v:
                a._add("add_constraint", kind=kind, name=k, value=v)
    for k, v in new["indexes"].items():
        if old["indexes"].get(k) != v:
            a.ops.append(ddl.create_index(name, v["columns"], name=k, method=v["method"], unique=v["unique"], opclasses=tuple(v["opclasses"])))
    return list(a)
