"""Operations on schemas: plain dicts, made by builders, replayed on snapshots and carried out on stores."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Col, Table
from ..sources.store import Store
from . import snapshot as snap


class MigrationError(RuntimeError):
    """A migration that can't be made or carried out."""


def _op(op: str, **values: Any) -> dict:
    return {"op": op, **values}


def create_schema(name: str) -> dict:
    return _op("create_schema", name=name)


def drop_schema(name: str) -> dict:
    return _op("drop_schema", name=name)


def create_enum(name: str, values: list[str], schema: str = "public") -> dict:
    return _op("create_enum", name=name, values=list(values), schema=schema)


def drop_enum(name: str) -> dict:
    return _op("drop_enum", name=name)


def alter_enum(name: str, *, add: str | None = None, before: str | None = None, after: str | None = None, rename: tuple[str, str] | None = None) -> dict:
    """Adds a value (before or after another, else at the end) or renames one."""
    if (add is None) == (rename is None) or before and after:
        raise MigrationError("an enum is altered by one value at a time")
    return _op("alter_enum", name=name, add=add, before=before, after=after, rename=list(rename) if rename else None)


def create_sequence(name: str, **options: Any) -> dict:
    return _op("create_sequence", name=name, options=options)


def drop_sequence(name: str) -> dict:
    return _op("drop_sequence", name=name)


def create_table(table: Table | str, definition: dict | None = None) -> dict:
    return _op("create_table", name=table if isinstance(table, str) else table.table_name, table=definition if definition is not None else snap.table(table))


def drop_table(name: str) -> dict:
    return _op("drop_table", name=name)


def rename_table(name: str, to: str) -> dict:
    return _op("rename_table", name=name, to=to)


def create_index(table: str, columns: list[str], *, name: str | None = None, method: str = "btree", unique: bool = False, opclasses: tuple = (), concurrently: bool = False) -> dict:
    return _op("create_index", table=table, name=name or f"{table}_{'_'.join(columns)}_index", index={"columns": list(columns), "method": method, "unique": unique, "opclasses": list(opclasses)}, concurrently=concurrently)


def drop_index(table: str, name: str) -> dict:
    return _op("drop_index", table=table, name=name)


def custom(up: str, down: str | None = None) -> dict:
    """A statement of Spark SQL."""
    return _op("custom", sql=up, down=down)


class AlterTable:
    """Changes of a table, one after the other; list(...) gives the operations."""

    def __init__(self, name: str):
        self.name, self.ops = name, []

    def __iter__(self):
        return iter(self.ops)

    def _add(self, op: str, **values: Any) -> AlterTable:
        self.ops.append(_op(op, table=self.name, **values))
        return self

    def add_column(self, name: str, column: Col | dict) -> AlterTable:
        return self._add("add_column", name=name, column=column if isinstance(column, dict) else snap.column(column))

    def drop_column(self, name: str) -> AlterTable:
        return self._add("drop_column", name=name)

    def rename_column(self, name: str, to: str) -> AlterTable:
        return self._add("rename_column", name=name, to=to)

    def alter_column_type(self, name: str, type: str, spark: str) -> AlterTable:
        return self._add("alter_type", name=name, type=type, spark=spark)

    def set_not_null(self, name: str) -> AlterTable:
        return self._add("set_not_null", name=name)

    def drop_not_null(self, name: str) -> AlterTable:
        return self._add("drop_not_null", name=name)

    def set_default(self, name: str, value: Any) -> AlterTable:
        return self._add("set_default", name=name, default=value if isinstance(value, dict) else {"value": value})

    def drop_default(self, name: str) -> AlterTable:
        return self._add("drop_default", name=name)

    def add_unique(self, column: str) -> AlterTable:
        return self._add("add_unique", column=column)

    def drop_unique(self, column: str) -> AlterTable:
        return self._add("drop_unique", column=column)

    def add_unique_constraint(self, name: str, columns: list[str]) -> AlterTable:
        return self._add("add_constraint", kind="uniques", name=name, value=list(columns))

    def add_primary_key_constraint(self, columns: list[str]) -> AlterTable:
        return self._add("set_primary_key", columns=list(columns))

    def add_check(self, name: str, expression: str, sql: str | None = None) -> AlterTable:
        """sql: the condition in Spark SQL, if rows that exist are to be checked."""
        return self._add("add_constraint", kind="checks", name=name, value=expression, sql=sql)

    def add_foreign_key(self, name: str, columns: list[str], table: str, target: list[str], on_delete: str = "CASCADE") -> AlterTable:
        return self._add("add_constraint", kind="foreign_keys", name=name, value={"columns": list(columns), "table": table, "target": list(target), "on_delete": on_delete})

    def drop_foreign_key(self, name: str) -> AlterTable:
        return self.drop_constraint(name)

    def drop_constraint(self, name: str) -> AlterTable:
        return self._add("drop_constraint", name=name)


def alter_table(name: str) -> AlterTable:
    return AlterTable(name)


KINDS = ("uniques", "checks", "foreign_keys")


def replay(state: dict, ops: list[dict]) -> dict:
    """The snapshot after some operations."""
    s = copy.deepcopy(state)
    for o in ops:
        kind = o["op"]
        t = s["tables"].get(o.get("table")) if isinstance(o.get("table"), str) else None
        if isinstance(o.get("table"), str) and t is None:
            raise MigrationError(f"no table {o['table']}")
        if kind == "create_schema":
            s["schemas"] = sorted({*s["schemas"], o["name"]})
        elif kind == "drop_schema":
            s["schemas"].remove(o["name"])
        elif kind == "create_enum":
            s["enums"][o["name"]] = {"schema": o["schema"], "values": list(o["values"])}
        elif kind == "drop_enum":
            del s["enums"][o["name"]]
        elif kind == "alter_enum":
            values = s["enums"][o["name"]]["values"]
            if o["rename"]:
                values[values.index(o["rename"][0])] = o["rename"][1]
            else:
                values.insert(values.index(o["before"]) if o["before"] else values.index(o["after"]) + 1 if o["after"] else len(values), o["add"])
        elif kind == "create_sequence":
            s["sequences"][o["name"]] = {"schema": "public", "start": 1, "increment": 1, "minimum": None, "maximum": None, "cycle": False, "cache": 1, **o["options"]}
        elif kind == "drop_sequence":
            del s["sequences"][o["name"]]
        elif kind == "create_table":
            if o["name"] in s["tables"]:
                raise MigrationError(f"table {o['name']} exists")
            s["tables"][o["name"]] = copy.deepcopy(o["table"])
        elif kind == "drop_table":
            if o["name"] not in s["tables"]:
                raise MigrationError(f"no table {o['name']}")
            del s["tables"][o["name"]]
        elif kind == "rename_table":
            s["tables"] = {o["to"] if n == o["name"] else n: v for n, v in s["tables"].items()}
            for v in s["tables"].values():
                for f in v["foreign_keys"].values():
                    f["table"] = o["to"] if f["table"] == o["name"] else f["table"]
        elif kind == "create_index":
            t["indexes"][o["name"]] = o["index"]
        elif kind == "drop_index":
            del t["indexes"][o["name"]]
        elif kind == "add_column":
            t["columns"][o["name"]] = copy.deepcopy(o["column"])
        elif kind == "drop_column":
            del t["columns"][o["name"]]
        elif kind == "rename_column":
            swap = lambda c, o=o: [o["to"] if x == o["name"] else x for x in c]
            t["columns"] = {o["to"] if n == o["name"] else n: v for n, v in t["columns"].items()}
            t["primary_key"] = swap(t["primary_key"])
            t["uniques"] = {n: swap(c) for n, c in t["uniques"].items()}
            for f in t["foreign_keys"].values():
                f["columns"] = swap(f["columns"])
            for i in t["indexes"].values():
                i["columns"] = swap(i["columns"])
            for v in s["tables"].values():
                for f in v["foreign_keys"].values():
                    f["target"] = swap(f["target"]) if f["table"] == o["table"] else f["target"]
        elif kind == "alter_type":
            t["columns"][o["name"]] |= {"type": o["type"], "spark": o["spark"]}
        elif kind in ("set_not_null", "drop_not_null"):
            t["columns"][o["name"]]["nullable"] = kind == "drop_not_null"
        elif kind in ("set_default", "drop_default"):
            t["columns"][o["name"]]["default"] = o.get("default")
        elif kind in ("add_unique", "drop_unique"):
            t["columns"][o["column"]]["unique"] = kind == "add_unique"
        elif kind == "set_primary_key":
            t["primary_key"] = list(o["columns"])
        elif kind == "add_constraint":
            t[o["kind"]][o["name"]] = copy.deepcopy(o["value"])
        elif kind == "drop_constraint":
            if not any(t[k].pop(o["name"], None) is not None for k in KINDS):
                raise MigrationError(f"no constraint {o['name']}")
        elif kind != "custom":
            raise MigrationError(f"no operation {kind}")
    return s


def carry_out(store: Store, state: dict, ops: list[dict]) -> dict:
    """Does the operations on a store's rows; gives the snapshot after them."""
    spark = store.spark
    for o in ops:
        after = replay(state, [o])
        kind = o["op"]
        name = o.get("table") if isinstance(o.get("table"), str) else o.get("name")
        struct = lambda n, s: T._parse_datatype_string("struct<" + ",".join(f"`{c}`:{d['spark']}" for c, d in s["tables"][n]["columns"].items()) + ">")
        rows = lambda n, s=state: store.rows(n) if store.places(n) else spark.createDataFrame([], struct(n, s))
        if kind == "create_table":
            store.apply({name: store.stage(name, spark.createDataFrame([], struct(name, after)))})
        elif kind == "drop_table":
            store.apply({name: None})
        elif kind == "rename_table":
            store.apply({name: None, o["to"]: store.manifest()["tables"].get(name)})
        elif kind == "add_column":
            d = o["column"]["default"]
            value = F.lit((d or {}).get("value")).cast(o["column"]["spark"])
            df = rows(name)
            if not o["column"]["nullable"] and (d or {}).get("value") is None and not df.isEmpty():
                raise MigrationError(f"{name}.{o['name']} is not null and has no default, but there are rows")
            store.apply({name: store.stage(name, df.withColumn(o["name"], value))})
        elif kind == "drop_column":
            store.apply({name: store.stage(name, rows(name).drop(o["name"]))})
        elif kind == "rename_column":
            store.apply({name: store.stage(name, rows(name).withColumnRenamed(o["name"], o["to"]))})
        elif kind == "alter_type":
            store.apply({name: store.stage(name, rows(name).withColumn(o["name"], F.col(f"`{o['name']}`").cast(o["spark"])))})
        elif kind == "alter_enum" and o["rename"]:
            for n, t in state["tables"].items():
                for c, d in t["columns"].items():
                    if d["type"] == f"enum {o['name']}":
                        store.apply({n: store.stage(n, rows(n).withColumn(c, F.when(F.col(f"`{c}`") == o["rename"][0], F.lit(o["rename"][1])).otherwise(F.col(f"`{c}`"))))})
        elif kind == "set_not_null":
            if not rows(name).filter(F.col(f"`{o['name']}`").isNull()).isEmpty():
                raise MigrationError(f"{name}.{o['name']} has nulls")
        elif kind in ("add_unique", "set_primary_key") or kind == "add_constraint" and o["kind"] == "uniques" or kind == "create_index" and o["index"]["unique"]:
            columns = [o["column"]] if kind == "add_unique" else o["columns"] if kind == "set_primary_key" else o["value"] if kind == "add_constraint" else o["index"]["columns"]
            if columns and not rows(name).na.drop(subset=columns).groupBy(*columns).count().filter("count > 1").isEmpty():
                raise MigrationError(f"{name} repeats {', '.join(columns)}")
        elif kind == "add_constraint" and o["kind"] == "foreign_keys":
            f = o["value"]
            own = rows(name).select(*(F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(f["columns"]))).na.drop().distinct()
            target = rows(f["table"]).select(*(F.col(f"`{c}`").alias(f"__t{i}") for i, c in enumerate(f["target"])))
            if not own.join(target, [F.col(f"__o{i}") == F.col(f"__t{i}") for i in range(len(f["columns"]))], "left_anti").isEmpty():
                raise MigrationError(f"rows of {name} refer to no row of {f['table']}")
        elif kind == "add_constraint" and o.get("sql"):
            if not rows(name).filter(~F.expr(o["sql"])).isEmpty():
                raise MigrationError(f"rows of {name} break {o['name']}")
        elif kind == "custom":
            for n in state["tables"]:
                rows(n).createOrReplaceTempView(n)
            spark.sql(o["sql"])
        state = after
    store.apply({}, state=state)
    return state
