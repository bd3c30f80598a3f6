"""Command line: init, generate, migrate, push, status, down, squash, shell.

``sparkrel.json`` in the working folder says where the schema module, the
migrations and the store are.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..engine import Engine
from ..sources.store import Store
from .runner import Migrations

CONFIG = "sparkrel.json"
SCHEMA = '''"""Tables of this project."""

from sparkrel import Table, pk, types

users = Table("users", {"id": pk(), "name": types.varchar(100)})
'''


def _place(path: str) -> str:
    """A path without a scheme is relative to the working folder (the JVM may have another)."""
    return path if "://" in path else Path(path).resolve().as_uri()


def _ask(what: str, candidates: list[str]) -> str | None:
    print(f"{what} is new. Renamed from one of these? (empty: no)", ", ".join(candidates))
    got = input("> ").strip()
    return got if got in candidates else None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkrel")
    sub = p.add_subparsers(dest="command", required=True)
    for c in ("init", "generate", "migrate", "push", "status", "shell"):
        sub.add_parser(c)
    sub.add_parser("down").add_argument("migration")
    s = sub.add_parser("squash")
    s.add_argument("first")
    s.add_argument("last")
    s.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    if a.command == "init":
        if Path(CONFIG).exists():
            print(f"{CONFIG} exists")
            return 1
        Path(CONFIG).write_text(json.dumps({"schema": "schema", "migrations": "migrations", "store": "store"}, indent=2))
        if not Path("schema.py").exists():
            Path("schema.py").write_text(SCHEMA)
        Path("migrations").mkdir(exist_ok=True)
        return 0
    config = json.loads(Path(CONFIG).read_text())
    sys.path.insert(0, ".")
    entities = importlib.import_module(config["schema"])
    if a.command == "generate":
        print(Migrations(config["migrations"]).generate(entities, ask=_ask if sys.stdin.isatty() else None) or "nothing to do")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    m = Migrations(config["migrations"], Store(spark, _place(config["store"])))
    if a.command == "migrate":
        print("\n".join(m.migrate()) or "nothing to do")
    elif a.command == "push":
        print("\n".join(m.push(entities)) or "nothing to do")
    elif a.command == "status":
        for n, done in m.status():
            print("applied" if done else "pending", n)
    elif a.command == "down":
        print("\n".join(m.down(a.migration)))
    elif a.command == "squash":
        print(m.squash(a.first, a.last, force=a.force))
    else:
        shell(Engine(spark, m.store, entities))
    return 0


HELP = r"""\dt tables, \d NAME a table's columns, \dn schemas, \du users, \clear, \? this, \q ends; anything else is Spark SQL"""


def shell(db: Engine, lines=None, out=print) -> None:
    """SQL over the engine's tables, line by line."""
    lines = iter(sys.stdin) if lines is None else iter(lines)
    for line in lines:
        line = line.strip().rstrip(";")
        if line == r"\q":
            return
        if line in ("", r"\clear"):
            out("\033[2J\033[H" if line else "")
        elif line == r"\?":
            out(HELP)
        elif line == r"\dt":
            out("\n".join(sorted(f"{t.schema}.{t.table_name}" for t in db.tables.values())))
        elif line == r"\dn":
            out("\n".join(sorted({t.schema for t in db.tables.values()})))
        elif line == r"\du":
            out(db.spark.sparkContext.sparkUser())
        elif line.startswith(r"\d ") and line[3:] in db.tables:
            out(db.frame(db.tables[line[3:]])._jdf.schema().treeString())
        else:
            try:
                out(db.raw(line)._jdf.showString(50, 40, False))
            except Exception as e:
                out(f"error: {str(e).splitlines()[0]}")


if __name__ == "__main__":
    sys.exit(main())
