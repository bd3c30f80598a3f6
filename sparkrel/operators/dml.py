"""Changes of a store's tables: plans from the old rows to the new ones.

Every statement reads the state before it. Its rows are written once, before
the manifest changes: what was written is checked, shown by RETURNING and then
named by the manifest. An insert adds a folder to its table and leaves the rest
alone; unique keys are looked for among the old rows by the new keys only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import ColumnRef, Expr, QueryError, Scope, as_expr, literal
from ..schema import Named, Sequence, Table
from ..sources.catalog import Jdbc
from ..sources.store import FOLDERS, Store
from .select import filtered

if TYPE_CHECKING:
    from ..engine import Engine


class ConstraintError(QueryError):
    """Rows that a constraint forbids."""


def _store(engine: Engine) -> Store:
    if not isinstance(engine.source, Store):
        raise QueryError("changes need a store")
    return engine.source


def _returned(table: Table, what: Any) -> list[str] | None:
    if what is None:
        return None
    if what == "*":
        return list(table.c)
    if unknown := [c for c in what if c not in table.c]:
        raise QueryError(f"{table.table_name} has no column {unknown[0]}")
    return [c for c in table.c if what.get(c)] if any(what.values()) else [c for c in table.c if c not in what]


class Change:
    """A statement that takes place once; frame() gives what it returns."""

    engine: Engine
    table: Table
    _result: DataFrame | None

    def columns(self) -> dict[str, Any]:
        names = _returned(self.table, self.returning_)
        if names is None:
            raise QueryError("the statement returns nothing")
        return {n: self.table.c[n].type for n in names}

    def frame(self, args: dict[str, Any] | None = None) -> DataFrame:
        return self.execute(args)

    def collect(self, **args: Any) -> list[dict]:
        df = self.execute(args)
        return [] if df is None else [r.asDict(True) for r in df.collect()]

    def execute(self, args: dict[str, Any] | None = None) -> DataFrame | None:
        if args or self.box.get("result") is None:
            self.box["result"] = (self.engine.logged(f"{type(self).__name__.lower()} {self.table.table_name}", args, lambda: self._run(Scope(args=args or {}))),)
        return self.box["result"][0]


def _persist(engine: Engine, name: str, df: DataFrame) -> DataFrame:
    """df, written to the store as files of its own, so that it is evaluated once."""
    return _written(engine, name, df)[0]


def _written(engine: Engine, name: str, df: DataFrame) -> tuple[DataFrame, str]:
    """df as written, and its place."""
    store = _store(engine)
    at = store.stage(name, df)
    return engine.spark.read.schema(df.schema).parquet(f"{store.path}/{at}"), at


def _divided(engine: Engine, table: Table, df: DataFrame) -> tuple[DataFrame, str]:
    """df with __hit, written once: the rows that are hit, and the place of the others."""
    store, schema = _store(engine), df.drop("__hit").schema
    hit, other = store.split(table.table_name, df, "__hit")
    empty = engine.spark.createDataFrame([], schema)
    gone = empty if hit is None else engine.spark.read.schema(schema).parquet(f"{store.path}/{hit}")
    return gone, other or store.stage(table.table_name, empty)


def _computed(table: Table, df: DataFrame) -> DataFrame:
    """df with its generated columns."""
    for n, c in table.columns.items():
        if c.generated == "always" and c.expression is not None:
            e = as_expr(c.expression(table) if callable(c.expression) else c.expression)
            df = df.withColumn(n, e.lower(Scope(done={r.key: k for k, r in table.c.items()})).cast(c.type.spark))
    return df


def _show(df: DataFrame, table: Table, what: Any) -> DataFrame | None:
    names = _returned(table, what)
    return None if names is None else df.select(*(F.col(f"`{n}`") for n in names))


def _value(v: Any, scope: Scope, table: Table, name: str):
    """A value for a column: an expression, an argument or a plain value."""
    t = table.columns[name].type
    if not isinstance(v, Expr) and not (t.category == "json" and not isinstance(v, str)) and (why := t.accepts(v)):
        raise ConstraintError(f"{table.table_name}.{name}: {why}")
    if t.name == "jsonb" and not isinstance(v, Expr):
        import json

        return F.parse_json(F.lit(v if isinstance(v, str) else json.dumps(v)))
    if isinstance(v, dict):
        return F.struct(*(F.lit(x).alias(k) for k, x in v.items())).cast(t.spark)
    return (as_expr(v).lower(scope) if isinstance(v, Expr) else literal(v)).cast(t.spark)


def _plain_rows(spark, table: Table, rows: list[dict], given: list[str]) -> DataFrame:
    """Rows of Python values as one local table: __n, the given columns, and __has_<column>."""
    import json
    from decimal import Decimal

    def value(n: str, v: Any) -> Any:
        t = table.columns[n].type
        if v is None:
            return None
        if t.name == "jsonb":
            return v if isinstance(v, str) else json.dumps(v)
        if why := t.accepts(v):
            raise ConstraintError(f"{table.table_name}.{n}: {why}")
        if isinstance(t.spark, T.DecimalType):
            return Decimal(str(v)).quantize(Decimal(1).scaleb(-t.spark.scale))
        if isinstance(t.spark, T.ArrayType) and isinstance(t.spark.elementType, T.FloatType):
            return [float(x) for x in v]
        return float(v) if isinstance(t.spark, T.DoubleType) else v

    fields = [T.StructField("__n", T.LongType())]
    for n in given:
        spark_type = table.columns[n].type.spark
        fields += [T.StructField(n, T.StringType() if isinstance(spark_type, T.VariantType) else spark_type), T.StructField(f"__has_{n}", T.BooleanType())]
    data = [(i, *(x for n in given for x in (value(n, r.get(n)), n in r))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, T.StructType(fields))
    for n in given:
        if isinstance(table.columns[n].type.spark, T.VariantType):
            df = df.withColumn(n, F.parse_json(F.col(f"`{n}`")))
    return df


@dataclass(frozen=True)
class Insert(Change):
    engine: Engine
    table: Table
    rows: Any = None
    target: tuple[str, ...] | None = None
    action: str | None = None
    set_: Callable[[Named], dict] | None = None
    where_: Callable[[Named], Expr] | None = None
    returning_: Any = None
    box: dict = field(default_factory=dict, hash=False, compare=False)

    def values(self, rows: dict | list[dict] | DataFrame) -> Insert:
        """A row, several, or a DataFrame with some of the table's columns."""
        return replace(self, rows=rows, box={})

    def on_conflict(self, *columns: ColumnRef | str) -> Insert:
        return replace(self, target=tuple(c if isinstance(c, str) else c.name for c in columns), box={})

    def do_nothing(self) -> Insert:
        return replace(self, action="nothing", target=self.target or (), box={})

    def do_update_set(self, values: Callable[[Named], dict] | dict, where: Callable[[Named], Expr] | None = None) -> Insert:
        """values and where get the excluded row (the one that would have been inserted) as a table."""
        if not self.target:
            raise QueryError("an update on conflict names its columns")
        return replace(self, action="update", set_=values if callable(values) else lambda _: values, where_=where, box={})

    def returning(self, what: Any = "*") -> Insert:
        return replace(self, returning_=what, box={})

    def _given(self, scope: Scope) -> tuple[DataFrame, dict[str, Column], set[str]]:
        """The rows with __n as their order, whether a row has a column, and the columns that some have."""
        t, spark = self.table, self.engine.spark
        if self.rows is None or self.rows == []:
            raise QueryError("no rows to insert")
        if isinstance(self.rows, DataFrame):
            given, df = set(self.rows.columns), self.rows.withColumn("__n", F.monotonically_increasing_id())
            has = {c: F.lit(True) for c in given}
        else:
            rows = [self.rows] if isinstance(self.rows, dict) else list(self.rows)
            given = {c for r in rows for c in r}
            plain = not any(isinstance(v, Expr) for r in rows for v in r.values())
            df = _plain_rows(spark, t, rows, [c for c in t.columns if c in given]) if plain else None
            for i, r in enumerate(() if plain else rows):
                one = spark.range(1).select(F.lit(i).cast("long").alias("__n"), *(x for c in given if c in t.columns for x in ((_value(r[c], scope, t, c) if c in r else F.lit(None).cast(t.columns[c].type.spark)).alias(c), F.lit(c in r).alias(f"__has_{c}"))))
                df = one if df is None else df.unionByName(one)
            has = {c: F.col(f"__has_{c}") for c in given}
        if unknown := given - set(t.columns):
            raise QueryError(f"{t.table_name} has no column {sorted(unknown)[0]}")
        if fixed := [c for c in given if t.columns[c].generated == "always"]:
            raise QueryError(f"{t.table_name}.{fixed[0]} is generated always")
        return df, has, given

    def _filled(self, n: str, has: dict[str, Column], given: set[str], scope: Scope) -> Column:
        """A column's value, or what takes its place in rows without one."""
        t, c, fill = self.table, self.table.columns[n], F.lit(None)
        if c.insert_fn is not None:
            fill = _value(c.insert_fn(), scope, t, n)
        elif c.has_default and not isinstance(c.default_value, Sequence):
            fill = _value(c.default_value, scope, t, n)
        value = F.when(has[n], F.col(f"`{n}`")).otherwise(fill) if n in given else fill
        return value.cast(c.type.spark).alias(n)

    def _incoming(self, scope: Scope) -> DataFrame:
        """The new rows, complete, with __n as their order."""
        t = self.table
        df, has, given = self._given(scope)
        out = [self._filled(n, has, given, scope) for n in t.columns]
        numbered = [n for n, c in t.columns.items() if c.numbered or isinstance(c.default_value, Sequence)]
        flags = [(~has[n] if n in given and t.columns[n].numbered else F.col(f"`{n}`").isNull() if n in given else F.lit(True)).alias(f"__new_{n}") for n in numbered]
        df = df.select("__n", *out, *flags)
        if numbered:
            df = _persist(self.engine, f"_incoming/{t.table_name}", df)
        for n in numbered:
            c, missing = t.columns[n], df.filter(F.col(f"__new_{n}")).count()
            if not missing:
                continue
            if isinstance(self.rows, DataFrame):
                df = _ranks(df, n)
            else:
                df = df.withColumn("__rank", F.row_number().over(Window.partitionBy(f"__new_{n}").orderBy("__n")))
            if c.numbered:
                number = F.col("__rank") + (_store(self.engine).take(f"{t.table_name}.{n}", missing) - 1)
            else:
                number = _sequence(c.default_value, F.col("__rank") - 1, *_store(self.engine).reserve(c.default_value, missing))
            df = df.withColumn(n, F.when(F.col(f"__new_{n}"), number.cast(c.type.spark)).otherwise(F.col(f"`{n}`"))).drop("__rank")
        return _computed(t, df).select("__n", *t.columns)

    def _run(self, scope: Scope) -> DataFrame | None:
        t = self.table
        if isinstance(self.engine.source, Jdbc):
            return self._sent(scope)
        store = _store(self.engine)
        seen = dict(store.manifest()["tables"])
        old = self.engine.frame(t)
        if self.action is None:
            shown, at = self._added(self._incoming(scope))
        else:
            shown, at = self._conflicts(old, _persist(self.engine, f"_rows/{t.table_name}", self._incoming(scope)), scope)
        if self.action != "update":  # the new rows only; the old ones stay where they are
            places = store.places(t.table_name)
            at = [*places, at] if len(places) < FOLDERS else store.stage(t.table_name, store.read(*places, at))
        replace_rows(self.engine, {t.table_name: at}, {t.table_name: shown}, seen)
        return _show(shown.orderBy("__n"), t, self.returning_)

    def _sent(self, scope: Scope) -> None:
        """New rows to a database: the given columns and those that are filled here."""
        t = self.table
        if self.action is not None or self.returning_ is not None:
            raise QueryError("an insert by JDBC has no conflict action and returns nothing")
        df, has, given = self._given(scope)
        own = [n for n, c in t.columns.items() if c.insert_fn is not None or c.has_default and not isinstance(c.default_value, Sequence)]
        if partial := [n for n in given if n not in own and not df.filter(~has[n]).isEmpty()]:
            raise QueryError(f"some rows have {t.table_name}.{partial[0]} and others don't")
        kept = [n for n in t.columns if n in given or n in own]
        self.engine.source.append(t, df.select(*(self._filled(n, has, given, scope) for n in kept)))

    def _added(self, new: DataFrame) -> tuple[DataFrame, str]:
        """New rows as a folder of the table, with the columns that are stored."""
        stored = _store(self.engine).rows(self.table.table_name)
        if stored is not None:
            new = new.select("__n", *((F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema))
        return _written(self.engine, self.table.table_name, new)

    def _conflicts(self, old: DataFrame, new: DataFrame, scope: Scope) -> tuple[DataFrame, str]:
        """The rows added or changed, and their place (with an update: that of all rows)."""
        t = self.table
        sets = [self.target] if self.target else t.unique_sets()
        if self.target and set(self.target) not in [set(u) for u in t.unique_sets()]:
            raise QueryError("the conflict's columns have no unique constraint")
        if self.action == "nothing":
            fresh = new
            for u in sets:
                known = old.select(*(F.col(f"`{c}`").alias(f"__u_{c}") for c in u))
                fresh = fresh.join(known, [F.col(f"`{c}`") == F.col(f"__u_{c}") for c in u], "left_anti")
            for u in sets:
                whole = F.lit(True)
                for c in u:
                    whole = whole & F.col(f"`{c}`").isNotNull()
                fresh = fresh.withColumn("__r", F.row_number().over(Window.partitionBy(*u).orderBy("__n"))).filter((F.col("__r") == 1) | ~whole).drop("__r")
            return self._added(fresh)
        key = list(self.target)
        whole = [F.col(f"`{c}`").isNotNull() for c in key]
        twice = new
        for w in whole:
            twice = twice.filter(w)
        if not twice.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ConstraintError("an update on conflict would change a row twice")
        left = old.select(F.struct(*t.columns).alias("o"))
        right = new.select(F.struct("__n", *t.columns).alias("e"))
        both = left.join(right, [F.col(f"o.`{c}`") == F.col(f"e.`{c}`") for c in key], "full")
        excluded = Named("excluded", {n: c.type for n, c in t.columns.items()})
        wide = both.select("o", "e", *(F.col(f"o.`{n}`").alias(f"__old_{n}") for n in t.columns), *(F.col(f"e.`{n}`").alias(f"__new_{n}") for n in t.columns))
        done = {t.c[n].key: f"__old_{n}" for n in t.columns} | {excluded.c[n].key: f"__new_{n}" for n in t.columns}
        inner = Scope(args=scope.args, done=done)
        hit = F.col("o").isNotNull() & F.col("e").isNotNull()
        change = hit if self.where_ is None else hit & F.coalesce(self.where_(excluded).lower(inner), F.lit(False))
        sets_ = {**{n: c.update_fn() for n, c in t.columns.items() if c.update_fn}, **self.set_(excluded)}
        cols = []
        for n in t.columns:
            updated = _value(sets_[n], inner, t, n) if n in sets_ else F.col(f"__old_{n}")
            cols.append(F.when(change, updated).when(F.col("o").isNotNull(), F.col(f"__old_{n}")).otherwise(F.col(f"__new_{n}")).alias(n))
        rows, at = _written(self.engine, t.table_name, wide.select(*cols, F.col("e.__n").alias("__n"), (change | F.col("o").isNull()).alias("__touched")))
        return rows.filter("__touched"), at


def _sequence(s: Sequence, k: Column, first: int, room: int, again: int) -> Column:
    """The number k places after first, of a sequence that starts over at again after room places."""
    if not s.cycle:
        return F.lit(first) + k * s.increment
    low, high = s.minimum if s.minimum is not None else 1, s.maximum if s.maximum is not None else -1
    length = F.lit(abs((high if s.increment > 0 else low) - again) // abs(s.increment) + 1)
    return F.when(k <= room, F.lit(first) + k * s.increment).otherwise(F.lit(again) + F.pmod(k - room - 1, length) * s.increment)


def _ranks(df: DataFrame, n: str) -> DataFrame:
    """df with __rank: 1, 2, ... over the rows whose n is new, in the order of __n, without one task for all rows."""
    parts = df.withColumn("__part", F.shiftright("__n", 33))
    counts = parts.groupBy("__part").agg(F.sum(F.col(f"__new_{n}").cast("long")).alias("__c"))
    before = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part", f"__new_{n}").orderBy("__n")) + F.col("__before")
    return parts.join(before, "__part").withColumn("__rank", rank).drop("__part", "__before")


@dataclass(frozen=True)
class Update(Change):
    engine: Engine
    table: Table
    values: dict | None = None
    condition: Expr | None = None
    returning_: Any = None
    box: dict = field(default_factory=dict, hash=False, compare=False)

    def set(self, values: dict[str, Any]) -> Update:
        return replace(self, values=values, box={})

    def where(self, condition: Expr | None) -> Update:
        return replace(self, condition=condition, box={})

    def returning(self, what: Any = "*") -> Update:
        return replace(self, returning_=what, box={})

    def _run(self, scope: Scope) -> DataFrame | None:
        t, seen = self.table, dict(_store(self.engine).manifest()["tables"])
        if not self.values:
            raise QueryError("nothing is set")
        for n in self.values:
            if n not in t.columns:
                raise QueryError(f"{t.table_name} has no column {n}")
            if t.columns[n].generated == "always":
                raise QueryError(f"{t.table_name}.{n} is generated always")
        sets = {**{n: c.update_fn() for n, c in t.columns.items() if c.update_fn}, **self.values}
        df = _marked(self.engine, t, self.condition, scope)
        hit = F.col("__hit")
        out = [F.when(hit, _value(sets[n], scope, t, n)).otherwise(F.col(f"`{t.table_name}`.`{n}`")).cast(c.type.spark).alias(n) if n in sets else F.col(f"`{t.table_name}`.`{n}`").alias(n) for n, c in t.columns.items()]
        rows, at = _written(self.engine, t.table_name, _computed(t, df.select(*out, F.col("__hit").alias("__touched"))))
        touched = rows.filter("__touched")
        replace_rows(self.engine, {t.table_name: at}, {t.table_name: touched}, seen)
        return _show(touched, t, self.returning_)


@dataclass(frozen=True)
class Delete(Change):
    engine: Engine
    table: Table
    condition: Expr | None = None
    returning_: Any = None
    box: dict = field(default_factory=dict, hash=False, compare=False)

    def where(self, condition: Expr | None) -> Delete:
        return replace(self, condition=condition, box={})

    def returning(self, what: Any = "*") -> Delete:
        return replace(self, returning_=what, box={})

    def _run(self, scope: Scope) -> DataFrame | None:
        t, seen = self.table, dict(_store(self.engine).manifest()["tables"])
        df = _marked(self.engine, t, self.condition, scope).select(*(F.col(f"`{t.table_name}`.`{n}`").alias(n) for n in t.columns), "__hit")
        gone, at = _divided(self.engine, t, df)
        states, touched = cascade(self.engine, t, at, gone)
        replace_rows(self.engine, states, touched, seen)
        return _show(gone, t, self.returning_)


def _marked(engine: Engine, table: Table, condition: Expr | None, scope: Scope) -> DataFrame:
    """The table's rows with __hit: whether the condition is true for them."""
    df = engine.frame(table).alias(table.table_name)
    if condition is None:
        return df.withColumn("__hit", F.lit(True))
    if any(hasattr(x, "query") for x in condition.walk()):
        numbered = _persist(engine, f"_rows/{table.table_name}", df.withColumn("__id", F.expr("uuid()"))).alias(table.table_name)
        hit = filtered(numbered, condition, scope).select(F.col("__id").alias("__h"))
        return numbered.join(hit, F.col("__id") == F.col("__h"), "left").withColumn("__hit", F.col("__h").isNotNull())
    return df.withColumn("__hit", F.coalesce(condition.lower(scope), F.lit(False)))


def cascade(engine: Engine, table: Table, left: str, gone: DataFrame) -> tuple[dict[str, str], dict[str, DataFrame]]:
    """New places of every table that a deletion reaches through foreign keys, to the fixpoint, and the rows of those that lost a reference."""
    store, state, altered = _store(engine), {table.table_name: left}, set()
    todo = [(table, gone)]
    while todo:
        parent, lost = todo.pop()
        for child in engine.tables.values():
            for own, target, action in child.foreign_keys():
                if target[0].table != parent.table_name:
                    continue
                rows = store.read(state[child.table_name]).select(*child.columns) if child.table_name in state else engine.frame(child)
                keys = lost.select(*(F.col(f"`{c.name}`").alias(f"__t{i}") for i, c in enumerate(target))).distinct()
                on = [F.col(f"`{c}`") == F.col(f"__t{i}") for i, c in enumerate(own)]
                if rows.join(keys, on, "left_semi").isEmpty():
                    continue
                if action in ("RESTRICT", "NO ACTION"):
                    raise ConstraintError(f"rows of {child.table_name} refer to deleted rows of {parent.table_name}")
                marked = rows.join(keys.withColumn("__lost", F.lit(True)), on, "left").withColumn("__hit", F.col("__lost").isNotNull())
                if action == "CASCADE":
                    hit, state[child.table_name] = _divided(engine, child, marked.select(*child.columns, "__hit"))
                    todo.append((child, hit))
                else:
                    fill = lambda n: literal(child.columns[n].default_value) if action == "SET DEFAULT" and child.columns[n].has_default else F.lit(None)  # noqa: E731, B023
                    values = (F.when(F.col("__hit"), fill(n)).otherwise(F.col(f"`{n}`")).cast(c.type.spark).alias(n) if n in own else F.col(f"`{n}`") for n, c in child.columns.items())
                    state[child.table_name] = store.stage(child.table_name, marked.select(*values))
                    altered.add(child.table_name)
    return state, {n: store.read(state[n]) for n in altered}


def replace_rows(engine: Engine, states: dict[str, str | list[str]], touched: dict[str, DataFrame], seen: dict) -> None:
    """Checks what was written and makes it current together; ``seen``: the manifest's tables that the change read."""
    store = _store(engine)
    frames = {n: store.read(*([at] if isinstance(at, str) else at)) for n, at in states.items()}
    for n in states:
        if n in engine.tables and n in touched:
            check_rows(engine, engine.tables[n], touched[n], frames)
    store.apply(states, seen=seen)


def check_rows(engine: Engine, table: Table, rows: DataFrame, states: dict[str, DataFrame]) -> None:
    """Raises if changed rows break a constraint, given the tables' new states."""
    here = Scope(done={r.key: n for n, r in table.c.items()})
    tests = []
    for n, c in table.columns.items():
        if not c.nullable or n in table.key_columns:
            tests.append((f"{table.table_name}.{n} is null", F.col(f"`{n}`").isNull()))
        if c.type.check is not None:
            tests.append((f"{table.table_name}.{n} is no {c.type.name}", ~c.type.check(F.col(f"`{n}`"))))
    for name, condition in table.checks():
        tests.append((f"{table.table_name} breaks {name}", ~condition.lower(here)))
    if tests:
        found = rows.agg(*(F.max(F.coalesce(t, F.lit(False))).alias(f"t{i}") for i, (_, t) in enumerate(tests))).first()
        for (what, _), bad in zip(tests, found, strict=True):
            if bad:
                raise ConstraintError(what)
    for u in table.unique_sets():  # a key that now occurs twice is one of the changed rows'
        keys = rows.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(u))).na.drop()
        whole = states[table.table_name].join(keys, [F.col(f"`{c}`") == F.col(f"__k{i}") for i, c in enumerate(u)], "left_semi")
        if not whole.groupBy(*u).count().filter("count > 1").isEmpty():
            raise ConstraintError(f"{table.table_name} repeats {', '.join(u)}")
    for own, target, _ in table.foreign_keys():
        parent = engine.tables.get(target[0].table)
        known = states.get(parent.table_name) if parent is not None and parent.table_name in states else engine.frame(parent) if parent is not None else None
        if known is None:
            raise QueryError(f"no table {target[0].table}")
        wanted = rows.select(*(F.col(f"`{c}`").alias(f"__f{i}") for i, c in enumerate(own))).na.drop().distinct()
        if not wanted.join(known, [F.col(f"__f{i}") == known[c.name] for i, c in enumerate(target)], "left_anti").isEmpty():
            raise ConstraintError(f"{table.table_name}.{', '.join(own)} refers to no row of {parent.table_name}")
