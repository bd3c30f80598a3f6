"""What changes, transactions, sequences and migrations leave of a copy of region and nation in a store."""

from __future__ import annotations

import datetime as dt
import logging
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import Check, Col, Engine, Enum, Index, PrimaryKey, QueryError, Sequence, Table, Unique, eq, fk, gt, gte, insert_validator, length, many, migrate, now, relations, st_contains, st_within, types, update_validator, uuidv4, uuidv7
from .catalogue import _places, customer, key, nation, new_store, query, region  # noqa: I001  (at the end of catalogue)

big, integer, text = types.bigint(), types.integer(), types.text()
REGION = Table("region", {"r_regionkey": key(), "r_name": text})
NATION = "SELECT * FROM nation"


def nations(action: str | None = None, extra: tuple = ()) -> Table:
    of = Col(integer)
    return Table("nation", {"n_nationkey": key(), "n_name": text, "n_regionkey": of.references(lambda: REGION.r_regionkey, action) if action else of}, extra=extra)


def left_over(db: Engine, change: Callable[[Engine, Table], DataFrame | None], t: Table | None = None, more: Iterable = ()) -> DataFrame:
    """The rows of nation, or what change gives, after a change of a stored copy."""
    t = t or nations()
    e = Engine(db.spark, new_store(db), [REGION, t, *more])
    e.insert(REGION).values(db.frame(region)).execute()
    e.insert(t).values(db.frame(nation)).execute()
    shown = change(e, t)
    return e.frame(t) if shown is None else shown


def refused(run: Callable[[], object]) -> None:
    """Does what must be refused."""
    try:
        run()
    except (QueryError, migrate.MigrationError):
        return
    raise AssertionError("not refused")


def rows_of(db: Engine, rows: list[tuple], schema: str) -> DataFrame:
    return db.spark.createDataFrame(rows, schema)


# upserts, foreign keys, transactions
_new = [{"n_nationkey": k, "n_name": f"new{k}", "n_regionkey": 2} for k in (3, 4, 5, 6, 7, 99)]
query("dml_upsert_where", "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 3 AND 7 AND n_regionkey < 2 THEN 'new' || n_nationkey ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'new99', 2", lambda db: left_over(db, lambda e, t: e.insert(t).values(_new).on_conflict(t.n_nationkey).do_update_set(lambda x: {"n_name": x.n_name}, where=lambda x: gt(x.n_regionkey, t.n_regionkey)).execute()))
query("fk_cascade", "SELECT * FROM nation WHERE n_regionkey <> 2", lambda db: left_over(db, lambda e, t: e.delete(REGION).where(eq(REGION.r_regionkey, 2)).execute(), nations("CASCADE")))
query("fk_set_null", "SELECT n_nationkey, n_name, nullif(n_regionkey, 2) AS n_regionkey FROM nation", lambda db: left_over(db, lambda e, t: e.delete(REGION).where(eq(REGION.r_regionkey, 2)).execute(), nations("SET NULL")))
query("fk_restrict", NATION, lambda db: left_over(db, lambda e, t: refused(lambda: e.delete(REGION).where(eq(REGION.r_regionkey, 2)).execute()), nations("RESTRICT")))
query("fk_no_parent", NATION, lambda db: left_over(db, lambda e, t: refused(lambda: e.insert(t).values({"n_nationkey": 90, "n_regionkey": 77}).execute()), nations("CASCADE")))


def _moved(e: Engine, t: Table) -> None:
    def both(x: Engine) -> None:
        x.delete(t).where(eq(t.n_regionkey, 1)).execute()
        x.insert(t).values({"n_nationkey": 50, "n_name": "fifty", "n_regionkey": 1}).execute()

    e.transaction(both)


def _failed(e: Engine, t: Table) -> None:
    def both(x: Engine) -> None:
        x.delete(t).execute()
        x.insert(t).values([{"n_nationkey": 1}, {"n_nationkey": 1}]).execute()

    refused(lambda: e.transaction(both))


query("transaction_committed", "SELECT * FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 50, 'fifty', 1", lambda db: left_over(db, _moved))
query("transaction_rolled_back", NATION, lambda db: left_over(db, _failed))


# constraints and validators
def _insert(*rows: dict):
    return lambda e, t: [refused(lambda r=r: e.insert(t).values(r).execute()) for r in rows] and e.insert(t).values({"n_nationkey": 60, "n_name": "sixty", "n_regionkey": 0}).execute()


_SIXTY = f"{NATION} UNION ALL SELECT 60, 'sixty', 0"
query("constraint_check", _SIXTY, lambda db: left_over(db, _insert({"n_nationkey": -1, "n_name": "x"}, {"n_nationkey": 61, "n_name": "a%"}), nations(extra=(Check("positive", lambda t: gte(t.n_nationkey, 0)), Check("long", lambda t: gt(length(t.n_name), 2))))))
query("constraint_unique_pair", _SIXTY, lambda db: left_over(db, _insert({"n_nationkey": 61, "n_name": "sixty", "n_regionkey": 0} | {"n_nationkey": 0}), nations(extra=(Unique(("n_nationkey", "n_regionkey")), Index(("n_name", "n_regionkey"))))))


def _pair_key(db: Engine) -> DataFrame:
    t = Table("pairs", {"a": integer, "b": integer, "c": text}, extra=(PrimaryKey(("a", "b")),))
    e = Engine(db.spark, new_store(db), [t])
    e.insert(t).values(db.frame(nation).select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.col("n_name").alias("c"))).execute()
    refused(lambda: e.insert(t).values([{"a": 90, "b": 1}, {"a": 90, "b": 1}]).execute())
    refused(lambda: e.insert(t).values({"a": 90}).execute())
    return e.frame(t)


query("constraint_primary_key_pair", "SELECT n_regionkey AS a, n_nationkey AS b, n_name AS c FROM nation", _pair_key)
_PEOPLE = Table("people", {"id": key(big), "name": Col(types.varchar(5)).not_null(), "age": Col(integer).default(3)})
query("validator_insert", "SELECT * FROM (VALUES ('age'), ('id'), ('name'), ('nope')) v(wrong)", lambda db: rows_of(db, [(k,) for k in insert_validator(_PEOPLE).check({"name": "too long", "age": "x", "nope": 1})], "wrong string"))
query("validator_update", "SELECT * FROM (VALUES ('id'), ('name')) v(wrong)", lambda db: rows_of(db, [(k,) for k in update_validator(_PEOPLE).check({"id": 1, "name": None, "age": None})], "wrong string"))


# sequences, generated values, logging, plans' columns
def _sequence(db: Engine) -> DataFrame:
    s, store = Sequence("tickets", start=10, increment=5, maximum=20, cycle=False), new_store(db)
    out = [("next", store.nextval(s)) for _ in range(3)] + [("current", store.currval(s))]
    refused(lambda: store.nextval(s))
    out += [("set", store.setval(s, 12)), ("after", store.nextval(s))]
    return rows_of(db, out, "what string, value long")


query("sequence_values", "SELECT * FROM (VALUES ('next', 10::BIGINT), ('next', 15), ('next', 20), ('current', 20), ('set', 12), ('after', 17)) v(what, value)", _sequence)
for _n, _f in (("4", uuidv4), ("7", uuidv7)):
    query(f"uuid_v{_n}", f"SELECT n_nationkey AS k, 36 AS n, '{_n}' AS version FROM nation", lambda db, f=_f: db.from_(nation).select({"k": nation.n_nationkey, "u": f()}).df.select("k", F.length("u").alias("n"), F.substring("u", 15, 1).alias("version")))
query("uuid_distinct", "SELECT count(*) AS n FROM customer", lambda db: db.from_(customer).select({"k": customer.c_custkey, "u": uuidv7()}).df.agg(F.count_distinct("u").alias("n")))
query("now_is_later", "SELECT n_nationkey AS k FROM nation", lambda db: db.from_(nation).select({"k": nation.n_nationkey}).where(gt(now(), dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc))).df)


def _logged(db: Engine) -> DataFrame:
    class Kept(logging.Handler):
        def emit(self, record: logging.LogRecord) -> None:
            out.append((record.levelname, record.query, record.duration_ms >= 0))

    out: list[tuple] = []
    log = logging.Logger("kept")
    log.addHandler(Kept())
    e = Engine(db.spark, db.source, [nation], logger=log)
    e.from_(nation).select({"k": nation.n_nationkey}).collect()
    refused(lambda: e.raw("SELECT * FROM nation", rows=lambda df: e.from_("nation")))
    return rows_of(db, out, "level string, query string, timed boolean")


query("query_log", "SELECT * FROM (VALUES ('INFO', 'select from nation', true), ('ERROR', 'SELECT * FROM nation', true)) v(level, query, timed)", _logged)
query("resolved_columns", "SELECT * FROM (VALUES ('k'), ('n')) v(name)", lambda db: rows_of(db, [(n,) for n in db.from_(nation).select({"k": nation.n_nationkey, "n": length(nation.n_name)}).columns()], "name string"))
_AT = "SELECT c_custkey AS k FROM customer WHERE (c_custkey * 37) % 360 - 180 = -143 AND (c_custkey * 11) % 170 - 85 = -74"
query("geo_contains", _AT, lambda db: _places(db, lambda e, t: e.from_(t).select({"k": t.k}).where(st_contains(t.at, (-143, -74))).df))
query("geo_within", _AT, lambda db: _places(db, lambda e, t: e.from_(t).select({"k": t.k}).where(st_within(t.at, (-143, -74))).df))


def _orphans(db: Engine) -> DataFrame:
    t = nations("SET NULL")
    e = Engine(db.spark, new_store(db), [REGION, t, relations(t, {"region": fk(REGION)}), relations(REGION, {"nations": many(t)})])
    e.insert(REGION).values(db.frame(region)).execute()
    e.insert(t).values(db.frame(nation)).execute()
    e.delete(REGION).where(eq(REGION.r_regionkey, 2)).execute()
    return e.find_many(t, with_={"region": {}}).df.select("n_nationkey", F.col("region.r_name").alias("r_name"))


query("rel_null_key", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE r_name END AS r_name FROM nation JOIN region ON r_regionkey = n_regionkey", _orphans)


# migrations: each operation on stored rows
def migrated(db: Engine, ops: Callable[[], Iterable[dict]], bad: Callable[[], Iterable[dict]] | None = None) -> DataFrame:
    """nation as stored after the operations; bad ones are refused."""
    t = nations()
    store = new_store(db)
    e = Engine(db.spark, store, [REGION, t])
    state = migrate.ddl.carry_out(store, migrate.snapshot([]), migrate.diff(migrate.snapshot([]), migrate.snapshot([REGION, t])))
    e.insert(REGION).values(db.frame(region)).execute()
    e.insert(t).values(db.frame(nation)).execute()
    state = migrate.ddl.carry_out(store, state, list(ops()))
    if bad is not None:
        inner = store.begin()
        refused(lambda: migrate.ddl.carry_out(inner, state, list(bad())))
        inner.rollback()
    return store.rows("nation" if store.places("nation") else "states")


A = lambda: migrate.alter_table("nation")
query("ddl_add_column", "SELECT *, 7 AS extra FROM nation", lambda db: migrated(db, lambda: A().add_column("extra", Col(integer).default(7).not_null())))
query("ddl_drop_column", "SELECT n_nationkey, n_regionkey FROM nation", lambda db: migrated(db, lambda: A().drop_column("n_name")))
query("ddl_rename_column", "SELECT n_nationkey, n_name AS label, n_regionkey FROM nation", lambda db: migrated(db, lambda: A().rename_column("n_name", "label")))
query("ddl_alter_type", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey FROM nation", lambda db: migrated(db, lambda: A().alter_column_type("n_nationkey", "text", "string")))
query("ddl_rename_table", NATION, lambda db: migrated(db, lambda: [migrate.ddl.rename_table("nation", "states")]))
query("ddl_not_null", NATION, lambda db: migrated(db, lambda: A().set_not_null("n_name").drop_not_null("n_name"), lambda: A().add_column("empty", Col(text)).set_not_null("empty")))
query("ddl_defaults", "SELECT *, 5 AS extra FROM nation", lambda db: migrated(db, lambda: A().set_default("n_regionkey", 5).drop_default("n_regionkey").add_column("extra", Col(integer).default(5))))
query("ddl_unique", NATION, lambda db: migrated(db, lambda: A().add_unique("n_name").drop_unique("n_name").add_unique_constraint("pair", ["n_name", "n_regionkey"]).drop_constraint("pair"), lambda: A().add_unique("n_regionkey")))
query("ddl_check", NATION, lambda db: migrated(db, lambda: A().add_check("positive", "n_nationkey >= 0", "n_nationkey >= 0").drop_constraint("positive"), lambda: A().add_check("negative", "n_nationkey < 0", "n_nationkey < 0")))
query("ddl_foreign_key", NATION, lambda db: migrated(db, lambda: A().add_foreign_key("f", ["n_regionkey"], "region", ["r_regionkey"]).drop_foreign_key("f"), lambda: A().add_foreign_key("g", ["n_nationkey"], "region", ["r_regionkey"])))
query("ddl_index", NATION, lambda db: migrated(db, lambda: [migrate.create_index("nation", ["n_name"], name="i", unique=True), migrate.drop_index("nation", "i")], lambda: [migrate.create_index("nation", ["n_regionkey"], unique=True)]))
query("ddl_schema_enum_sequence", NATION, lambda db: migrated(db, lambda: [migrate.ddl.create_schema("extra"), migrate.ddl.drop_schema("extra"), migrate.ddl.create_enum("mood", ["bad"]), migrate.alter_enum("mood", add="good"), migrate.ddl.drop_enum("mood"), migrate.create_sequence("q"), migrate.ddl.drop_sequence("q")]))


def _history(db: Engine) -> DataFrame:
    """What is applied after generate, migrate, down, squash and push."""
    versions = [[REGION], [REGION, nations()], [REGION, nations(extra=(Index("n_name"),))]]
    h = migrate.Migrations(tempfile.mkdtemp(prefix="sparkrel-migrations-"), new_store(db))
    for k, v in enumerate(versions, 1):
        h.generate(v, f"00{k}")
    out = [("made", n, d) for n, d in h.status()]
    h.migrate()
    h.down("002")
    out += [("down", n, d) for n, d in h.status()]
    h.squash("002", "003")
    h.migrate()
    out += [("squashed", n, d) for n, d in h.status()]
    h.push([*versions[2], Enum("mood", ("bad", "good"))], name="004")
    out += [("pushed", n, d) for n, d in h.status()]
    return rows_of(db, out, "step string, name string, applied boolean")


query("migration_history", "SELECT * FROM (VALUES ('made', '001', false), ('made', '002', false), ('made', '003', false), ('down', '001', true), ('down', '002', false), ('down', '003', false), ('squashed', '001', true), ('squashed', '003', true), ('pushed', '001', true), ('pushed', '003', true), ('pushed', '004', true)) v(step, name, applied)", _history)
