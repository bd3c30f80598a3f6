import pytest
from pyspark.sql import functions as F

import sparkrel as s
from sparkrel import types as T
from sparkrel.operators.dml import ConstraintError
from sparkrel.sources.store import Conflict

kind = s.Enum("kind", ("a", "b"))
seq = s.Sequence("tickets", start=10, increment=5, maximum=20)
users = s.Table(
    "users",
    {"id": s.pk(), "name": s.Col(T.varchar(10)).not_null().unique(), "age": s.Col(T.integer()).check(lambda c: s.gte(c, 0)), "kind": s.Col(kind.column().type).default("a"), "n": s.Col(T.integer()).default(0), "made": s.Col(T.text()).on_insert(lambda: "new").on_update(lambda: "changed"), "twice": s.Col(T.integer()).generated_always(lambda t: s.mul(t.age, 2))},
    extra=(s.Check("short", lambda t: s.lt(s.length(t.name), 9)),),
)
posts = s.Table("posts", {"id": s.pk(), "owner": s.Col(T.bigint()).references(lambda: users.id), "editor": s.Col(T.bigint()).references(lambda: users.id, "SET NULL"), "parent": s.Col(T.bigint()).references(lambda: posts.id), "title": T.text()})
locks = s.Table("locks", {"id": s.pk(), "owner": s.Col(T.bigint()).references(lambda: users.id, "RESTRICT")})


@pytest.fixture
def db(spark, tmp_path):
    e = s.Engine(spark, s.Store(spark, f"file://{tmp_path}/store"), [users, posts, locks, kind, seq])
    e.insert(users).values([{"name": "ann", "age": 30}, {"name": "bob", "age": None, "kind": "b"}, {"name": "cy"}]).execute()
    return e


def names(db):
    return {r["name"]: r for r in db.from_(users).select().collect()}


def test_insert_fills_and_numbers(db):
    got = names(db)
    assert sorted(r["id"] for r in got.values()) == [1, 2, 3]
    assert got["ann"] == {"id": 1, "name": "ann", "age": 30, "kind": "a", "n": 0, "made": "new", "twice": 60} and got["bob"]["kind"] == "b" and got["bob"]["twice"] is None
    rows = db.insert(users).values({"name": "dee"}).returning({"id": True, "n": True}).collect()
    assert rows == [{"id": 4, "n": 0}]
    df = db.spark.createDataFrame([("e1",), ("e2",)], "name string")
    db.insert(users).values(df).execute()
    assert sorted(r["id"] for r in names(db).values()) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("row", [{"name": "ann"}, {"name": None}, {"age": 1}, {"name": "x", "age": -1}, {"name": "x" * 11}, {"name": "ninechars"}, {"name": "x", "kind": "z"}, {"id": 9, "name": "x"}, {"name": "x", "nope": 1}, {"name": 5}])
def test_bad_rows_change_nothing(db, row):
    with pytest.raises(s.QueryError):
        db.insert(users).values(row).execute()
    assert sorted(names(db)) == ["ann", "bob", "cy"]


def test_upsert(db):
    ins = db.insert(users)
    assert ins.values([{"name": "ann", "age": 1}, {"name": "zed"}, {"name": "zed"}]).on_conflict(users.name).do_nothing().returning({"name": True}).collect() == [{"name": "zed"}]
    up = ins.values([{"name": "ann", "age": 50}, {"name": "new", "age": 1}]).on_conflict("name").do_update_set(lambda x: {"age": x.age, "n": s.add(users.n, 7)}, where=lambda x: s.gt(x.age, users.age))
    assert {(r["name"], r["age"], r["n"]) for r in up.returning().collect()} == {("ann", 50, 7), ("new", 1, 0)}
    assert names(db)["ann"]["made"] == "changed" and names(db)["ann"]["id"] == 1
    assert ins.values({"name": "ann", "age": 2}).on_conflict("name").do_update_set(lambda x: {"age": x.age}, where=lambda x: s.gt(x.age, users.age)).returning().collect() == []
    with pytest.raises(ConstraintError):
        ins.values([{"name": "ann"}, {"name": "ann"}]).on_conflict("name").do_update_set({"n": 1}).execute()
    with pytest.raises(s.QueryError):
        ins.values({"name": "q"}).on_conflict("age").do_update_set({"n": 1}).execute()


def test_update(db):
    got = db.update(users).set({"age": s.add(users.age, 1)}).where(s.eq(users.name, "ann")).returning({"age": True, "made": True, "twice": True}).collect()
    assert got == [{"age": 31, "made": "changed", "twice": 62}]
    assert names(db)["bob"]["made"] == "new"
    assert len(db.update(users).set({"n": 5}).returning().collect()) == 3
    with pytest.raises(ConstraintError):
        db.update(users).set({"name": "same"}).execute()
    with pytest.raises(s.QueryError):
        db.update(users).set({"id": 3}).execute()
    p = s.prepare({"v": T.integer()}, lambda e, a: e.update(users).set({"n": a.v}).where(s.eq(users.name, "cy")).returning({"n": True}))
    assert [r.n for r in p.run(db, v=8).collect()] == [8] and [r.n for r in p.run(db, v=9).collect()] == [9]


def test_delete_and_foreign_keys(db):
    db.insert(posts).values([{"owner": 1, "editor": 2, "title": "x"}, {"owner": 2, "editor": 1, "title": "y"}, {"owner": 2, "parent": 1, "title": "z"}]).execute()
    with pytest.raises(ConstraintError):
        db.insert(posts).values({"owner": 77}).execute()
    assert db.delete(users).where(s.eq(users.id, 1)).returning({"name": True}).collect() == [{"name": "ann"}]
    left = db.from_(posts).select().collect()
    assert [(r["title"], r["editor"]) for r in left] == [("y", None)]
    db.insert(locks).values({"owner": 2}).execute()
    with pytest.raises(ConstraintError):
        db.delete(users).execute()
    assert db.shortcuts.count(users) == 2
    db.delete(users).where(s.eq(users.age, 1)).execute()
    assert db.shortcuts.count(users) == 2
    db.delete(users).where(s.is_in(users.id, db.from_(users).select({"i": users.id}).where(s.eq(users.name, "cy")))).execute()
    assert list(names(db)) == ["bob"]


def test_transactions(db, spark):
    def good(e):
        e.insert(users).values({"name": "in"}).execute()
        assert e.shortcuts.count(users) == 4 and db.shortcuts.count(users) == 3
        e.insert(posts).values({"owner": 1}).execute()

    db.transaction(good)
    assert db.shortcuts.count(users) == 4 and db.shortcuts.count(posts) == 1

    def bad(e):
        e.delete(posts).execute()
        e.insert(users).values({"name": "in"}).execute()

    with pytest.raises(ConstraintError):
        db.transaction(bad)
    assert db.shortcuts.count(posts) == 1

    def late(e):
        e.insert(users).values({"name": "a1"}).execute()
        db.insert(users).values({"name": "a2"}).execute()

    with pytest.raises(Conflict):
        db.transaction(late)
    assert "a1" not in names(db) and "a2" in names(db)
    assert db.source.vacuum() > 0 and db.shortcuts.count(users) == 5


def test_an_insert_adds_a_folder(db, monkeypatch):
    st = db.source
    first = st.places("users")
    db.insert(users).values({"name": "dee"}).execute()
    assert len(first) == 1 and st.places("users")[:1] == first and len(st.places("users")) == 2
    assert st.read(st.places("users")[1]).count() == 1
    db.insert(users).values([{"name": "dee"}, {"name": "eve"}]).on_conflict("name").do_nothing().execute()
    assert len(st.places("users")) == 3 and st.read(st.places("users")[2]).count() == 1
    db.delete(users).where(s.eq(users.name, "ann")).execute()
    db.insert(users).values({"name": "fay"}).execute()
    assert len(st.places("users")) == 2 and sorted(names(db)) == ["bob", "cy", "dee", "eve", "fay"]
    assert st.vacuum() > 0 and st.vacuum() == 0 and sorted(names(db)) == ["bob", "cy", "dee", "eve", "fay"]
    monkeypatch.setattr("sparkrel.operators.dml.FOLDERS", 2)
    db.insert(users).values({"name": "gil"}).execute()
    assert len(st.places("users")) == 1 and len(names(db)) == 6
    db.delete(users).execute()
    assert names(db) == {} and db.insert(users).values({"name": "ann"}).returning({"id": True}).collect() == [{"id": 9}]


def test_a_change_finds_out_that_another_came_first(db):
    seen = db.source.manifest()["tables"]
    db.insert(users).values({"name": "dee"}).execute()
    with pytest.raises(Conflict):
        db.source.apply({"users": "users/v-0"}, seen=seen)
    assert len(names(db)) == 4


def test_a_row_that_is_set_null_and_deleted(spark, tmp_path):
    a = s.Table("a", {"id": s.Col(T.bigint()).primary_key()})
    b = s.Table("b", {"id": s.Col(T.bigint()).primary_key(), "x": s.Col(T.bigint()).references(lambda: a.id, "SET NULL"), "y": s.Col(T.bigint()).references(lambda: a.id)})
    e = s.Engine(spark, s.Store(spark, f"file://{tmp_path}/q"), [a, b])
    e.insert(a).values([{"id": 1}, {"id": 2}]).execute()
    e.insert(b).values([{"id": 1, "x": 1, "y": 1}, {"id": 2, "x": 1, "y": 2}, {"id": 3, "x": 2, "y": 1}]).execute()
    e.delete(a).where(s.eq(a.id, 1)).execute()
    assert e.from_(b).select().collect() == [{"id": 2, "x": None, "y": 2}]


def test_change_in_named_query_happens_once(db):
    gone = db.cte("gone", db.delete(users).where(s.eq(users.name, "cy")).returning())
    q = db.with_(gone).from_(gone).select({"n": gone.c["name"]})
    assert q.collect() == [{"n": "cy"}] and q.collect() == [{"n": "cy"}] and db.shortcuts.count(users) == 2


def test_sequences(db):
    st = db.source
    with pytest.raises(s.QueryError):
        st.currval(seq)
    assert [st.nextval(seq) for _ in range(3)] == [10, 15, 20] and st.currval(seq) == 20
    with pytest.raises(s.QueryError):
        st.nextval(seq)
    st.setval(seq, 12)
    assert st.nextval(seq) == 17


def test_declarations_are_checked():
    for bad in (lambda: s.PrimaryKey(("a",)), lambda: s.Unique(("a",)), lambda: s.Enum("e", ("x", "x")), lambda: s.Table("q", {"a": T.text()}, extra=(s.Index("b"),)), lambda: s.Reference(users.id, "EXPLODE")):
        with pytest.raises(s.QueryError):
            bad()
    assert s.Index(("a", "b")).named("t") == "t_a_b_index" and s.is_table(users) and s.is_enum(kind) and s.is_sequence(seq)


def test_validators():
    v = s.insert_validator(users)
    assert v.required() == ["name"] and v.check({"name": "x", "age": 3}) == {}
    assert set(v.check({"id": 1, "age": "x", "kind": "q"})) == {"id", "name", "age", "kind"}
    w = s.update_validator(users)
    assert w.check({"age": None}) == {} and set(w.check({"name": None, "id": 2})) == {"name", "id"}
    with pytest.raises(ValueError):
        v.parse({})


@pytest.mark.parametrize(
    "type_, good, bad",
    [
        (T.smallint(), 32767, 32768), (T.integer(), -5, 2**31), (T.bigint(), 2**62, 2**63), (T.boolean(), True, 1), (T.numeric(5, 2), "123.45", "1234.5"), (T.varchar(3), "abc", "abcd"), (T.uuid(), "123e4567-e89b-12d3-a456-426614174000", "nope"), (T.bit(3), "101", "10"),
        (T.integer().array(2), [1, 2], [1]), (T.text().array(None, None), [["a"]], ["a"]), (T.vector(2), [1.0, 2], [1.0]), (T.bytea(), b"x", "x"),
    ],
)
def test_type_checks(type_, good, bad):
    assert type_.accepts(good) is None and type_.accepts(bad) and type_.accepts(None) is None


def test_sequence_default(spark, tmp_path):
    step = s.Sequence("step", start=100, increment=2)
    t = s.Table("t", {"id": s.Col(T.bigint()).default(step).primary_key(), "x": T.text()})
    e = s.Engine(spark, s.Store(spark, f"file://{tmp_path}/q"), [t, step])
    e.insert(t).values([{"x": "a"}, {"id": 5, "x": "b"}, {"x": "c"}]).execute()
    assert sorted((r["id"], r["x"]) for r in e.from_(t).select().collect()) == [(5, "b"), (100, "a"), (102, "c")]


@pytest.mark.parametrize("start, increment, low, high", [(10, 5, 1, 20), (20, 5, 1, 20), (-3, -4, -10, -1), (1, 1, 1, 3)])
def test_sequence_that_cycles(spark, tmp_path, start, increment, low, high):
    from sparkrel.operators.dml import _sequence

    step = s.Sequence("step", start=start, increment=increment, minimum=low, maximum=high, cycle=True)
    one, all_ = (s.Store(spark, f"file://{tmp_path}/{n}") for n in "ab")
    want = [one.nextval(step) for _ in range(14)]
    got = []
    for n in (1, 3, 9, 1):
        place = all_.reserve(step, n)
        got += [r.v for r in spark.range(n).withColumn("v", _sequence(step, F.col("id"), *place)).orderBy("id").collect()]
    again = low if increment > 0 else high
    plain, v = [], start
    for _ in range(14):
        plain.append(v)
        v = v + increment if low <= v + increment <= high else again
    assert want == got == plain


def test_log(db, caplog):
    with caplog.at_level("INFO", "sparkrel"):
        db.from_(users).select({"n": users.name}).collect()
        with pytest.raises(s.QueryError):
            db.insert(users).values({"name": "ann"}).execute()
    done, failed = caplog.records[0], caplog.records[-1]
    assert done.query == "select from users" and done.duration_ms > 0 and done.levelname == "INFO"
    assert failed.levelname == "ERROR" and failed.query == "insert users"


def test_all_types_round_trip(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal

    given = {
        "a": (T.smallint(), 3), "b": (T.integer(), -4), "c": (T.bigint(), 2**40), "d": (T.numeric(10, 2), "12.345"), "e": (T.boolean(), False), "f": (T.text(), "é'\\"), "g": (T.char(4), "ab "), "h": (T.date(), dt.date(2024, 2, 29)), "i": (T.timestamp(), dt.datetime(2024, 1, 1, 12)),
        "j": (T.time(), "12:30:00"), "k": (T.bytea(), b"\x00\xff"), "l": (T.json(), '{"a": null}'), "m": (T.integer().array(None, None), [[1, None], []]), "n": (T.vector(2), [1, 2.5]), "o": (T.point(), (1.5, -2.0)), "p": (T.bit(3), "010"), "q": (T.sparsevec(3), "{1:2.5}/3"), "r": (T.double(), 2),
        "s": (T.inet(), "10.0.0.1"), "t": (T.linestring(), [(0.0, 0.0), (1.0, 2.0)]), "u": (T.jsonb(), {"x": [1, None]}),
    }
    t = s.Table("t", {n: c for n, (c, _) in given.items()})
    e = s.Engine(spark, s.Store(spark, f"file://{tmp_path}/q"), [t])
    e.insert(t).values([{n: v for n, (_, v) in given.items()}, {}]).execute()
    rows = e.from_(t).select().order_by(s.asc(t.a)).df.drop("u").collect()
    got = rows[0].asDict(True)
    want = {n: v for n, (_, v) in given.items() if n != "u"} | {"d": Decimal("12.34"), "g": "ab", "k": bytearray(b"\x00\xff"), "n": [1.0, 2.5], "o": {"lon": 1.5, "lat": -2.0}, "r": 2.0, "t": [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 2.0}]}
    assert got == want and set(rows[1].asDict().values()) == {None}
    assert e.frame(t).selectExpr("variant_get(u, '$.x[0]', 'int') AS x").where("x is not null").first().x == 1
    for bad in ({"j": "noon"}, {"q": "1:2"}, {"p": "01"}, {"m": 3}, {"n": [1.0]}):
        with pytest.raises(s.QueryError):
            e.insert(t).values(bad).execute()
