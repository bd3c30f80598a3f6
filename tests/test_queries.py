"""PostgreSQL's results where Spark's defaults differ, on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import sparkrel as s
from sparkrel import types as T
from sparkrel.functions.geo import sphere_distance
from sparkrel.functions.vector import sparse_to_dense

level = s.Enum("level", ("low", "mid", "high"))
t = s.Table("t", {"id": s.Col(T.bigint()).primary_key(), "name": T.text(), "n": T.integer(), "x": T.double(), "lv": level.column(), "tags": T.text().array(), "grid": T.integer().array(None, None), "at": T.point(), "v": T.vector(2), "bits": T.bit(4), "c": T.char(5)})
u = s.Table("u", {"id": s.Col(T.bigint()).primary_key(), "tid": s.Col(T.bigint()).references(lambda: t.id), "k": T.integer()})
ROWS = [
    (1, "hello", 7, 2.5, "high", ["a", "b"], [[1, 2], [3]], (-74.006, 40.7128), [1.0, 2.0], "1010", "ab   "),
    (2, " 50%_x ", -7, -2.5, "low", [], [[]], (-118.2437, 34.0522), [0.0, 1.0], "1111", "cd"),
    (3, None, None, None, None, None, None, None, None, None, None),
    (4, "Hello\t", 0, 0.0, "mid", ["a", None], [[1], [None]], (-74.006, 40.7128), [0.0, 0.0], "0000", ""),
]


@pytest.fixture(scope="module")
def db(spark):
    names = list(t.columns)
    df = spark.createDataFrame(ROWS, t.struct)
    assert df.columns == names
    kids = spark.createDataFrame([(10, 1, 5), (11, 1, 3), (12, 2, 9), (13, None, 1)], u.struct)
    return s.Engine(spark, s.Frames({"t": df, "u": kids}), [t, u, s.relations(t, {"us": s.many(u), "first": s.one(u)}), s.relations(u, {"t": s.fk(t)})])


def ids(db, f):
    return sorted(r["id"] for r in db.from_(t).select({"id": t.id}).where(f).collect())


def values(db, e):
    return [r["v"] for r in db.from_(t).select({"id": t.id, "v": e}).order_by(s.asc(t.id)).collect()]


def test_three_valued_filters(db):
    assert ids(db, s.eq(t.n, None)) == [] and ids(db, s.ne(t.n, None)) == []
    assert ids(db, s.is_in(t.n, [])) == [] and ids(db, s.not_in(t.n, [])) == [1, 2, 3, 4]
    assert ids(db, s.not_in(t.n, [7, None])) == []
    assert ids(db, s.and_()) == [1, 2, 3, 4] and ids(db, s.or_()) == []
    assert ids(db, s.or_(None, s.eq(t.n, 7))) == [1]
    assert ids(db, s.is_in(t.id, db.from_(u).select({"x": u.tid}))) == [1, 2]
    assert ids(db, s.and_(s.is_in(t.id, db.from_(u).select({"x": u.tid})), s.gt(t.n, 0))) == [1]


def test_text(db):
    assert ids(db, s.contains(t.name, "%_")) == [2] and ids(db, s.ends_with(t.name, "o")) == [1] and ids(db, s.starts_with(t.name, "h")) == [1]
    assert ids(db, s.like(t.name, r"%\%\_%")) == [2] and ids(db, s.like(t.name, "hell_")) == [1]
    assert values(db, s.left(t.name, -2))[0] == "hel" and values(db, s.left(t.name, 2))[0] == "he" and values(db, s.left(t.name, -9))[0] == ""
    assert values(db, s.right(t.name, -2))[0] == "llo" and values(db, s.right(t.name, 2))[0] == "lo" and values(db, s.right(t.name, 99))[0] == "hello"
    assert values(db, s.trim(t.name)) == ["hello", "50%_x", None, "Hello\t"]
    assert values(db, s.position(t.name, "l")) == [3, 0, None, 3]
    assert values(db, t.c["c"]) == ["ab", "cd", None, ""]


def test_numbers(db):
    assert values(db, s.div(t.n, 2)) == [3, -3, None, 0]
    assert values(db, s.div(t.x, 2)) == [1.25, -1.25, None, 0.0]
    assert values(db, s.mod(t.n, 3)) == [1, -1, None, 0]
    assert values(db, s.round_(t.x)) == [3.0, -3.0, None, 0.0]
    assert values(db, s.trunc(t.x)) == [2.0, -2.0, None, 0.0] and values(db, s.trunc(s.div(t.x, 3), 2))[1] == -0.83
    assert values(db, s.ceil(t.x))[:2] == [3.0, -2.0] and isinstance(values(db, s.floor(t.x))[0], float)


def test_arrays(db):
    assert ids(db, s.array_contains(t.tags, ["a"])) == [1, 4] and ids(db, s.array_contains(t.tags, [])) == [1, 2, 4]
    assert ids(db, s.array_contained_by(t.tags, ["a", "b", "c"])) == [1, 2]
    assert ids(db, s.array_overlaps(t.tags, ["b", "z"])) == [1]
    assert ids(db, s.array_has(t.tags, "a")) == [1, 4] and ids(db, s.array_all(t.tags, "a")) == [2]
    assert ids(db, s.array_contains(t.grid, [[3], [1]])) == [1]


def test_enum_order(db):
    rows = db.from_(t).select({"lv": t.lv}).where(s.is_not_null(t.lv)).order_by(s.desc(t.lv)).collect()
    assert [r["lv"] for r in rows] == ["high", "mid", "low"]
    assert db.from_(t).select({"a": s.min_(t.lv), "b": s.max_(t.lv)}).collect() == [{"a": "low", "b": "high"}]
    assert ids(db, s.gte(t.lv, "mid")) == [1, 4]


def test_null_order_and_distinct(db):
    order = lambda o: [r["id"] for r in db.from_(t).select({"id": t.id}).order_by(o, s.asc(t.id)).collect()]
    assert order(s.asc(t.n)) == [2, 4, 1, 3] and order(s.desc(t.n)) == [3, 1, 4, 2]
    assert db.shortcuts.distinct(t, t.lv) == ["low", "mid", "high", None]


def test_vectors_and_bits(db):
    assert values(db, s.l2_distance(t.v, [1, 0]))[0] == 2.0 and values(db, s.inner_product(t.v, [1, 1]))[0] == -3.0 and values(db, s.l1_distance(t.v, [0, 0]))[0] == 3.0
    c = values(db, s.cosine_distance(t.v, [0, 2]))
    assert c[1] == pytest.approx(0) and c[3] != c[3] and c[2] is None
    assert values(db, s.hamming_distance(t.bits, "1000")) == [1.0, 3.0, None, 1.0]
    assert values(db, s.jaccard_distance(t.bits, "1000")) == [0.5, 0.75, None, 1.0]
    assert db.spark.range(1).select(sparse_to_dense(F.lit("{1:2,3:0.5}/4"), 4).alias("v")).first().v == [2.0, 0.0, 0.5, 0.0]


def test_geography(db):
    la = (-118.2437, 34.0522)
    assert values(db, sphere_distance(t.at, la))[0] == pytest.approx(3_935_752, rel=1e-4)
    assert values(db, s.st_distance(t.at, la))[0] == pytest.approx(3_944_422, rel=1e-4) and values(db, s.st_distance(t.at, la))[1:3] == [0.0, None]
    assert ids(db, s.st_dwithin(t.at, la, 4_000_000)) == [1, 2, 4] and ids(db, s.st_dwithin(t.at, la, 3_900_000)) == [2]
    for f in (s.st_intersects, s.st_contains, s.st_within):
        assert ids(db, f(t.at, la)) == [2]


def test_grouping(db):
    q = db.from_(t).select({"n": s.count("*"), "k": s.count(t.n), "d": s.count_distinct(t.lv), "a": s.avg(t.n)})
    assert q.collect() == [{"n": 4, "k": 3, "d": 3, "a": 0.0}]
    assert db.from_(t).select({"v": s.round_(s.avg(t.x))}).collect() == [{"v": 0.0}]
    with pytest.raises(s.QueryError):
        db.from_(t).select({"n": t.n, "c": s.count("*")}).group_by(t.lv).df
    with pytest.raises(s.QueryError):
        db.from_(t).where(s.gt(s.count("*"), 1))
    with pytest.raises(s.QueryError):
        s.sum_(s.count("*"))
    with pytest.raises(s.QueryError):
        s.sum_(t.name)
    with pytest.raises(s.QueryError):
        db.from_(t).select({"n": t.n}).having(s.gt(t.n, 1)).df


def test_joins_and_clashes(db):
    q = db.from_(t).inner_join(u, s.eq(t.id, u.tid))
    with pytest.raises(s.QueryError):
        q.select().df
    assert q.select(suffix=True).df.columns[-3:] == ["u_id", "tid", "k"]
    assert sorted((r["a"], r["b"]) for r in q.select({"a": t.id, "b": u.id}).collect()) == [(1, 10), (1, 11), (2, 12)]


def test_relations(db):
    got = {r["id"]: r for r in db.find_many(t, columns={"id": True}, with_={"us": {"columns": {"id": True}, "order_by": s.desc(u.k)}, "first": True}).collect()}
    assert [x["id"] for x in got[1]["us"]] == [10, 11] and got[3]["us"] == [] and got[3]["first"] is None and got[2]["first"]["k"] == 9
    back = {r["id"]: r["t"] for r in db.find_many(u, with_={"t": {"columns": {"name": True}}}).collect()}
    assert back[10] == {"name": "hello"} and back[13] is None
    assert [len(r["us"]) for r in db.find_many(t, order_by=s.asc(t.id), with_={"us": {"limit": 0}}).collect()] == [0, 0, 0, 0]
    assert db.find_first(t, where=s.eq(t.id, 99)).collect() is None
    deep = db.find_first(t, where=s.eq(t.id, 1), with_={"us": {"order_by": s.asc(u.id), "offset": 1, "with_": {"t": {"columns": {"id": True}}}}}).collect()
    assert deep["us"] == [{"id": 11, "tid": 1, "k": 3, "t": {"id": 1}}]
    for bad in ({"with_": {"nope": True}}, {"with_": {"first": {"where": s.eq(u.k, 1)}}}, {"columns": {"zz": True}}):
        with pytest.raises(s.RelationError):
            db.find_many(t, **bad).df


def test_prepared_binds_by_name(db):
    p = s.prepare({"z": T.integer(), "a": T.integer()}, lambda e, a: e.from_(t).select({"id": t.id}).where(s.and_(s.lt(t.n, a.z), s.gt(t.n, a.a), s.lt(t.n, a.z))))
    assert [r.id for r in p.run(db, z=7, a=-7).collect()] == [4]
    for bad in ({"z": 1}, {"z": 1, "a": "x"}, {"z": 1, "a": 1, "q": 2}):
        with pytest.raises(s.QueryError):
            p.run(db, **bad)


def test_raw_literals_are_quoted(db):
    assert ids(db, s.sql("{0} = {1}", t.name, "x' OR 1=1 --")) == []
    assert ids(db, s.sql("{0} = {1}", t.name, "Hello\t")) == [4]


def test_own_functions(db):
    double_ = s.register_fn("twice", lambda c: c * 2, kind="numeric")
    total = s.register_fn("total", F.sum, kind="numeric", aggregate=True)
    assert values(db, double_(t.n))[0] == 14
    assert db.from_(t).select({"v": total(t.n)}).collect() == [{"v": 0}]


def test_uuid_and_now(db):
    rows = db.from_(t).select({"a": s.uuidv4(), "b": s.uuidv7(), "n": s.now()}).collect()
    assert len({r["a"] for r in rows}) == 4 and all(r["b"][14] == "7" and len(r["b"]) == 36 for r in rows) and isinstance(rows[0]["n"], dt.datetime)


def test_plan_has_no_python_and_prunes(db, spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as n", "'x' as name").write.parquet(f"{tmp_path}/w.parquet")
    w = s.Table("w", {"id": T.bigint(), "n": T.bigint(), "name": T.text()})
    e = s.Engine(spark, s.ParquetFolder(str(tmp_path)), [w])
    plan = e.from_(w).select({"s": s.sum_(w.id)}).where(s.gt(w.n, 3)).df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n), GreaterThan(n,3)]" in plan and "name" not in plan.split("ReadSchema")[1] and "Python" not in plan


def test_a_limit_reaches_the_relations_rows(db, capsys):
    q = db.find_many(t, order_by=s.desc(t.id), limit=2, with_={"us": {"order_by": s.asc(u.id), "limit": 1, "with_": {"t": True}}})
    whole = db.find_many(t, order_by=s.desc(t.id), with_={"us": {"order_by": s.asc(u.id), "limit": 1, "with_": {"t": True}}})
    q.explain()
    limited = capsys.readouterr().out
    whole.explain()
    assert "LeftSemi" in limited and "LeftSemi" not in capsys.readouterr().out
    assert q.collect() == whole.collect()[:2]
    assert db.find_many(t, limit=3, offset=1, with_={"us": True}).frame().count() == 3
