import pytest

import sparkrel as s
from sparkrel import migrate as m
from sparkrel import types as T
from sparkrel.migrate import cli, ddl


def schema(version):
    mood = s.Enum("mood", ("bad", "good") if version < 3 else ("bad", "fair", "good"))
    users = s.Table("users" if version < 4 else "people", {"id": s.pk(), "name": s.Col(T.varchar(20)), **({"age": s.Col(T.integer()).default(1).not_null()} if version > 1 else {}), "mood": mood.column()})
    posts = s.Table("posts", {"id": s.pk(), "owner": s.Col(T.bigint()).references(lambda: users.id)}, extra=(s.Index("owner"),) if version < 3 else ())
    return [users, posts, mood, s.Sequence("q")]


def test_history(spark, tmp_path):
    store = s.Store(spark, f"file://{tmp_path}/store")
    h = m.Migrations(tmp_path / "migrations", store)
    first = h.generate(schema(1), "001")
    assert first == "001" and [o["name"] for o in h.read("001")["up"] if o["op"] == "create_table"] == ["users", "posts"]
    assert h.generate(schema(1)) is None and h.migrate() == ["001"] and h.migrate() == []
    db = s.Engine(spark, store, schema(1))
    db.insert(db.tables["users"]).values([{"name": "x", "mood": "good"}, {"name": "y"}]).execute()
    h.generate(schema(2), "002")
    h.generate(schema(3), "003")
    assert [o["op"] for o in h.read("003")["up"]] == ["alter_enum", "drop_index"]
    h.generate(schema(4), "004", tables={"users": "people"})
    assert [o["op"] for o in h.read("004")["up"]] == ["rename_table"]
    assert h.status() == [("001", True), ("002", False), ("003", False), ("004", False)]
    assert h.migrate() == ["002", "003", "004"]
    e = s.Engine(spark, store, schema(4))
    assert sorted((r["name"], r["age"]) for r in e.from_(e.tables["people"]).select().collect()) == [("x", 1), ("y", 1)]
    assert h.down("002") == ["004", "003", "002"] and [d for _, d in h.status()] == [True, False, False, False]
    assert "age" not in db.frame(db.tables["users"]).columns and db.shortcuts.count(db.tables["users"]) == 2
    with pytest.raises(m.MigrationError):
        h.squash("001", "003")
    assert h.squash("002", "004") == "004" and h.names() == ["001", "004"] and h.state() == m.snapshot(schema(4))


def test_failure_reverts_the_run(spark, tmp_path):
    store = s.Store(spark, f"file://{tmp_path}/store")
    h = m.Migrations(tmp_path / "m", store)
    h.push(schema(1), name="001")
    db = s.Engine(spark, store, schema(1))
    db.insert(db.tables["users"]).values([{"name": None}, {"name": "a"}]).execute()
    h.write("002", list(m.alter_table("users").rename_column("name", "label")), [])
    h.write("003", list(m.alter_table("users").set_not_null("label")), [])
    with pytest.raises(m.MigrationError):
        h.migrate()
    assert [d for _, d in h.status()] == [True, False, False] and "name" in store.load(spark, db.tables["users"]).columns


def test_operations_on_rows(spark, tmp_path):
    store = s.Store(spark, f"file://{tmp_path}/store")
    state = ddl.carry_out(store, m.snapshot([]), m.diff(m.snapshot([]), m.snapshot(schema(2))))
    db = s.Engine(spark, store, schema(2))
    users = db.tables["users"]
    db.insert(users).values([{"name": "1", "mood": "bad"}, {"name": "2", "mood": "good"}]).execute()
    a = m.alter_table("users").alter_column_type("name", "integer", "int").add_unique("name").add_check("pos", "x", "name > 0").set_default("age", 5).drop_not_null("age").add_primary_key_constraint(["id", "age"]).add_unique_constraint("u", ["name", "age"]).drop_constraint("u").drop_default("age")
    state = ddl.carry_out(store, state, [*a, m.alter_enum("mood", rename=("bad", "poor")), m.create_index("users", ["name"], unique=True), m.drop_index("users", "users_name_index"), m.create_sequence("z"), m.drop_sequence("z"), m.create_schema("w"), m.drop_schema("w"), m.custom("SELECT count(*) FROM users")])
    rows = spark.read.parquet(f"{store.path}/{store.manifest()['tables']['users']}").orderBy("id").collect()
    assert [(r.name, r.mood) for r in rows] == [(1, "poor"), (2, "good")] and state["enums"]["mood"]["values"] == ["poor", "good"]
    for bad in (m.alter_table("users").add_check("neg", "x", "name < 0"), m.alter_table("users").add_foreign_key("f", ["name"], "posts", ["id"]), m.alter_table("users").add_unique("age"), [m.drop_table("nope")], m.alter_table("nope").drop_column("x"), m.alter_table("users").drop_constraint("zz")):
        with pytest.raises(m.MigrationError):
            ddl.carry_out(store, state, list(bad))


def test_differences():
    with pytest.raises(m.MigrationError):
        m.diff(m.snapshot(schema(3)), m.snapshot(schema(1)))
    a = s.Table("a", {"id": s.pk(), "b": s.Col(T.bigint()).references(lambda: b.id)})
    b = s.Table("b", {"id": s.pk(), "a": s.Col(T.bigint()).references(lambda: a.id)})
    ops = m.diff(m.snapshot([]), m.snapshot([a, b]))
    assert [o["op"] for o in ops] == ["create_table", "create_table", "add_constraint"] and m.replay(m.snapshot([]), ops) == m.snapshot([a, b])
    for x in range(1, 5):
        for y in range(x, 5):
            old, new = m.snapshot(schema(x)), m.snapshot(schema(y))
            assert m.replay(old, m.diff(old, new)) == new


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.syspath_prepend(str(tmp_path))
    assert cli.main(["init"]) == 0 and cli.main(["init"]) == 1
    for c in (["push"], ["status"], ["generate"]):
        assert cli.main(c, spark) == 0
    name = m.Migrations(tmp_path / "migrations").names()[0]
    assert f"applied {name}" in capsys.readouterr().out
    assert cli.main(["down", name], spark) == 0 and cli.main(["migrate"], spark) == 0
    import schema as made

    out = []
    cli.shell(s.Engine(spark, s.Store(spark, (tmp_path / "store").as_uri()), made), [r"\dt", r"\dn", r"\du", r"\d users", r"\?", "SELECT count(*) AS n FROM users;", "SELEC", r"\q", "never"], out.append)
    assert out[0] == "public.users" and out[1] == "public" and "name" in out[3] and "n" in out[5] and out[6].startswith("error")
