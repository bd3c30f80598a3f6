from collections import defaultdict

from sparkrel.llm import sharding


def test_every_shard_fits_and_only_full_buckets_split(spark, odd_docs):
    docs = odd_docs.unionByName(odd_docs.filter("doc_id = 4").crossJoin(spark.range(200)).drop("id"))
    rows = sharding.shards(docs, limit=2000, step=4).collect()
    want = sorted((r.doc_id, len((r.text or "").encode())) for r in docs.collect() if r.doc_id is not None)
    assert sorted((r.doc_id, r.n_bytes) for r in rows if r.doc_id is not None) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for name, m in by.items():
        assert {(r.shard_bytes, r.shard_docs) for r in m} == {(sum(r.n_bytes for r in m), len(m))}
        assert m[0].oversize == (m[0].shard_bytes > 2000) and (not m[0].oversize or len(m) == 1)
        assert m[0].oversize or len(name) == 1 + m[0].depth
    names = {n for n in by if n[0] == "b"}
    for n in names:  # no shard is another's prefix, and siblings together would not fit
        assert not any(o != n and o.startswith(n) for o in names)
        if len(n) > 1:
            assert sum(r.n_bytes for o in names if o.startswith(n[:-1]) for r in by[o]) > 2000


def test_empty(no_docs):
    assert sharding.shards(no_docs).count() == 0


def test_names_depend_on_the_documents_alone_and_sql_gives_the_same(spark):
    import duckdb

    rows = [(k, f"{k} " * (1 + k * 7 % 90) if k % 11 else None) for k in range(400)] + [(None, "x" * 3000), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in sharding.shards(docs.repartition(7), limit=700).collect()), key=str)
    assert got == sorted((tuple(r) for r in sharding.shards(docs.coalesce(1), limit=700, step=10).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(sharding.sql(700)).fetchall(), key=str)
    assert len({r[2] for r in got}) > 50 and {r[3] for r in got if not r[6]} >= {6, 7}


def test_a_hot_group_of_equal_rows_splits_by_row(spark):
    docs = spark.createDataFrame([(None, "z" * 50)] * 300 + [(1, "a")], "doc_id long, text string")
    rows = sharding.shards(docs, limit=200).collect()
    assert len(rows) == 301 and max(r.shard_bytes for r in rows) <= 200 and not any(r.oversize for r in rows)
