import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        names = set(bare.queries())
        assert names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


@pytest.mark.parametrize("name", ["flagship", "rel_nested3", "distinct_on_multi", "dml_upsert"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    got = sorted(tuple(map(str, r)) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert got == sorted(tuple(str(r[i]) for i in order) for r in cur.fetchall())
