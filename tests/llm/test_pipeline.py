import random

import pytest
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute_sets, shingle_set
from test_toxicity import INSULTS, corpus

import corpus_pipeline as cp

TOKEN = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    rows = corpus(rng, 500)
    docs = [(i, t) for i, t, _ in rows]
    item = " ".join(f"bench{k}" for k in range(20))
    docs += [(1000, f"intro words {item} and more"), (1001, f"the token = {TOKEN} ends"), (1002, docs[3][1]), (1003, docs[3][1] + " more words"), (1004, None), (1005, ""), (1006, " ".join(INSULTS)), (None, "nameless row"), (None, "nameless row"), docs[5], (1007, "word " * 9000)]
    df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    clean = cp.drop_toxic(spark, docs, sf_dir)
    before, after = docs.collect(), clean.collect()
    assert clean.columns == columns
    texts = [r.text or "" for r in after]
    assert sum(any(w in t for w in INSULTS) for t in texts) <= 0.02 * len(before)
    assert sum(not any(w in (r.text or "") for w in INSULTS) for r in before) - sum(not any(w in t for w in INSULTS) for t in texts) <= 0.02 * len(before)

    alone = cp.drop_near_copies(spark, clean, sf_dir)
    assert alone.columns == columns
    named = sorted({(r.doc_id, r.text) for r in after if r.doc_id is not None})
    roots = brute_sets([shingle_set(t) for _, t in named])
    got = [(r.doc_id, r.text) for r in alone.collect()]
    assert sorted(x for x in got if x[0] is not None) == [named[i] for i in range(len(named)) if roots[i] == i]
    assert [x for x in got if x[0] is None] == [(None, "nameless row")]

    kept = cp.drop_contaminated(spark, alone, sf_dir)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated(got, items) if r[5]}
    assert bad == {1000} and {r.doc_id for r in kept.collect()} == {x[0] for x in got} - bad

    safe = cp.redact_secrets(spark, kept, sf_dir)
    assert safe.columns == columns and safe.dtypes == docs.dtypes
    was = {r.doc_id: r for r in kept.collect()}
    now = {r.doc_id: r for r in safe.collect()}
    assert now[1001].text == "the [SECRET] ends" and now[1001].n_chars == 17
    assert all(now[i] == was[i] for i in was if i != 1001)

    packed = cp.run(spark, sf_dir)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in packed.select("doc_id").distinct().collect())
    assert ids == sorted((i is None, i or 0) for i in now)


def test_empty(spark, sf_dir, tmp_path):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
