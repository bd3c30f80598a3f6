import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from sparkrel.llm import components, jaccard_join as j


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def root_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_sets(sets):
    return root_of(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
    return w


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 10**6))
def test_group_equals_all_pairs(seed):
    rng = random.Random(seed)
    sets = []
    for base in range(rng.randrange(1, 4)):
        words = [f"{base if rng.random() < 0.6 else 0}w{i}" for i in range(rng.choice([6, 40, 90]))]
        sets += [shingle_set(" ".join(edited(rng, words, rng.randrange(9))[: rng.randrange(5, 95)])) for _ in range(rng.randrange(1, 14))]
    sets = list({frozenset(s): s for s in sets}.values())
    hashed = [np.array(sorted(hash(t) & (2**63 - 1) for t in s), np.uint64) for s in sets]
    a, b = j.join_group(hashed)
    assert root_of(len(sets), zip(a.tolist(), b.tolist())) == brute_sets(sets)


def corpus(rng):
    texts = []
    passage = " ".join(f"p{i}" for i in range(60))
    for base in range(6):
        words = [f"{base}w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 150]))]
        texts += [" ".join(edited(rng, words, rng.randrange(8))) for _ in range(25)]
        texts += [f"{passage} " + " ".join(f"{base}x{rng.randrange(1000)}" for _ in range(rng.choice([5, 14, 80]))) for _ in range(10)]
    return texts


@pytest.mark.parametrize("block", [256, 8])
def test_against_brute_force(spark, odd_docs, block):
    texts = corpus(random.Random(3))
    docs = odd_docs.filter("doc_id is not null").select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: r[0])
    sets = [shingle_set(t) for _, t in rows]
    roots = brute_sets(sets)
    want = {(i, len(s), rows[r][0]) for (i, _), s, r in zip(rows, sets, roots)}
    got = [tuple(r) for r in j.jaccard_components(spark, docs, block=block).collect()]
    assert len(got) == docs.count() and set(got) == want


def test_links_through_null_and_shared_ids(spark):
    def family(name, lo, hi):
        """100 words, those before lo and from hi on altered; the shift between neighbours keeps only these similar."""
        return " ".join(f"{name}{i}" if lo <= i < hi else f"{name}x{i}y{lo}y{hi}" for i in range(100))

    rows = [(1, family("a", 8, 100)), (None, family("a", 0, 100)), (None, family("a", 0, 100)), (2, family("a", 0, 92))]
    rows += [(9, family("b", 8, 100)), (7, family("b", 0, 100)), (3, family("c", 8, 100)), (7, family("c", 0, 100)), (5, family("c", 0, 92))]
    rows += [(40, family("d", 8, 100)), (6, family("d", 0, 100)), (6, family("d", 0, 92)), (41, family("d", 0, 92) + " end"), (None, "alone without a name"), (None, None), (8, "")]
    sets = [shingle_set(t) for _, t in rows]
    roots = brute_sets(sets)
    low = {r: min((i for (i, _), x in zip(rows, roots) if x == r and i is not None), default=None) for r in roots}
    want = [(i, len(s), low[r]) for (i, _), s, r in zip(rows, sets, roots)]
    got = [tuple(r) for r in j.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (2, 96, 1) in got and (5, 96, 3) in got and (9, 96, 7) in got


def test_a_family_is_compared_in_proportion_to_its_size(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, words, 1)) for _ in range(600)] + [" ".join(f"f{k}y{i}" for i in range(20)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = spark.sparkContext.accumulator(0)
    plain = j.verify

    def counting(num, den):
        part = plain(num, den)

        def counted(key, table):
            met.add(table.num_rows)
            return part(key, table)

        return counted

    j.verify = counting
    try:
        got = j.jaccard_components(spark, docs, block=16).collect()
    finally:
        j.verify = plain
    sets = [shingle_set(t) for t in texts]
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(brute_sets(sets)))
    assert met.value < 20 * len(texts)


def test_null_id_and_empty(spark, odd_docs, no_docs):
    assert j.jaccard_components(spark, no_docs).count() == 0
    assert j.jaccard_components(spark, odd_docs).count() == odd_docs.count()


@pytest.mark.parametrize("task_links", [10**6, 20])
def test_components(spark, task_links):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long"), task_links).collect()}
    nodes = sorted({x for p in links for x in p})
    want = root_of(400, links)
    assert got == {x: want[x] for x in nodes}
