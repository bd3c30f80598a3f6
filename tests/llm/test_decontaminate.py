import hashlib
import re

import pytest

from sparkrel.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    pats = []
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        pats += [(i, tuple(w[k : k + m])) for k in range(len(w) - m + 1 if m else 0)]
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, p in pats:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    names.add(str(name))
        yield (i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))


ITEMS = [(1, " ".join(f"w{i}" for i in range(30))), (2, "Short item"), (3, None), (4, "..."), (10, "Äpfel über alles"), (11, "x " * 20), (12, "Short item"), (5, " ".join(f"w{i}" for i in range(9, 22)))]


@pytest.mark.parametrize("part_bytes", [1 << 20, 20])
def test_against_brute_force(spark, odd_docs, part_bytes):
    long = ITEMS[0][1]
    extra = [(100, f"a b {long.upper()} c"), (101, "SHORT-item"), (102, "shorti tem"), (103, "x " * 13), (104, long[6:50]), (105, " ".join(f"w{i}" for i in range(5, 25))), (106, "pre äpfel"), (107, "Äpfel über, alles! Short item" + " z" * 200), (108, "short item " * 300)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = d.decontaminate(spark, docs, spark.createDataFrame(ITEMS, "item_id long, text string"), part_bytes=part_bytes).drop("items").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute([tuple(r) for r in docs.collect()], ITEMS), key=str)


@pytest.mark.parametrize("part_bytes", [1 << 20, 20])
def test_rows_that_share_an_id_and_a_word_count_are_judged_singly(spark, part_bytes):
    rows = [(i, t) for i in (None, 7) for t in ("short item one", "äpfel über alles", "three clean words", "three clean words", "Short item, one")] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.decontaminate(spark, docs, spark.createDataFrame(ITEMS, "item_id long, text string"), part_bytes=part_bytes).drop("items").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, ITEMS), key=str)


def test_nothing_to_find(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in d.decontaminate(spark, odd_docs, none).collect()} == {0}
    assert d.decontaminate(spark, no_docs, none).count() == 0
