import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from sparkrel.llm import suffix_dedup as s


@given(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.binary(max_size=60)))
def test_suffix_array(text):
    text = list(text)
    assert s.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.lists(st.integers(0, 5), max_size=80), st.integers(1, 12))
def test_window_minima(values, width):
    h = np.array(values, np.uint64) << np.uint64(30)
    want = [min(range(i, i + width), key=lambda j: (values[j], j)) for i in range(len(values) - width + 1)]
    assert s.window_minima(h, width).tolist() == want


def brute(rows, length):
    names = [i for i, _ in set(rows)]

    def place(i, text):
        """Where a text stands: no id last, texts of one id by their hashes."""
        hashed = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return (i is None, i or 0, (hashed if hashed < 1 << 63 else hashed - (1 << 64)) if sum(x == i for x in names) > 1 else 0)

    first = {}
    for i, text in rows:
        t = (text or "").encode()
        for p in range(len(t) - length + 1):
            k = t[p : p + length]
            first[k] = min(first.get(k, (2,)), (*place(i, text), p))
    out = []
    for i, text in rows:
        t = (text or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] != (*place(i, text), p):
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"classes": 3}, {"length": 40, "anchor": 12, "array_bytes": 2000}])
def test_against_brute_force(spark, odd_docs, options):
    rng = random.Random(4)
    texts = []
    base = [" ".join(rng.choice(["stone", "river", "ökonom", "of", "the", "a"]) + str(rng.randrange(50)) for _ in range(90)) for _ in range(4)]
    for _ in range(60):
        t = rng.choice(base)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["X", "", "yy"]) + t[k + 1 :]
        texts.append(t[rng.randrange(200) :] if rng.random() < 0.5 else t + t[: rng.randrange(300)])
    texts += ["ab" * 400, "ab" * 99, "z" * 500, "z" * 99, "z" * 101, base[0] + base[0]]
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, s.deduplicate(spark, docs, **options).collect()), key=str)
    assert got == sorted(brute([tuple(r) for r in docs.collect()], options.get("length", 100)), key=str)


def passages(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop ") for _ in range(140)) for _ in range(n)]


def test_rows_that_share_an_id_lose_only_their_own_bytes(spark):
    p = passages(random.Random(9), 8)
    rows = [(1, p[0]), (None, p[0] + "x"), (None, p[1] + p[2]), (5, p[3]), (5, "y" + p[0]), (5, p[4] * 2), (5, p[4] * 2), (6, p[3] + p[5]), (None, None), (None, ""), (None, p[1] + p[2]), (1 << 62, p[5] + p[6]), (None, p[6] + p[7])]
    rows += [(7, p[7]), (7, p[7] + "tail"), (7, "head" + p[7])]
    got = [tuple(r) for r in s.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 100), key=str)
    assert (None, 280, 0, 0) in {r[:4] for r in got} and sorted(r[2] for r in got if r[0] == 7) == [0, 140, 140]


def test_many_rows_share_ids(spark):
    rng = random.Random(8)
    p = passages(rng, 12)
    rows = [(rng.choice([None, None, 1, 2, 3, rng.randrange(50)]), "".join(rng.sample(p, rng.randrange(1, 4)))[rng.randrange(60) :]) for _ in range(150)]
    rows += rng.choices(rows, k=30)
    got = [tuple(r) for r in s.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 100), key=str)


def test_a_task_remembers_repeated_contents():
    import pyarrow as pa

    p = passages(random.Random(3), 303)
    texts = [p[k % 3] + p[3 + k] for k in range(300)]
    ids = pa.StructArray.from_arrays([pa.array(range(300), pa.int64()), pa.array([0] * 300, pa.int64())], names=["doc_id", "variant"])
    batches = [pa.RecordBatch.from_arrays([ids.slice(k, 10), pa.array(texts[k : k + 10])], names=["id", "text"]) for k in range(0, 300, 10)]
    sent = {size: sum(int((b.column(0).to_numpy() >= 0).sum()) for b in s.find_segments(100, 32, size)(iter(batches))) for size in (1000, 1 << 20)}
    assert sent[1000] == sent[1 << 20] < sum(map(len, texts)) / 25  # as good as one stretch


def test_pieces_cover_all_windows():
    from sparkrel.llm.blocks import Block

    data = np.frombuffer(bytes(random.Random(1).choices(b"abc", k=1000)), np.uint8)
    parts = list(s.pieces(Block(None, data, np.array([0, 1000])), 20, most=64))
    assert all((data[o : o + len(d)] == d).all() for o, d, *_ in parts)
    windows = [o + k for o, d, *_ in parts for k in range(len(d) - 19)]
    assert windows == list(range(981))


def test_repeated_rows_and_empty(spark, odd_docs, no_docs):
    assert s.deduplicate(spark, no_docs).count() == 0
    assert s.deduplicate(spark, odd_docs).count() == odd_docs.count()
