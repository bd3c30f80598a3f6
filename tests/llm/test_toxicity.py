import itertools
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkrel.llm import toxicity as t
from sparkrel.llm.blocks import Block, text_buffers

INSULTS = ["grumbold", "snivelar", "plonkwit"]


def block(texts):
    data, starts = text_buffers(pa.array(texts, pa.large_string()))
    return Block(pa.nulls(len(texts)), data, starts)


def brute_kernel(a, b):
    def features(w):
        out = {}
        s = t.SYMBOL[list(w.encode())].tolist()
        while s and s[0] == 27:
            del s[0]
        s.insert(0, t.BEGIN)
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < t.SPAN and 27 not in (s[i], s[j], s[k]):
                key = (s[i], s[j], s[k])
                out[key] = out.get(key, 0) + t.DECAY ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    n = dot(x, x) * dot(y, y)
    return dot(x, y) / n**0.5 if n else 0.0


def test_kernel_equals_definition():
    words = ["idiot", "i.d.i.o.t", "idiiot", "thing", "café", "ab", "aaaaaa", "x1y2z3", "##idiot", "...", "thidiot"]
    w = t.read_words(block([" ".join(words)]))
    names = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
    got = t.Vectors.of(w.data, w.start, w.end).kernel(w.data, w.start, w.end)
    want = [[brute_kernel(a, b) for b in names] for a in names]
    assert np.allclose(got, want, atol=1e-5)


def test_words_read_long_and_spelt_out():
    w = t.read_words(block(["a b c d e fgh", "x" * 100, None, ""]))
    names = {bytes(w.data[a:b]) for a, b in zip(w.start, w.end)}
    assert b"abcde" in names and b"fgh" in names and b"x" * 32 in names
    assert set(w.doc.tolist()) == {0, 1}


def corpus(rng, n, first=0):
    vocabulary = [a + b + c for a in ("th", "er", "in", "st") for b in ("on", "at", "is", "e") for c in ("ly", "nd", "o", "ra")]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((first + i, " ".join(w).capitalize() + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus(random.Random(1), 600)
    docs = spark.createDataFrame([(i, x, "s", 1) for i, x, _ in rows], "doc_id long, text string, label string, toxic int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(rows[0][0], rows[0][2], 0), (None, 1, 1), (5000, None, 1)], "doc_id long, toxic int, quality int")
    return rows, docs, labels


def test_held_out_accuracy_and_disguises(spark, labelled, odd_docs):
    rows, docs, labels = labelled
    model = t.fit(docs, labels)
    extra = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "Such a g.r.u.m.b.o.l.d and sni*velar"), (901, "p l o n k w i t grumbboldy")], "doc_id long, text string"))
    got = {r.doc_id: r for r in t.toxicity(spark, docs.select("doc_id", "text"), labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.97
    odd = {r.doc_id: r.score for r in t.score(spark, extra, model).collect()}
    assert odd[900] > 0.5 and odd[901] > 0.5
    assert odd[0] == odd[1] == odd[6] < 0.5 and all(0 <= s <= 1 for s in odd.values())


def test_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in t.toxicity(spark, odd_docs, none).collect()} == {0}
    assert t.toxicity(spark, no_docs, none).count() == 0


def test_sample_holds_1500_documents_of_each_class(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    monkeypatch.setattr(t, "train", lambda texts, y, share: (len(texts), int(y.sum())))
    assert t.fit(docs, labels) == (3000, 1500)


def test_remembered_margins_equal_computed_ones(monkeypatch):
    rng = random.Random(2)
    rows = corpus(rng, 200)
    model = t.train([x for _, x, _ in rows], np.array([y for *_, y in rows]), 0.4)
    monkeypatch.setattr(t, "REMEMBERED", 60)
    for k in range(0, 200, 10):
        w = t.read_words(block([x for _, x, _ in rows[k : k + 10]] + ["", "idiot " * 3]))
        assert np.allclose(model.remembered(w), model.margins(w, np.arange(len(w.hash))), atol=1e-4)
        assert len(model.hash) <= 60 and (np.diff(model.hash.astype(float)) > 0).all()


def test_pooled_margin_is_the_mean_of_the_two_best(monkeypatch):
    w = t.read_words(block(["a1 b2 c3 b2", "", "a1", None, "c3 c3"]))
    value = {"a1": 0.5, "b2": 3.0, "c3": -0.2}
    margin = np.array([value[bytes(w.data[a:b]).decode()] for a, b in zip(w.start, w.end)])
    assert t.pooled(margin, w, 5).tolist() == pytest.approx([2.0, t.FLOOR, (0.5 + t.FLOOR) / 2, t.FLOOR, -0.2])


def test_training_holds_little_memory():
    rng = random.Random(4)
    own = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(5, 12)))
    rows = [(" ".join([x, *(own() for _ in range(60))]), y) for _, x, y in corpus(rng, 2000)]
    texts, labels = [x for x, _ in rows], np.array([y for _, y in rows])
    tracemalloc.start()
    try:
        model = t.train(texts, labels, 0.4)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 60e6  # the kernel values of all words with all landmarks took more
    assert ((model.scores(block(texts)) >= 0.5) == labels).mean() > 0.97


def test_words_of_several_blocks_are_those_of_one():
    texts = [x for _, x, _ in corpus(random.Random(5), 40)] + ["a b c d e fgh", "x" * 100, None, ""]
    one, many = t.read_words(block(texts)), t.gathered(block([x]) for x in texts)
    pairs = lambda w: sorted((int(d), bytes(w.data[w.start[k] : w.end[k]]).lower()) for d, k in zip(w.doc, w.word))
    assert pairs(one) == pairs(many) and (one.hash == many.hash).all()
    assert len(t.gathered([]).hash) == 0


def test_kernel_time_is_not_that_of_a_row_of_all_landmarks_for_each_subsequence():
    rng = random.Random(6)
    own = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(5, 12))) for _ in range(n))
    marks, words = (t.read_words(block([own(n)])) for n in (144, 20_000))
    vectors = t.Vectors.of(marks.data, marks.start, marks.end)
    seconds = [[], []]
    table = np.ones((6000, 144), np.float32)
    rows, edges = np.random.default_rng(6).integers(0, 6000, 30 * 20_000), np.arange(0, 30 * 20_000, 30)
    for _ in range(3):
        for i, f in enumerate((lambda: vectors.kernel(words.data, words.start, words.end), lambda: [np.add.reduceat(table[rows[k : k + 30_000]], edges[:1000], axis=0) for k in range(0, len(rows), 30_000)])):
            began = time.process_time()
            f()
            seconds[i].append(time.process_time() - began)
    assert min(seconds[0]) < 2 * min(seconds[1]), seconds  # it was four times that, with such rows


def test_pooled_equals_sorted_margins():
    rng = random.Random(7)
    w = t.read_words(block([" ".join(rng.choices(["a1", "b2", "c3", "d4", "x" * 90], k=rng.randrange(6))) for _ in range(300)]))
    margin = np.random.default_rng(7).normal(0, 2, len(w.hash))
    best = [sorted([min(margin[k], t.CEILING) for k in w.word[w.doc == d]], reverse=True) + [t.FLOOR] * 2 for d in range(300)]
    assert np.allclose(t.pooled(margin, w, 300), [sum(b[:2]) / 2 for b in best])
