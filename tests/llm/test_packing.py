import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkrel.llm import packing
from sparkrel.llm.blocks import text_buffers

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 50_000))
def test_cuts_cover_and_fit(n):
    got = packing.cuts(n)
    assert sum(got) == n and all(0 < x <= 4096 for x in got)


WORDY = st.text(st.one_of(st.sampled_from("abcEÉé.,.,'st 19\n|<>̈ǅK"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(deadline=None)
@given(st.lists(WORDY, max_size=6))
def test_word_encoder_equals_tokenizer(texts):
    texts += ["<|endoftext|>x", "It's 3.5, ok., (end).", "ab.", ",ab ."]
    t = Tokenizer.from_file(PATH)
    data, starts = text_buffers(pa.array(texts))
    got = packing.encoder(PATH).encode(data, starts)
    for x, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_round_trip(spark, odd_docs):
    t = Tokenizer.from_file(PATH)
    rows = packing.pack(odd_docs, PATH, salt_tokens=2000).collect()
    source = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd_docs.collect()]
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    ids = defaultdict(list)
    for i, x in source:
        ids[i].append(x)
    assert set(by) == set(ids)
    for i, copies in ids.items():
        covered = sorted((r.start, r.length) for r in by[i])
        want = []
        for x in copies:
            want += [(s, n) for s, n in zip(np.cumsum([0, *packing.cuts(len(x))[:-1]]).tolist(), packing.cuts(len(x)), strict=True)]
        assert covered == sorted(want)
        for r in by[i]:
            assert r.doc_tokens == len(copies[0])
            assert r.ids_crc32 == zlib.crc32(np.array(copies[0][r.start : r.start + r.length], "<u4").tobytes())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0


def test_word_encoder_forgets_and_remembers(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 3)
    e, t = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for x in ["one two three four five", "two six", "one seven eight nine ten", "five two one", "six. one,"]:
        data, starts = text_buffers(pa.array([x]))
        assert np.frombuffer(e.encode(data, starts)[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
        assert len(e.older) + len(e.known) <= 14
