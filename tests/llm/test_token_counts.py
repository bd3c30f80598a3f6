from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkrel.llm import token_counts as t

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("rule", t.RULES)
def test_against_offsets(spark, odd_docs, rule):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(200, "a\n\n\n\nb\n"), (201, "x\n \n  \n\ty"), (202, "\n")], "doc_id long, text string"))
    got = defaultdict(list)
    for r in t.token_counts(docs, VOCAB, public_tokenizers.PATTERN, rule=rule).collect():
        got[r.doc_id].append(r)
    for doc_id, text in docs.distinct().collect():
        text = text or ""
        rows = sorted(got[doc_id], key=lambda r: r.section)
        rows = [r for i, r in enumerate(rows) if i == 0 or rows[i - 1].section != r.section]
        lines = text.splitlines(keepends=True) if "\r" not in text else None
        enc = tok.encode(text, add_special_tokens=False)
        assert sum(r.n_tokens for r in rows) == len(enc.ids) == rows[0].doc_tokens
        assert b"".join(text.encode()[r.byte_start : r.byte_end] for r in rows) == text.encode()
        assert [r.n_chars for r in rows] == ([len(x) for x in lines] or [0])
        if rule == "start":
            ends, at = [], 0
            for x in lines or [""]:
                at += len(x)
                ends.append(at)
            want = [0] * len(ends)
            for a, _ in enc.offsets:
                want[next(i for i, e in enumerate(ends) if a < e)] += 1
            assert [r.n_tokens for r in rows] == want


def test_larger_rule():
    import numpy as np

    n, crossing = t.attribute(np.array([3, 6, 10]), np.array([2, 4, 4]), "larger")
    assert n.tolist() == [1, 1, 1] and crossing.tolist() == [0, 1, 0]


def test_empty(no_docs):
    assert t.token_counts(no_docs, VOCAB, public_tokenizers.PATTERN).count() == 0
