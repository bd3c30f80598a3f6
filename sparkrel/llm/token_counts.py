"""Token counts per section by offset mapping.

A document is encoded once, whole, so its counts are those a model sees. Each
token's span follows from the vocabulary (a byte-level token stands for its
own bytes), and an interval join of the spans with the sections' spans gives
each section its tokens. A token that crosses a boundary goes to one section
by an explicit rule: ``start`` (the section of its first byte), ``end`` (of
its last byte) or ``larger`` (the section with most of its bytes; the first
such one). Counts of a document's sections always add up to its tokens.

Sections are a text's lines, each with the line break that ends it; a text
that ends with a line break has no empty section after it. Defined results: a
null or empty text is one section without tokens; repeated rows give repeated
sections; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks
from .shared import bounded_batches

RULES = ("start", "end", "larger")
OUT = "doc_id long, section long, byte_start long, byte_end long, n_chars long, n_tokens long, n_crossing long, doc_tokens long"


@lru_cache(2)
def encoding(path: str, pattern: str):
    """(tiktoken encoding, bytes of each token), one for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def sections(data: np.ndarray) -> np.ndarray:
    """Ends of a text's sections in bytes."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def attribute(ends: np.ndarray, size: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that cross into or from another; size: the tokens' bytes in order."""
    stop = np.cumsum(size)
    start = stop - size
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    to, crossing = (b if rule == "end" else a).copy(), np.flatnonzero(a != b)
    if rule == "larger":
        for i in crossing.tolist():
            edges = np.concatenate([[start[i]], ends[a[i] : b[i]], [stop[i]]])
            to[i] = a[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(ends)), np.bincount(to[crossing], minlength=len(ends))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, *, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each section of each document: its span, characters, tokens, and how many of these cross a boundary."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    bounded_batches(docs.sparkSession)

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoding(vocabulary, pattern)
        for block in blocks(batches):
            row, cols = [], [[] for _ in range(7)]
            chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            for d in range(len(block)):
                at, to = int(block.starts[d]), int(block.starts[d + 1])
                data = block.data[at:to]
                ends = sections(data)
                ids = np.array(enc.encode_ordinary(data.tobytes().decode()), np.int64)
                n, crossing = attribute(ends, size[ids], rule)
                begins = np.concatenate([[0], ends[:-1]])
                row.append(np.full(len(ends), d))
                for c, x in zip(cols, (np.arange(len(ends)), begins, ends, chars[at + ends] - chars[at + begins], n, crossing, np.full(len(ends), len(ids))), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(np.concatenate(row))), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(part, OUT)
