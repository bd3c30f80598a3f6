"""Sequence packing by harmonic classes.

A document's token ids are cut into pieces of at most C = ``capacity`` ids. A
piece of length l belongs to class k = C // l, so that C/(k+1) < l <= C/k, and
a bin of class k holds exactly k pieces of that class: bins are filled by
count alone, never by looking at other bins. Each (class, salt) group fills
its bins by itself; salts split a large class, and only each group's last bin
may hold fewer pieces.

Padding stays small because cuts are free: a length is cut greedily at the
largest exact reciprocal floor(C/k) that fits, which fills a bin without
waste, until at most C/16 ids are left; that tail's class wastes less than
1/17 of it.

Defined results: a null or empty text is the single end id; the longest text
is cut like any other; repeated rows are packed each; extra columns are
ignored; an empty table gives no piece.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks
from .shared import bounded_batches, keep

CAPACITY = 4096
END_ID = 2
#: Tokens that one salt of a class holds about; decides the number of salts.
SALT_TOKENS = 1 << 27
#: Words of one generation whose ids a worker remembers; the generation before it stays too.
WORDS = 600_000


_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[48:58] = _IS_ALNUM[97:123] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[9:14] = _IS_SPACE[32] = True


class Known(dict):
    """Ids by word; unknown words are noted and have no ids yet."""

    def __init__(self):
        super().__init__()
        self.missing: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes:
        self.missing.append(word)
        return b""


class WordEncoder:
    """Token ids of whole texts for a lower-casing word tokenizer whose tokens never cross ASCII white space.

    Such a text's ids are its words' ids in turn, so each word is encoded once
    and remembered, in lower case and without a final full stop or comma after
    a letter or digit (a piece of its own to the tokenizer). New words of
    letters alone are encoded in one string: each is one piece, and a piece's
    last token is marked in the vocabulary. A text that may hold a special
    token is encoded as it is. Ids are little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known()
        self.older: dict[bytes, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Ids of each text of a block."""
        collects = gc.isenabled()
        gc.disable()  # words and ids form no cycles, but the collector would look at all of them again and again
        try:
            return self._encode(data, starts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        lower = np.frombuffer(raw.lower(), np.uint8)
        n = len(lower)
        stop = np.flatnonzero((lower == 46) | (lower == 44))
        if n:
            edge = np.zeros(n + 1, bool)
            edge[starts] = True
            stop = stop[(stop > 0) & ~edge[stop]]
            before, two = lower[stop - 1], lower[np.maximum(stop - 2, 0)]
            latin = (two == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)  # a letter of Latin-1
            stop = stop[(_IS_ALNUM[before] | latin) & (edge[stop + 1] | _IS_SPACE[lower[np.minimum(stop + 1, n - 1)]])]
        spaced = np.insert(lower, stop, 32).tobytes()
        at = (starts + np.searchsorted(stop, starts)).tolist()
        split = [spaced[a:b].split() for a, b in zip(at, at[1:], strict=False)]
        known = self.known
        if len(known) > WORDS:
            self.older, self.known = known, Known()
            known = self.known
        out, again = [], []
        for d, words in enumerate(split):
            n = len(known.missing)
            out.append(b"".join(map(known.__getitem__, words)))
            if len(known.missing) > n:
                again.append(d)
        self.learn(set(known.missing))
        known.missing.clear()
        for d in again:
            out[d] = b"".join(map(known.__getitem__, split[d]))
        if b"<|" in raw:
            for d in range(len(out)):
                text = raw[starts[d] : starts[d + 1]]
                if b"<|" in text:
                    out[d] = self.ids(text.decode()).tobytes()
        return out

    def learn(self, new: set[bytes]) -> None:
        whole, rest = [], []
        for w in new:
            if (ids := dict.get(self.older, w)) is not None:
                self.known[w] = ids
                continue
            (whole if (w if w.isascii() else w.decode()).isalpha() else rest).append(w)
        ids = self.ids(b" ".join(whole).decode())
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(whole):
            raw, cut = ids.tobytes(), (ends * 4).tolist()
            self.known.update(zip(whole, [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)], strict=True))
        else:  # the tokenizer's Unicode tables differ from Python's
            rest += whole
        got = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        self.known.update((w, np.array(g.ids, "<u4").tobytes()) for w, g in zip(rest, got, strict=True))


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n ids: exact reciprocals of the capacity, then a tail of at most capacity/16."""
    out = [capacity] * (n // capacity)
    rest, tail = n % capacity, capacity // 16
    while rest > tail:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out + [rest] * (rest > 0)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, with the crc32 of their ids."""
    bounded_batches(docs.sparkSession)
    last = np.array([end_id], "<u4").tobytes()

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for block in blocks(batches):
            ids = enc.encode(block.data, block.starts)
            row, start, length, crc, total = [], [], [], [], []
            for d, x in enumerate(ids):
                x += last
                at, n = 0, len(x) // 4
                for size in cuts(n, capacity):
                    row.append(d)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(x[4 * at : 4 * (at + size)]))
                    total.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(part, OUT)


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, salt_tokens: int = SALT_TOKENS, **options) -> DataFrame:
    """pieces() with sequence_id and offset: its sequence, and where in it a piece starts."""
    cut = keep(pieces(docs, tokenizer_path, capacity=capacity, **options), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    salts = max(1, -(-total // salt_tokens))
    k = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    cut = cut.withColumn("_class", k).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    group = Window.partitionBy("_class", "_salt")
    cut = cut.withColumn("_bin", F.floor((F.row_number().over(group.orderBy("doc_id", "start", "ids_crc32")) - 1) / F.col("_class")).cast("long"))
    inside = Window.partitionBy("_class", "_salt", "_bin").orderBy("doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    number = F.shiftleft(F.col("_class") * salts + F.col("_salt"), 28) + F.col("_bin")
    return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
