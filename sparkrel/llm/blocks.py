"""Arrow record batches as flat UTF-8 byte blocks of bounded size.

Operators that walk whole texts work on a block: the concatenated bytes of a
few documents, and where each document starts. A block closes when it holds
``max_bytes``; a longer document makes a block alone. A null text counts as
empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1_000_000


def release() -> None:
    """Gives freed memory back to the system: workers live on after a task, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


@dataclass
class Block:
    """ids: the id column's slice; data: bytes of all texts; starts: n + 1 offsets into data."""

    ids: pa.Array
    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and its offsets; nulls become empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    starts = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def blocks(batches: Iterable[pa.RecordBatch], id_col: int = 0, text_col: int = 1, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of each batch, in order. Columns are taken by position, so their names may clash."""
    for batch in batches:
        ids, (data, starts) = batch.column(id_col), text_buffers(batch.column(text_col))
        i, n = 0, len(ids)
        while i < n:
            j = int(np.searchsorted(starts, starts[i] + max_bytes, "right")) - 1
            j = min(max(j, i + 1), n)
            yield Block(ids.slice(i, j - i), data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            i = j
    release()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply); every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    done, b = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            step = out[done - 1] * b
            take = min(done, n - done)
            out[done : done + take] = out[:take] * step
            done += take
    return out


BASE = 0x9E3779B97F4A7C15 | 5
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: The same codes with A-Z read as a-z.
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
_pow: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of BASE (or of its inverse), kept between calls up to a few MB; longer ones are made anew."""
    base = BASE_INV if inverse else BASE
    have = _pow.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    made = _powers(base, max(n, 1 << 16))
    if n <= 4_000_000:
        _pow[base] = made
    return made[:n]


def prefix_hash(data: np.ndarray, codes: np.ndarray = LOWER_CODES) -> np.ndarray:
    """H with H[e] - H[s] = hash of data[s:e] times BASE**s, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        with np.errstate(over="ignore"):
            np.cumsum(codes[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of data[start:end], alike wherever equal bytes stand."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * powers(len(prefix), True)[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; none crosses a document's end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    before[edge[:-1]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, w[1:]
    after[edge[1:]] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
