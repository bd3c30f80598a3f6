"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are read as words; a pattern is a window of 13 consecutive words of a
benchmark item, or all words of a shorter item. Patterns of one length m are
searched together: a table gives, for each block of B words that occurs in a
pattern, how far the search may move on (any other block lets it move m-B+1
words), the blocks that end patterns lead to a bucket of patterns with that
suffix, and an occurrence counts after the words themselves were compared
with the pattern's. Only about one word in m-B+1 is looked up.

The benchmark is the stated pattern set. Its patterns are read on the driver
in parts of at most ``part_bytes`` of text, so what is broadcast is bounded;
a larger benchmark is searched in several parts, each over all documents, and
the parts' hits are merged per id and text.

Defined results: a null or wordless text has no words and is never
contaminated; a wordless or null item has no window; items with the same text
both count; repeated document rows give one result row each; extra columns
are ignored. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix64, prefix_hash, span_hash, text_buffers, word_spans
from .shared import bounded_batches, keep

WINDOW = 13
PART_BYTES = 4_000_000
LANE = 384
BROADCAST_IDS = 1_000_000

#: Word bytes: 0-9, A-Z (read as a-z), a-z and every byte of a non-ASCII character.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Patterns:
    """Wu-Manber tables for the patterns of one length m (in words)."""

    def __init__(self, m: int, rows: np.ndarray, texts: list[bytes], items: list[np.ndarray]):
        """rows: word hashes, one pattern a row; texts: its words joined by spaces; items: numbers of the items with it."""
        self.m, self.rows, self.texts, self.items = m, rows, texts, items
        self.b = 2 if m > 1 else 1
        ends = range(self.b - 1, m)
        keys = np.concatenate([block_keys(rows[:, j - self.b + 1 : j + 1]) for j in ends])
        shift = np.repeat([m - 1 - j for j in ends], len(rows))
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.keys, self.shift = keys[first], shift[first]
        suffix = block_keys(rows[:, m - self.b :])
        by = np.lexsort((rows[:, 0], suffix))
        self.bucket_keys, self.bucket = suffix[by], by

    def find(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Ends (word numbers) at which a pattern's last block stands; shift tables skip the rest."""
        n = len(words)
        if n < self.m:
            return np.zeros(0, np.int64)
        keys = block_keys(np.stack([words[self.b - 1 - k : n - k] for k in range(self.b - 1, -1, -1)], 1)) if self.b > 1 else block_keys(words[:, None])
        lane = np.arange(self.m - 1, n, LANE)
        pos, stop, found = lane, np.minimum(lane + LANE, n), []
        while len(pos):
            k = keys[pos - self.b + 1]
            at = np.searchsorted(self.keys, k)
            at[at == len(self.keys)] = 0
            shift = np.where(self.keys[at] == k, self.shift[at], self.m - self.b + 1)
            found.append(pos[shift == 0])
            pos = pos + np.maximum(shift, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        ends = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return ends[doc[ends] == doc[ends - self.m + 1]]

    def confirm(self, ends: np.ndarray, words: np.ndarray, text: Iterable) -> tuple[np.ndarray, np.ndarray]:
        """(end, pattern) of true occurrences: the suffix bucket's patterns whose words all equal the text's."""
        if not len(ends):
            return ends, ends
        suffix = block_keys(np.stack([words[ends - k] for k in range(self.b - 1, -1, -1)], 1))
        lo, hi = np.searchsorted(self.bucket_keys, suffix), np.searchsorted(self.bucket_keys, suffix, "right")
        n = hi - lo
        e = np.repeat(ends, n)
        p = self.bucket[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        same = words[e - self.m + 1] == self.rows[p, 0]
        e, p = e[same], p[same]
        same = np.fromiter((text(i, self.m) == self.texts[j] for i, j in zip(e.tolist(), p.tolist(), strict=True)), bool, len(e))
        return e[same], p[same]


def block_keys(cols: np.ndarray) -> np.ndarray:
    """One key for each row of word hashes."""
    key = np.full(len(cols), cols.shape[1], np.uint64)
    for k in range(cols.shape[1]):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) ^ cols[:, k])
    return key


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and document numbers of a block's words."""
    s, e = word_spans(block.data, block.starts, IS_WORD)
    return s, e, span_hash(prefix_hash(block.data), s, e), np.searchsorted(block.starts, s, "right") - 1


def compile_patterns(texts: list[str | None], window: int = WINDOW) -> list[Patterns]:
    """Tables of all windows of these items, by length."""
    data, starts = text_buffers(pa.array(texts, pa.large_string()))
    s, e, h, doc = words_of(Block(pa.nulls(len(texts)), data, starts))
    lower = LOWER[data].tobytes()
    word = [lower[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    by: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    for i in range(len(texts)):
        a, b = int(np.searchsorted(doc, i)), int(np.searchsorted(doc, i, "right"))
        m = min(window, b - a)
        for k in range(a, b - m + 1 if m else a):
            by.setdefault(m, {}).setdefault(b" ".join(word[k : k + m]), (h[k : k + m], set()))[1].add(i)
    return [Patterns(m, np.stack([v[0] for v in d.values()]), list(d), [np.array(sorted(v[1])) for v in d.values()]) for m, d in sorted(by.items())]


def search(block: Block, tables: list[Patterns]) -> Iterator[tuple[int, int, list[tuple[int, int]], set[int]]]:
    """(document number, words, merged hit runs as word numbers, items) for each document of a block."""
    s, e, h, doc = words_of(block)
    lower = None
    hits: dict[int, list] = {}
    items: dict[int, set] = {}

    def text(end: int, m: int) -> bytes:
        return b" ".join(lower[s[k] : e[k]] for k in range(end - m + 1, end + 1))

    for t in tables:
        ends = t.find(h, doc)
        if len(ends) and lower is None:
            lower = LOWER[block.data].tobytes()
        for end, p in zip(*(x.tolist() for x in t.confirm(ends, h, text)), strict=True):
            d = int(doc[end])
            hits.setdefault(d, []).append((end - t.m + 1, end + 1))
            items.setdefault(d, set()).update(t.items[p].tolist())
    first = np.searchsorted(doc, np.arange(len(block) + 1))
    for d in range(len(block)):
        runs: list[tuple[int, int]] = []
        for a, b in sorted(hits.get(d, ())):
            a, b = a - int(first[d]), b - int(first[d])
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        yield d, int(first[d + 1] - first[d]), runs, items.get(d, set())


def benchmark_parts(items: DataFrame, id_col: str, text_col: str, part_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark's ids (as strings) and texts, in parts of bounded size, streamed to the driver."""
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    for i, t in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        n = len((t or "").encode())
        if ids and size + n > part_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    if ids:
        yield ids, texts


OUT = "doc_id long, digest binary, n_words long, runs array<struct<s: long, e: long>>, items array<string>"


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """One row for each document and benchmark part: a digest of the text, words, hit runs of words, items with occurrences; and the number of parts."""
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, n = None, 0

    def scan(ids: list[str], texts: list[str]) -> DataFrame:
        tables = spark.sparkContext.broadcast((ids, compile_patterns(texts, window)))

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, t = tables.value
            for block in blocks(batches):
                found = list(search(block, t))
                yield pa.RecordBatch.from_arrays(
                    [
                        block.ids,
                        pa.array([blake2b(block.data[a:b], digest_size=16).digest() for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True)], pa.binary()),
                        pa.array([x[1] for x in found], pa.int64()),
                        pa.array([[{"s": a, "e": b} for a, b in x[2]] for x in found], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([sorted(names[i] for i in x[3]) for x in found], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "digest", "n_words", "runs", "items"],
                )

        return source.mapInArrow(part, OUT)

    for ids, texts in benchmark_parts(items, item_id_col, item_text_col, part_bytes):
        got = scan(ids, texts)
        out, n = got if out is None else out.unionByName(got), n + 1
    return (scan([], []), 1) if out is None else (out, n)


def merged(parts: Column) -> Column:
    """Words in the union of the parts' runs."""
    number = lambda n: F.lit(n).cast("long")
    step = lambda a, r: F.struct((a.total + F.greatest(number(0), r.e - F.greatest(r.s, a.end))).alias("total"), F.greatest(a.end, r.e).alias("end"))
    return F.aggregate(F.array_sort(F.flatten(parts)), F.struct(number(0).alias("total"), number(0).alias("end")), step, lambda a: a.total)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), items."""
    found, parts = hits(spark, docs, items, **options)
    if parts > 1:
        # Each part gives one row for every document row, so repeated rows stay repeated. Rows of one id and text are alike in each part.
        found = found.groupBy("doc_id", "digest", "n_words").agg(F.collect_set("runs").alias("all"), F.flatten(F.collect_set("items")).alias("items"), (F.count(F.lit(1)) / parts).cast("int").alias("copies"))
        found = found.select("doc_id", "n_words", merged(F.col("all")).alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    else:
        found = found.select("doc_id", "n_words", F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r.e - r.s).alias("n_hit"), "items")
    items_sorted = F.array_sort(F.array_distinct("items"))
    return found.withColumn("items", items_sorted).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items"
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without contaminated ones. Rows that share an id go together; a row without an id stays."""
    found = decontaminate(spark, docs, items, id_col=id_col, **options).filter("contaminated and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    found = keep(found, "contaminated")
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found.hint("shuffle_hash")
    return docs.join(found, id_col, "left_anti").select(*docs.columns)
