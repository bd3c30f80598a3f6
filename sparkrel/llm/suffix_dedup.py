"""Exact removal of repeated substrings, with suffix arrays by linear grouping.

A byte goes if it lies in a 100-byte window whose content also starts earlier
(in a document with a smaller id, or earlier in the same one). Windows are
compared where equal ones can meet: each window names as its anchor the
k-gram with the smallest hash inside it, so equal windows have equal anchors
at equal places. The consecutive windows of one anchor occurrence form a
segment, and segments meet by their anchor's hash.

* Segments with the same content are one class. All its occurrences but the
  earliest go; this collapses copies, however many, before any text moves, and
  within a task, which remembers repeated contents, before any row is shuffled.
* An anchor with a single class is done. For the others, the classes' earliest
  segments are compared by a suffix array of their texts, in four-byte symbols
  aligned to the anchor: equal windows are neighbours in it, and all but the
  earliest go.

The suffix array is built by grouping suffixes by their Lyndon prefixes.
Groups are processed in descending order; pointers to the previous suffix of a
smaller group tell which suffixes' prefixes grow by the current group's, and
by how many copies of it. A last pass emits each group's order: every suffix,
in order, places the one before it, and those that its previous-smaller
pointers lead to, at its group's next free place. No recursion, no renaming.

An anchor with more than ``classes`` classes sends each window by its own hash
instead of its segment (the exact way for the rest).

Defined results: a null or empty text has no bytes; shorter texts than a window
lose nothing; a null id comes after all others; extra columns are ignored; an
empty table gives no row. Matches never cross documents, and windows are
judged on the input. Different texts under one id, or without one, are
documents of their own that follow each other by the hashes of their texts;
rows alike in id and text are judged once and give a result each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BYTE_CODES, Block, blocks, mix64, prefix_hash, release, span_hash, text_buffers
from .shared import bounded_batches, keep

LENGTH = 100
ANCHOR = 32
CLASSES = 2000
#: Bytes of text for one suffix array.
ARRAY_BYTES = 400_000
#: Bytes in one symbol of a suffix array.
SYMBOL_BYTES = 4
BROADCAST_IDS = 1_000_000
LAST_ID = (1 << 63) - 1
#: Contents of repeated segments that a task remembers.
SEEN = 200_000


def suffix_array(text) -> list[int]:
    """Suffix array of a sequence of small non-negative integers, in time linear in its length."""
    n = len(text) + 1
    symbols = np.append(np.asarray(text, np.int64) + 1, 0)
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols)
    starts = np.cumsum(counts) - counts
    sa: list[int] = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at: list[int] = place.tolist()  # where a suffix stands in sa
    group: list[int] = starts[symbols].tolist()  # start of its group there
    size = [0] * n
    for s, c in zip(starts.tolist(), counts.tolist(), strict=True):
        if c:
            size[s] = c
    prev = [-1] * n
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        grown: dict[int, int] = {}
        for s in sorted(sa[start:end]) if end - start > 1 else (sa[start],):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                grown[p] = grown.get(p, 0) + 1
        end = start
        if not grown:
            continue
        # Suffixes whose prefix grows leave their groups at the upper end, those with most copies first.
        most = max(grown.values())
        for copies in range(most, 0, -1):
            leave: dict[int, int] = {}
            chosen = grown if most == 1 else [p for p, k in grown.items() if k == copies]
            for p in chosen:
                g = group[p]
                k = leave.get(g, 0) + 1
                leave[g] = k
                to = g + size[g] - k
                other, old = sa[to], at[p]
                sa[to], sa[old] = p, other
                at[p], at[other] = to, old
            new = {g: g + size[g] - k for g, k in leave.items()}
            for p in chosen:
                group[p] = new[group[p]]
            for g, k in leave.items():
                size[g] -= k
                size[new[g]] = k
    free = list(range(n))  # next free place of the group that starts there
    done = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = prev[s]
    return out[1:]


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash in each run of width consecutive ones, the leftmost among equals."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(key) // width) + 1
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def segments(data: np.ndarray, starts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document number, first window, windows, anchor's place in it, anchor hash, content hash) of each anchor occurrence; positions in data."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    h = prefix_hash(data, BYTE_CODES)
    grams = np.arange(len(data) - anchor + 1)
    first = window_minima(span_hash(h, grams, grams + anchor), length - anchor + 1)
    p = np.arange(len(first))
    doc = np.searchsorted(starts, p, "right") - 1
    ok = p + length <= starts[doc + 1]
    p, first, doc = p[ok], first[ok], doc[ok]
    if not len(p):
        return none
    new = np.ones(len(p), bool)
    new[1:] = (first[1:] != first[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(p)))
    lo, a = p[at], first[at]
    content = mix64(span_hash(h, lo, lo + n - 1 + length) ^ (mix64((a - lo).astype(np.uint64))))
    return doc[at], lo, n, a - lo, span_hash(h, a, a + anchor) >> np.uint64(64 - ANCHOR_BITS), content


#: A segment's first window, number of windows and anchor's place in one number.
PACK = 1 << 10
SEGMENTS = "anchor long, content long, doc_id long, variant long, place long"
#: An anchor's hash is cut to so many bits; where two anchors meet by that, their segments still differ.
ANCHOR_BITS = 44
#: Bytes of text within which a task drops copies of segments before the shuffle.
STRETCH = 8 << 20
SPANS = "doc_id long, variant long, lo long, hi long"


def names(ids: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and variant of documents."""
    return ids.field(0).to_numpy(), ids.field(1).to_numpy()


def after(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether segments (doc_id, variant, place) stand after others."""
    return (x[0] > y[0]) | (x[0] == y[0]) & ((x[1] > y[1]) | (x[1] == y[1]) & (x[2] > y[2]))


class Remembered:
    """A bounded number of repeated contents with an early segment (doc_id, variant, place) of each, the latest ones met."""

    def __init__(self, most: int = SEEN):
        self.most = most
        self.content = np.zeros(0, np.int64)
        self.early = (self.content,) * 3

    def find(self, content: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(whether a content is remembered, its early segment)."""
        if not len(self.content):
            return np.zeros(len(content), bool), (np.zeros(len(content), np.int64),) * 3
        at = np.minimum(np.searchsorted(self.content, content), len(self.content) - 1)
        return self.content[at] == content, tuple(x[at] for x in self.early)

    def add(self, content: np.ndarray, early: tuple[np.ndarray, ...]) -> None:
        """Remembers these distinct contents, in place of what is known of them."""
        keep_old = np.flatnonzero(~np.isin(self.content, content))[: max(0, self.most - len(content))]
        joined = np.concatenate([content[: self.most], self.content[keep_old]])
        order = np.argsort(joined)
        self.content = joined[order]
        self.early = tuple(np.concatenate([x[: self.most], y[keep_old]])[order] for x, y in zip(early, self.early, strict=True))


def find_segments(length: int, anchor: int, stretch_bytes: int = STRETCH):
    """Segments of a task's documents. Of those with one content only early ones must meet others: the rest are marked (their anchors are negative, and any partition will do), so copies don't pile up at one anchor."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        known = Remembered()

        def stretch() -> pa.RecordBatch:
            a, c, doc, variant, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, variant, doc, c, a))
            a, c, *where = (x[order] for x in (a, c, doc, variant, place))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            # A group's earliest segment is its own first one, or the remembered one.
            hit, old = known.find(c[at])
            own = tuple(x[at] for x in where)
            early = tuple(np.where(hit & after(own, old), x, y) for x, y in zip(old, own, strict=True))
            again = after(where, tuple(x[group] for x in early))
            repeated = hit | (np.bincount(group, again, len(at)) > 0)
            known.add(c[at][repeated], tuple(x[repeated] for x in early))
            doc, variant, place = where
            spread = (mix64(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ place.view(np.uint64)) >> np.uint64(20)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.where(again, -1 - spread, a)), pa.array(np.where(again, 0, c)), pa.array(doc), pa.array(variant), pa.array(place)], names=["anchor", "content", "doc_id", "variant", "place"])

        for block in blocks(batches, max_bytes=1 << 19):
            for offset, data, starts, ids in pieces(block, length):
                doc, lo, n, off, a, c = segments(data, starts, length, anchor)
                ids, variants = names(ids)
                held.append((a.view(np.int64), c.view(np.int64), ids[doc], variants[doc], ((lo - starts[doc] + offset) * PACK + n) * PACK + off))
                size += len(data)
            if size > stretch_bytes:
                yield stretch()
                held, size = [], 0
        if held:
            yield stretch()

    return part


def pieces(block: Block, length: int, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """A block as it is, or a single longer document in pieces that overlap by length - 1 bytes, so that every window lies in one."""
    if len(block.data) <= most or len(block) > 1:
        yield 0, block.data, block.starts, block.ids
        return
    for at in range(0, max(1, len(block.data) - length + 1), most):
        data = block.data[at : at + most + length - 1]
        yield at, data, np.array([0, len(data)]), block.ids


def spans_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["doc_id", "variant", "lo", "hi"])


def collapse(length: int, classes: int):
    """Of a partition's anchors: spans that repeat a whole segment (open = 0), and the earliest segments to compare further (open = 1; 2 for anchors with too many classes)."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not held:
            return
        anchor, content, doc, variant, place = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((place, variant, doc, content, anchor))
        anchor, content, doc, variant, place = anchor[order], content[order], doc[order], variant[order], place[order]
        del order
        marked = anchor < 0
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new = new_anchor.copy()
        new[1:] |= content[1:] != content[:-1]
        number = np.cumsum(new_anchor) - 1
        many = np.bincount(number, new).astype(np.int64)[number]
        rest = new & (many > 1) & ~marked
        again = ~new | marked
        pick = again | rest
        kind = np.where(again, 0, np.where(many > classes, 2, 1))
        yield pa.RecordBatch.from_arrays([pa.array(kind[pick].astype(np.int32)), pa.array(anchor[pick]), pa.array(doc[pick]), pa.array(variant[pick]), pa.array(place[pick])], names=["open", "anchor", "doc_id", "variant", "place"])
        release()

    return part


def cut_texts(length: int):
    """(anchor, doc_id, variant, lo, off, text) for each segment (open, anchor, place) listed beside its document's text."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffers(batch.column(2))
            out: list[tuple] = []
            for d, (i, v, segs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[starts[d] : starts[d + 1]].tobytes()
                for s in segs:
                    lo, n, off = s["place"] // PACK // PACK, s["place"] // PACK % PACK, s["place"] % PACK
                    if s["open"] == 1:
                        out.append((s["anchor"], i, v, lo, off, raw[lo : lo + n - 1 + length]))
                    else:
                        h, at = prefix_hash(data[starts[d] + lo : starts[d] + lo + n - 1 + length], BYTE_CODES), np.arange(n)
                        out += [(k, i, v, lo + w, 0, raw[lo + w : lo + w + length]) for w, k in enumerate(span_hash(h, at, at + length).view(np.int64).tolist())]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*(pa.int64(),) * 5, pa.binary()), strict=True)], names=["anchor", "doc_id", "variant", "lo", "off", "text"])

    return part


def repeats(texts: list[bytes], off: np.ndarray, doc: np.ndarray, variant: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of every window that an earlier one of these segments equals.

    off: where a segment's anchor stands. Equal windows hold their anchor at
    the same place, so the suffix array is of the texts in blocks of bytes
    that are aligned to the anchor: windows agree where all whole blocks do,
    which makes them neighbours in it, and then the bytes beside the blocks.
    """
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(size) - size
    lead = off % SYMBOL_BYTES
    blocks_in = np.maximum((size - lead) // SYMBOL_BYTES, 0)
    whole = (length - SYMBOL_BYTES + 1) // SYMBOL_BYTES
    beside = length - whole * SYMBOL_BYTES
    first = np.cumsum(blocks_in + 1) - blocks_in - 1  # a separator follows each segment
    symbol = np.zeros(int((blocks_in + 1).sum()), np.int64)
    of = np.repeat(np.arange(len(texts)), blocks_in)
    number = np.arange(len(of)) - np.repeat(np.cumsum(blocks_in) - blocks_in, blocks_in)
    at = base[of] + lead[of] + SYMBOL_BYTES * number
    value = np.zeros(len(of), np.int64)
    for k in range(SYMBOL_BYTES):
        value = (value << 8) | data[at + k]
    symbol[first[of] + number] = np.unique(value, return_inverse=True)[1] + 1
    sa = np.array(suffix_array(symbol), np.int64)
    seg = np.searchsorted(first, sa, "right") - 1
    ok = sa - first[seg] + whole <= blocks_in[seg]
    sa, seg = sa[ok], seg[ok]
    same = np.ones(max(len(sa) - 1, 0), bool)
    for k in range(whole):
        same &= symbol[sa[:-1] + k] == symbol[sa[1:] + k]
    run = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(sa) else sa
    out = []
    for head in range(min(SYMBOL_BYTES, beside + 1)):
        start = lead[seg] + SYMBOL_BYTES * (sa - first[seg]) - head
        ok = (start >= 0) & (start + length <= size[seg])
        r, g, start = run[ok], seg[ok], start[ok]
        rest = np.zeros(len(r), np.uint64)
        for k in [*range(head), *range(head + whole * SYMBOL_BYTES, length)]:
            rest = (rest << np.uint64(8)) | data[base[g] + start + k]
        order = np.lexsort((lo[g] + start, variant[g], doc[g], rest, r))
        r, g, start, rest = r[order], g[order], start[order], rest[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (rest[1:] != rest[:-1])
        out.append((g[~new], start[~new]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def compare(length: int, array_bytes: int):
    """Spans of the segments' windows that repeat an earlier one with the same anchor; several anchors share a suffix array."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(*(b.column(k).to_numpy() for k in range(5)), b.column(5).to_pylist()) for b in batches]
        if not held:
            return
        anchor, doc, variant, lo, off = (np.concatenate([h[k] for h in held]) for k in range(5))
        texts = [t for h in held for t in h[5]]
        order = np.argsort(anchor, kind="stable")
        change = np.flatnonzero(np.diff(anchor[order]) != 0) + 1
        groups = np.split(order, change) if len(order) else []
        pending: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            at = np.concatenate(pending)
            seg, place = repeats([texts[i] for i in at.tolist()], off[at], doc[at], variant[at], lo[at], length)
            start = lo[at[seg]] + place
            return merged_batch(doc[at[seg]], variant[at[seg]], start, start + length)

        for g in groups:
            if len(g) < 2:
                continue
            pending.append(g)
            total += sum(len(texts[i]) for i in g.tolist())
            if total > array_bytes:
                yield flush()
                pending, total = [], 0
        if pending:
            yield flush()
        release()

    return part


def merged_batch(doc: np.ndarray, variant: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Maximal runs of spans, by text."""
    if not len(doc):
        return spans_batch(doc, variant, lo, hi)
    order = np.lexsort((lo, variant, doc))
    doc, variant, lo, hi = doc[order], variant[order], lo[order], hi[order]
    number = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])]))
    # Texts are laid out one after another, far apart, so that one running maximum serves all.
    far = int(hi.max()) + 2
    top = np.maximum.accumulate(hi + number * far)
    at = np.flatnonzero(np.concatenate([[True], lo[1:] + number[1:] * far > top[:-1]]))
    return spans_batch(doc[at], variant[at], lo[at], top[np.append(at[1:] - 1, len(doc) - 1)] - number[at] * far)


def merge_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a partition's spans per document."""
    held = [tuple(c.to_numpy() for c in b.columns) for b in batches]
    if held:
        yield merged_batch(*(np.concatenate(x) for x in zip(*held, strict=True)))


def repeated_spans(spark: SparkSession, source: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, classes: int = CLASSES, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(doc_id, variant, lo, hi): spans of bytes to remove; they may touch or overlap. source: doc_id, variant (no nulls, unique together), text."""
    rows = source.select(F.struct("doc_id", "variant").alias("id"), "text").mapInArrow(find_segments(length, anchor), SEGMENTS).repartition("anchor")
    found = keep(rows.mapInArrow(collapse(length, classes), "open int, anchor long, doc_id long, variant long, place long"), "segments")
    lo, n = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(PACK - 1))
    whole = found.filter("open = 0").select("doc_id", "variant", lo.alias("lo"), (lo + n - 1 + length).alias("hi"))
    wanted = found.filter("open > 0").groupBy("doc_id", "variant").agg(F.collect_list(F.struct("open", "anchor", "place")).alias("segs"))
    texts = source.join(wanted.hint("shuffle_hash"), ["doc_id", "variant"]).select("doc_id", "variant", "text", "segs").mapInArrow(cut_texts(length), "anchor long, doc_id long, variant long, lo long, off long, text binary")
    compared = texts.repartition("anchor").mapInArrow(compare(length, array_bytes), SPANS)
    return whole.unionByName(compared)


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (named: the id as given; doc_id, variant, text) of docs, and the distinct ones among them. variant is 0 for an id of one row, else the hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("named"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = keep(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("shared")), "shared-ids")
    n = shared.count()
    if not n:
        rows = rows.withColumn("variant", F.lit(0).cast("long"))
        return rows, rows
    shared = F.broadcast(shared) if n <= BROADCAST_IDS else shared.hint("shuffle_hash")
    text_hash = F.xxhash64("text")
    rows = rows.join(shared, "doc_id", "left").withColumn("variant", F.when(F.col("shared"), F.when(text_hash == 0, 1).otherwise(text_hash)).otherwise(0).cast("long")).drop("shared")
    once = rows.filter("variant = 0").unionByName(rows.filter("variant != 0").dropDuplicates(["doc_id", "variant"]))
    return rows, once


def deduplicate(spark: SparkSession, docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the bytes kept."""
    if length >= PACK:
        raise ValueError(f"length is below {PACK}")
    bounded_batches(spark)
    source, once = told_apart(docs, id_col, text_col)
    spans = repeated_spans(spark, once, length=length, **options)
    runs = keep(spans.repartition("doc_id", "variant").mapInArrow(merge_spans, SPANS).groupBy("doc_id", "variant").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs")), "runs")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffers(batch.column(1))
            rows = []
            for d, (i, runs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = data[starts[d] : starts[d + 1]].tobytes()
                at, kept, removed = 0, [], 0
                for r in runs or ():
                    kept.append(text[at : r["lo"]])
                    removed += r["hi"] - r["lo"]
                    at = r["hi"]
                rest = b"".join(kept) + text[at:]
                row = (i, len(text), removed, len(runs or ()), hashlib.sha256(rest).hexdigest())
                rows.append((*row, rest) if keep_text else row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + keep_text)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    joined = source.join(F.broadcast(runs) if is_small(runs) else runs.hint("shuffle_hash"), ["doc_id", "variant"], "left").select("named", "text", "runs")
    return joined.mapInArrow(part, out)


def is_small(runs: DataFrame) -> bool:
    """Whether a kept table of runs may be broadcast: by its number of spans."""
    return (runs.agg(F.sum(F.size("runs"))).first()[0] or 0) <= BROADCAST_IDS
