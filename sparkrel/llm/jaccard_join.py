"""Exact n-gram Jaccard join by set-relation skipping.

A document's set holds the hashes of its distinct 5-word shingles. Equal sets
are one class from the start, and only classes are joined.

Candidates come from prefix filtering: under one global order of shingles two
sets with similarity 0.8 or more share one of their first n - ceil(0.8 n) + 1.
The order puts shingles that are frequent last (what a passage shares that
many documents hold thus generates no candidates), by counts that every task
takes over all its documents; which of them rank is only a matter of speed,
as any order is exact. The table of ranks is bounded, so it is broadcast. Each
shingle's index list names one member as its reference, and the sets of one
reference form a family group: two sets that share a prefix shingle share a
group.

Inside a group relations between sets save the work:

* index level: members are numbered by size, so every index list is in order
  of size and a probe skips, by position, the blocks of a list whose sizes
  can't reach the threshold;
* answer level: a set's answers follow incrementally from those of a highly
  similar one. The reference's intersection with every member is counted
  once; another member's is that answer corrected by the shingles in which it
  differs from the reference, so only these are looked up. Members that the
  reference's answers link already are never compared with each other.

Groups of more than ``block`` members are split into blocks, each compared
together with the group's reference. Members that this leads to the reference
are done with each other: only the others, the open ones, are compared with the
members of other blocks, in pairs of blocks. So a family of copies of one text
takes work in proportion to its size. Only links that join something are kept,
as one star for each component and task.

Defined results: a null text or one without words has the empty set and links
with nothing; fewer than five words are one shingle; texts with equal sets
link whatever their order; repeated rows give one result row each; extra
columns are ignored; an empty table gives no row. Rows with a null id are
compared like others and take the smallest id that is not null. Different
texts under one id are compared each, and are not linked by the id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix64, prefix_hash, release, span_hash, word_spans
from .components import components, forest
from .shared import bounded_batches, keep

WIDTH = 5
#: The threshold as a ratio of integers, 4/5.
NUM, DEN = 4, 5
RANKED = 1 << 17
CHUNK = 2_000_000
BLOCK = 256
#: Keys of sets that a task remembers, to give the rows of copies once.
SEEN = 50_000
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

IS_WORD = np.ones(256, bool)
IS_WORD[9:14] = IS_WORD[32] = False
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every document's distinct shingles, in order of both."""
    s, e = word_spans(block.data, block.starts, IS_WORD)
    words = span_hash(prefix_hash(block.data), s, e)
    doc = np.searchsorted(block.starts, s, "right") - 1
    first = np.searchsorted(doc, np.arange(len(block) + 1))
    n = np.diff(first)
    hashes, docs = [], []
    with np.errstate(over="ignore"):
        for w in range(1, width + 1):
            at = np.flatnonzero(doc[: len(doc) - w + 1] == doc[w - 1 :]) if w == width and len(doc) >= w else first[:-1][n == w] if w < width else np.zeros(0, np.int64)
            h = np.full(len(at), w, np.uint64)
            for k in range(w):
                h = h + words[at + k] * _STEP[k % len(_STEP)] + np.uint64(k // len(_STEP))
            hashes.append(mix64(h))
            docs.append(doc[at])
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def set_keys(docs: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys of each document's set, and its size."""
    first = np.searchsorted(docs, np.arange(n + 1))
    keys = []
    with np.errstate(over="ignore"):
        for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(salt)))])
            keys.append(mix64(total[first[1:]] - total[first[:-1]]).view(np.int64))
    return keys[0], keys[1], np.diff(first)


def summarise(width: int):
    """Rows (kind, a, b, c, n): kind 0 a document (id, keys, size); kind 1 a shingle (hash) that several documents of a chunk hold (n)."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h, n = h[n >= 4], n[n >= 4]
            zero = pa.array(np.zeros(len(h), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.array(h.view(np.int64)), zero, zero, pa.array(n.astype(np.int64))], names=["kind", "a", "b", "c", "n"])

        for block in blocks(batches):
            d, h = shingles(block, width)
            k1, k2, n = set_keys(d, h, len(block))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(block), np.int32)), block.ids, pa.array(k1), pa.array(k2), pa.array(n.astype(np.int64))], names=["kind", "a", "b", "c", "n"])
            held.append(h)
            size += len(h)
            if size > CHUNK:
                yield frequent()
                held, size = [], 0
        if held:
            yield frequent()

    return part


def prefixes(ranks, width: int, num: int, den: int):
    """Rows (token, key, place) for the extended prefix of each document's set under the global order.

    place is four times the set's size, plus 2 within the prefix itself, plus 1
    where the token stands so early that the set can be the smaller one of a
    pair whose first common token it is.
    """

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, level = ranks.value
        seen = np.zeros(0, np.int64)  # keys whose rows this task gave already: copies are dropped before the shuffle
        for block in blocks(batches):
            d, h = shingles(block, width)
            k1, _, n = set_keys(d, h, len(block))
            fresh = np.zeros(len(block), bool)
            fresh[np.unique(k1, return_index=True)[1]] = True
            fresh &= ~np.isin(k1, seen)
            seen = np.concatenate([seen, k1[fresh]])[-SEEN:]
            rank = np.zeros(len(h), np.int8)
            if len(tokens) and len(h):
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                rank = np.where(tokens[at] == h, level[at], 0).astype(np.int8)
            order = np.lexsort((h, rank, d)) if rank.any() else np.arange(len(h))
            first = np.searchsorted(d, np.arange(len(block)))
            length = n - -(-num * n // den) + 1
            place = np.arange(len(h)) - first[d]
            early = n - -(-2 * num * n // (num + den)) + 1
            at = np.flatnonzero((place < extended(n, num, den)[d]) & fresh[d])
            take, of = order[at], d[at]
            yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(k1[of]), pa.array(4 * n[of] + 2 * (place[at] < length[of]) + (place[at] < early[of]))], names=["token", "key", "place"])

    return part


def extended(n, num: int, den: int):
    """Length of the extended prefix of a set of n: a tenth longer than the prefix, so that a similar set shares more than a third of it."""
    return np.minimum(n, n - -(-num * n // den) + 1 + n // 10)


def _lists(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """(token, key, place) of a partition without repeats, each list in order of size, early members first among equals."""
    held = [tuple(c.to_numpy() for c in b.columns) for b in batches]
    token, key, place = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((key, 3 - place % 4, place // 4, token))
    token, key, place = token[order], key[order], place[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    return token[new], key[new], place[new]


def shared_tokens(num: int, den: int):
    """The rows of a partition's lists whose token another set of a compatible size has too."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, key, place = _lists(batches)
        size = place // 4
        pair = (token[1:] == token[:-1]) & (den * size[:-1] >= num * size[1:])
        ok = np.concatenate([pair, [False]]) | np.concatenate([[False], pair]) if len(token) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(token[ok]), pa.array(key[ok]), pa.array(place[ok])], names=["token", "key", "place"])
        release()

    return part


def references(num: int, den: int):
    """Index lists of a partition's tokens, each in order of size and cut where sizes are too far apart; a list's members relate to its smallest key.

    A member stays only if some pair of it passes the filters: sizes within
    the threshold's ratio, and the token early enough in the smaller set.
    """

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, key, place = _lists(batches)
        if not len(token):
            return
        size, early = place // 4, place % 2 == 1
        n = len(token)
        start = np.ones(n, bool)
        start[1:] = token[1:] != token[:-1]
        # The largest early member before each one in its list, and the next member of any kind.
        last = np.maximum.accumulate(np.where(early, np.arange(n), -1))
        before = np.concatenate([[-1], last[:-1]])
        ok = (before >= np.maximum.accumulate(np.where(start, np.arange(n), 0))) & (den * size[before] >= num * size)
        ok[:-1] |= early[:-1] & ~start[1:] & (den * size[:-1] >= num * size[1:])
        token, key, size = token[ok], key[ok], size[ok]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (den * size[:-1] < num * size[1:])
        if not len(token):
            return
        at = np.flatnonzero(new)
        lead = np.minimum.reduceat(key, at)[np.cumsum(new) - 1]
        pair = np.unique(np.stack([lead, key], 1)[lead != key], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["ref", "key"])
        release()

    return part


class Index:
    """Inverted lists over numbered sets; numbers grow with the sets' sizes, so do the numbers in a list."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray):
        order = np.lexsort((owner, tokens))
        self.tokens, self.owner = tokens[order], owner[order]

    def counts(self, probe: np.ndarray, low: int, high: int, n: int) -> np.ndarray:
        """Shared tokens with each set numbered in [low, high); other blocks of the lists are skipped by position."""
        a, b = np.searchsorted(self.tokens, probe), np.searchsorted(self.tokens, probe, "right")
        a, b = a[a < b], b[a < b]
        if not len(a):
            return np.zeros(n, np.int64)
        size = b - a
        if high - low < n // 2:
            at = [self.owner[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            at = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in at]
            return np.bincount(np.concatenate(at), minlength=n)
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=n)


def similar(inter: np.ndarray, x, y, num: int, den: int) -> np.ndarray:
    return den * inter >= num * (x + y - inter)


def join_group(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Links (as numbers of sets) that join the same components as all pairs with similarity num/den or more would."""
    n = len(sets)
    by_size = np.array(sorted(range(n), key=lambda i: len(sets[i])), np.int64)
    sets = [sets[i] for i in by_size]
    size = np.array([len(s) for s in sets], np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    left, right = [], []
    label = np.arange(n)

    def link(i: int, others: np.ndarray) -> None:
        others = others[label[others] != label[i]]
        if len(others):
            left.append(np.full(len(others), i))
            right.append(others)
            gone = np.unique(np.append(label[others], label[i]))
            label[np.isin(label, gone)] = gone[0]

    def window(i: int) -> tuple[int, int]:
        """Numbers of the sets whose size can reach the threshold with set i."""
        return int(np.searchsorted(size, -(-num * size[i] // den))), int(np.searchsorted(size, den * size[i] // num, "right"))

    far, border = np.arange(n), np.zeros(0, np.int64)
    while len(far):
        here = np.concatenate([far, border])
        ref = int(far[len(far) // 2])
        mine = sets[ref]
        picked = np.zeros(n, bool)
        picked[here] = True
        part = picked[owner]
        t, o = tokens[part], owner[part]
        at = np.minimum(np.searchsorted(mine, t), len(mine) - 1)
        hit = mine[at] == t
        common = np.bincount(o[hit], minlength=n)
        near = picked & (2 * common >= size + size[ref] - common)
        linked = picked & similar(common, size, size[ref], num, den)
        link(ref, np.flatnonzero(linked))
        # Tokens of near members that the reference lacks, and the reference's that they lack: all that tells them from it.
        members = np.flatnonzero(near)
        rest = members[~linked[members]]
        if len(rest):
            keep_extra = near[o] & ~hit
            extra_t, extra_o = t[keep_extra], o[keep_extra]
            has = np.zeros((len(mine), len(members)), bool)
            number = np.full(n, -1)
            number[members] = np.arange(len(members))
            both = near[o] & hit
            has[at[both], number[o[both]]] = True
            lack_t, lack_o = np.nonzero(~has)
            index = Index(np.concatenate([extra_t, mine[lack_t]]), np.concatenate([extra_o, members[lack_o]]))
            delta_o = np.concatenate([extra_o, members[lack_o]])
            delta_t = np.concatenate([extra_t, mine[lack_t]])
            order = np.argsort(delta_o, kind="stable")
            delta_t, first = delta_t[order], np.searchsorted(delta_o[order], np.arange(n + 1))
            delta = np.diff(first)
            for i in rest.tolist():
                low, high = window(i)
                shared = index.counts(delta_t[first[i] : first[i + 1]], low, high, n)
                inter = (size[i] + size - (delta[i] + delta - 2 * shared)) // 2
                ok = near & similar(inter, size[i], size, num, den)
                ok[:low] = ok[high:] = False
                ok[i] = False
                link(i, np.flatnonzero(ok))
        # d = 1 - similarity is a metric: only members with d > 0.5 - 0.2 from the reference can be similar to one outside.
        edge = near & (den * 2 * common <= (2 * den - 3 * (den - num) + 1) * (size + size[ref] - common))
        far = far[~near[far]]
        border = np.union1d(border, np.flatnonzero(edge))
    if len(border) > 1:
        inside = np.zeros(n, bool)
        inside[border] = True
        index = Index(tokens[inside[owner]], owner[inside[owner]])
        for i in border.tolist():
            low, high = window(i)
            shared = index.counts(sets[i], low, high, n)
            ok = inside & similar(shared, size[i], size, num, den)
            ok[:low] = ok[high:] = False
            ok[i] = False
            link(i, np.flatnonzero(ok))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return by_size[np.concatenate(left)], by_size[np.concatenate(right)]


def verify(num: int, den: int):
    """Links (a, b) between the keys of a group's block, as stars; with open, also (reference, key) of each member that they don't lead to the reference."""

    def part(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, at = np.unique(table.column("key").to_numpy(), return_index=True)
        col = table.column("hashes").combine_chunks() if table.column("hashes").num_chunks != 1 else table.column("hashes").chunk(0)
        flat, offs = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
        sets = [flat[offs[i] : offs[i + 1]] for i in at.tolist()]
        a, b = join_group(sets, num, den) if len(sets) > 1 else (np.zeros(0, np.int64),) * 2
        if len(a):
            a, b = forest(keys[a], keys[b])
        ref, left = key[0].as_py(), keys[:0]
        if table.column("k")[0].as_py() > 1:
            # a holds every linked node, its component's smallest one beside it.
            mine = b[a == ref]
            done = a[b == mine[0]] if len(mine) else keys[:0]
            left = np.setdiff1d(keys, np.append(done, ref))
        return pa.table({"a": pa.array(np.append(a, np.full(len(left), ref)), pa.int64()), "b": pa.array(np.append(b, left), pa.int64()), "open": pa.array(np.arange(len(a) + len(left)) >= len(a))})

    return part


def full_sets(width: int):
    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            d, h = shingles(block, width)
            k1, _, n = set_keys(d, h, len(block))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["key", "hashes"])

    return part


def bounded(ids: DataFrame) -> DataFrame:
    """ids, written once, for a semi join: broadcast up to BROADCAST_IDS."""
    ids = keep(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")


def jaccard_components(spark: SparkSession, docs: DataFrame, *, width: int = WIDTH, num: int = NUM, den: int = DEN, block: int = BLOCK, ranked: int = RANKED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    summary = keep(source.mapInArrow(summarise(width), "kind int, a long, b long, c long, n long"), "sets")
    rows = summary.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("k1"), F.col("c").alias("k2"), "n")
    classes = keep(rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    top = summary.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(ranked).collect()
    tokens = np.array([r.a for r in top], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    level = np.array([r.n.bit_length() for r in top], np.int8)[order] if top else np.zeros(0, np.int8)
    ranks = spark.sparkContext.broadcast((tokens[order], level))

    rows_of = "token long, key long, place long"
    listed = source.mapInArrow(prefixes(ranks, width, num, den), rows_of).repartition("token")
    shared = keep(listed.mapInArrow(shared_tokens(num, den), rows_of), "shared")
    # A similar set lacks at most n - ceil(num/den n) of a set's tokens, so the rest of its extended prefix is shared.
    n, lacks = F.expr("place div 4"), F.expr(f"place div 4 - ((place div 4) * {num} + {den - 1}) div {den}")
    needed = F.least(n, lacks + 1 + F.expr("place div 4 div 10")) - lacks
    likely = shared.select("key", needed.alias("needed")).groupBy("key").agg((F.count(F.lit(1)) >= F.max("needed")).alias("enough")).filter("enough").select("key")
    relisted = shared.filter("place % 4 >= 2").join(likely, "key", "left_semi").select("token", "key", "place").repartition("token")
    pairs = keep(relisted.mapInArrow(references(num, den), "ref long, key long").distinct(), "pairs")
    members = pairs.union(pairs.select("ref", F.col("ref").alias("key")).distinct())
    sizes = keep(pairs.groupBy("ref").agg((F.ceil((F.count(F.lit(1)) + 1) / block)).cast("int").alias("k")), "sizes")
    wanted = keep(members.select("key").distinct().join(classes.select(F.col("k1").alias("key"), "rep"), "key"), "wanted")
    sets_of = "key long, hashes array<long>"
    named = bounded(wanted.filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct())
    sets = source.join(named, "doc_id", "left_semi").mapInArrow(full_sets(width), sets_of)
    nameless = wanted.filter("rep is null").select("key")
    if not nameless.isEmpty():
        sets = sets.union(source.filter("doc_id is null").mapInArrow(full_sets(width), sets_of).join(bounded(nameless), "key", "left_semi").dropDuplicates(["key"]))
    sets = keep(sets, "shingles")

    def compared(placed: DataFrame) -> DataFrame:
        return placed.join(sets, "key").select(*placed.columns, "hashes").groupBy("ref", "i", "j").applyInArrow(verify(num, den), "a long, b long, open boolean")

    # First every block with the reference, then open members with the blocks that they haven't met.
    own = lambda k: F.pmod(F.xxhash64("key"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    sized = pairs.join(sizes, "ref").select("ref", "key", own("k").alias("i"), "k")
    alone = sizes.select("ref", F.col("ref").alias("key"), each("k").alias("i"), "k")
    first = keep(compared(sized.unionByName(alone).select("ref", "i", F.lit(-1).alias("j"), "key", "k")), "blocks")
    links = first.filter("not open").select("a", "b")
    left = first.filter("open").select(F.col("a").alias("ref"), F.col("b").alias("key"))
    if not left.isEmpty():
        parts = keep(left.groupBy("ref").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m")).join(sizes, "ref"), "open-parts")
        mine = left.join(parts, "ref").select("ref", "key", own("m").alias("i"), each("k").alias("j"))
        others = pairs.join(parts, "ref").select("ref", "key", each("m").alias("i"), own("k").alias("j"))
        links = links.unionByName(compared(mine.unionByName(others).withColumn("k", F.lit(1))).select("a", "b"))
    roots = components(links)
    # Components are of keys; the smallest id of any of its classes names one.
    rooted = keep(classes.join(roots, classes.k1 == roots.node, "left").select("k1", "k2", F.col("n").alias("_n"), "rep", "root"), "rooted")
    lowest = keep(rooted.filter("root is not null").groupBy("root").agg(F.min("rep").alias("low")), "lowest")
    lowest = F.broadcast(lowest) if lowest.count() <= BROADCAST_IDS else lowest.hint("shuffle_merge")
    named = rooted.join(lowest, "root", "left").select("k1", "k2", "_n", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("low")).alias("component_id"))
    found = rows.join(named.hint("shuffle_merge"), (F.col("n") == F.col("_n")) & (rows.k1 == named.k1) & (rows.k2 == named.k2), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, the one with the smallest id.

    Of rows that repeat an id one stays. Rows without an id can't be named by
    another: of them exact copies go.
    """
    found = keep(jaccard_components(spark, docs, id_col=id_col, text_col=text_col, **options).filter("doc_id is not null"), "components")
    losers = found.filter("component_id != doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    losers = F.broadcast(losers) if losers.count() <= BROADCAST_IDS else losers.hint("shuffle_hash")
    left = docs.filter(F.col(id_col).isNotNull()).join(losers, id_col, "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_col))
    if not again.isEmpty():
        left = left.join(again, id_col, "left_anti").select(*docs.columns).unionByName(left.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col]))
    nameless = docs.filter(F.col(id_col).isNull())
    return left if nameless.isEmpty() else left.unionByName(nameless.dropDuplicates([text_col]))
