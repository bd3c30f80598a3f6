"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel of two words is the gap-weighted subsequence kernel: it sums, over
all subsequences of three symbols that span at most six, the product of their
weights ``DECAY ** gaps`` in either word, and is normalised to k(w, w) = 1. An
insult with inserted or missing characters, or with an unseen ending, keeps
most of its subsequences. Symbols are one for a word's beginning, a-z (A-Z
alike), one for digits and 35 for the bytes of other letters; what else stands
in a word only widens gaps, or before its first letter nothing.
The machine's kernel is the eighth power of this one. Words are the texts' runs
of non-space characters; longer ones are read in overlapping pieces, and runs
of single-character words (spelt-out insults) are also read as one word.

Training is multiple-instance: a labelled document is a bag of words. Landmarks are words whose presence goes with the label, thinned by the
kernel, and frequent words of clean documents. A word's features are its
kernel values with the landmarks times the inverse square root of the
landmarks' own kernel matrix (Nystroem), so a linear machine on them is a
kernel machine. The first positives are words that go with the label beyond
chance; then, in turn, the two best words of every toxic document join if the
machine accepts them and they go with the label, the second-best words of clean
documents join as hard negatives, and the squared-hinge problem is solved by
Newton steps. A document's margin is the
mean of its two best words' (margins count up to ``CEILING``), turned into a
probability by a logistic fit.

Every word is scored by the machine. A worker remembers the margins of a
bounded number of words, by their hashes, so a word of many documents is
scored about once.

The sample is bounded and documented: the ``train_docs`` labelled documents of
each class with the smallest hashes among those of at most ``train_bytes``
bytes. Every document is scored, whole.

Defined results: a null, empty or wordless text has the margin ``FLOOR``, hence
a low score, and so has the second word of a text of one; repeated rows are scored alike; repeated labels of a document count
once, the largest; extra columns are ignored; without labels of both classes
every score is the toxic share among the labels (0 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Block, blocks, prefix_hash, release, span_hash, text_buffers, word_spans
from .shared import bounded_batches

SPAN = 6
DECAY = 0.7
PIECE, STRIDE = 32, 16
TRAIN_DOCS = 1500
TRAIN_BYTES = 12_000
#: Bytes of training texts read at once; the driver has little memory.
TRAIN_BLOCK = 1 << 18
LANDMARKS = 96
#: Margin of a word that isn't there.
FLOOR = -1.0
#: Margins of words count up to this, so one sure word is not enough.
CEILING = 2.0
#: Power of the normalised kernel; one of two.
POWER = 8
#: Least margin and association of a best word of a toxic document that joins the positives.
ACCEPT, LIKELY = 0.3, 3.0
#: Words whose margins a worker remembers.
REMEMBERED = 400_000
#: Least association of a first positive word.
SEED = 3.0
#: Positive words that are also learnt in disguise.
SEEDS = 40
#: Weights by the number of symbols left out.
DECAYS = DECAY ** np.arange(SPAN - 2)

IS_WORD = np.ones(256, bool)
IS_WORD[9:14] = IS_WORD[32] = False
BITS = 6
CODES = 1 << 3 * BITS
#: Words whose subsequences are listed at once; their numbers, three symbols and the gaps make 32 bits, so 4096 at most.
AT_ONCE = 2048
SYMBOL = np.full(256, 27, np.int64)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(26)
SYMBOL[48:58] = 26
SYMBOL[128:] = 28 + np.arange(128) % 35
BEGIN = 63


@dataclass
class Words:
    """Distinct words of a block with their hashes, in order of these, and its tokens in order: their documents, word numbers and last bytes."""

    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    at: np.ndarray


def read_words(block: Block) -> Words:
    data = block.data
    s, e = word_spans(data, block.starts, IS_WORD)
    doc = np.searchsorted(block.starts, s, "right") - 1
    single = (e - s) == 1
    if single.any():  # runs of at least four single characters are spelt out
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (single[1:] & single[:-1] & (doc[1:] == doc[:-1])).view(np.int8), [0]])))
        spelt = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 3]
        if spelt:
            more = [data[s[a:b]] for a, b in spelt]
            ends = len(data) + np.cumsum([len(m) for m in more])
            s = np.concatenate([s, ends - [len(m) for m in more]])
            e = np.concatenate([e, ends])
            doc = np.concatenate([doc, doc[[a for a, _ in spelt]]])
            data = np.concatenate([data, *more])
    at = e.copy()
    long = np.flatnonzero(e - s > PIECE)
    if len(long):
        n = -(-(e[long] - s[long] - PIECE) // STRIDE) + 1
        rep = np.repeat(long, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ps = s[rep] + k * STRIDE
        short = np.flatnonzero(e - s <= PIECE)
        s, e, doc, at = np.concatenate([s[short], ps]), np.concatenate([e[short], np.minimum(ps + PIECE, e[rep])]), np.concatenate([doc[short], doc[rep]]), np.concatenate([at[short], at[rep]])
    known, first, word = np.unique(span_hash(prefix_hash(data), s, e), return_index=True, return_inverse=True)
    return Words(known, data, s[first], e[first], doc, word, at)


def gathered(parts: Iterable[Block]) -> Words:
    """The words of some blocks, as if of one."""
    found, n_docs, n_bytes, n_words = [], 0, 0, 0
    for block in parts:
        x = read_words(block)
        found.append((x.hash, x.data, x.start + n_bytes, x.end + n_bytes, (x.doc + n_docs).astype(np.int32), (x.word + n_words).astype(np.int32), (x.at + n_bytes).astype(np.int32)))
        n_docs, n_bytes, n_words = n_docs + len(block), n_bytes + len(x.data), n_words + len(x.hash)
    if not found:
        return read_words(Block(pa.nulls(0), np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    known, data, start, end, doc, word, at = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    known, first, place = np.unique(known, return_index=True, return_inverse=True)
    return Words(known, data, start[first], end[first], doc, place.astype(np.int32)[word], at)


def profiles(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of at most AT_ONCE words: (word, subsequence code, summed weight) of all gapped triples, by word and code, and each word's sqrt(k(w, w)) before normalisation, 1 where it is 0."""
    start = start.copy()
    while True:  # what stands before the first letter
        skip = np.flatnonzero(start < end)
        skip = skip[SYMBOL[data[start[skip]]] == 27]
        if not len(skip):
            break
        start[skip] += 1
    size = end - start + 1
    word = np.repeat(np.arange(len(size), dtype=np.uint32), size)
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first - start + 1, size)
    at[first] = 0
    symbol = SYMBOL[data[at]].astype(np.uint32) if len(data) else np.zeros(len(at), np.uint32)
    symbol[first] = BEGIN
    letter = symbol != 27
    # A key holds word, three symbols and the number of symbols left out.
    begin, middle, last = (word << (3 * BITS + 2)) | (symbol << (2 * BITS + 2)), symbol << (BITS + 2), symbol << 2
    keys = []
    for b in range(2, SPAN):
        ends = (word[b:] == word[:-b]) & letter[b:] & letter[:-b]
        outer = begin[:-b] | last[b:] | np.uint32(b - 2)
        keys += [(outer | middle[a : a - b])[ends & letter[a : a - b]] for a in range(1, b)]
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.ones(len(size))
    weight = DECAYS[key & 3]
    key >>= 2
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, weight = key[new].astype(np.int64), np.add.reduceat(weight, new)
    word = key >> 3 * BITS
    norm = np.sqrt(np.bincount(word, weight**2, len(size)))
    return word, key & (CODES - 1), weight, np.where(norm > 0, norm, 1.0)


@dataclass
class Vectors:
    """Normalised feature vectors of n words, by subsequence: code u stands in the words mark[first[u]:first[u + 1]], with these values."""

    n: int
    first: np.ndarray
    mark: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Vectors:
        parts = []
        for i in range(0, len(start), AT_ONCE):
            word, code, weight, norm = profiles(data, start[i : i + AT_ONCE], end[i : i + AT_ONCE])
            parts.append((word + i, code, weight / norm[word]))
        word, code, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(code, kind="stable")
        return cls(len(start), np.searchsorted(code[order], np.arange(CODES + 1)).astype(np.int32), word[order], value[order])

    def kernel(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Normalised kernel values of words with these: a sum over the subsequences that they share."""
        out = np.empty((len(start), self.n), np.float32)
        for i in range(0, len(start), AT_ONCE):
            word, code, weight, norm = profiles(data, start[i : i + AT_ONCE], end[i : i + AT_ONCE])
            from_, n = self.first[code], self.first[code + 1] - self.first[code]
            hit = np.flatnonzero(n)
            n = n[hit]
            at = np.arange(n.sum()) + np.repeat(from_[hit] - (np.cumsum(n) - n), n)
            cell = np.repeat(word[hit] * self.n, n) + self.mark[at]
            sums = np.bincount(cell, np.repeat(weight[hit], n) * self.value[at], len(norm) * self.n)
            out[i : i + AT_ONCE] = sums.reshape(len(norm), self.n) / norm[:, None]
        return out


def sharpened(kernel: np.ndarray) -> np.ndarray:
    """kernel ** POWER, by squares; overwrites it."""
    for _ in range(POWER.bit_length() - 1):
        kernel *= kernel
    return kernel


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 300.0) -> np.ndarray:
    """Weights (bias last) of the squared-hinge machine, by Newton steps on the active set."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(30):
        a = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + cost * (a.T @ x[active]), cost * (a.T @ y[active]))
        w = new if _ == 0 else w + 0.7 * (new - w)
        now = y * (x @ w) < 1
        if (now == active).all() and np.allclose(new, w, atol=1e-3):
            break
        active = now
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a weighted logistic fit with a small ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) + np.array([1e-3, 1e-3]) * b
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def association(t: np.ndarray, c: np.ndarray, nt: int, nc: int) -> np.ndarray:
    """Signed root of the log-likelihood ratio of a word's documents in two classes of nt and nc."""
    share = (t + c) / (nt + nc)
    total = np.zeros(len(t))
    for k, n in ((t, nt), (c, nc)):
        for seen, expected in ((k, n * share), (n - k, n * (1 - share))):
            total += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.sign(t * nc - c * nt) * np.sqrt(np.maximum(2 * total, 0))


def disguises(word: np.ndarray) -> list[np.ndarray]:
    """A word with a sign between all letters, and with one inserted at each inner place."""
    word = word[SYMBOL[word] != 27]
    if len(word) < 4:
        return []
    return [np.insert(word, np.arange(1, len(word)), 46), *(np.insert(word, k, 42) for k in range(1, len(word)))]


@dataclass
class Model:
    """A word's margin is its kernel values with the landmarks, to the power, times alpha, plus bias."""

    landmarks: Vectors | None
    alpha: np.ndarray
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self.hash, self.margin = np.zeros(0, np.uint64), np.zeros(0)

    def margins(self, words: Words, some: np.ndarray) -> np.ndarray:
        """Margins of the distinct words with these numbers."""
        out = np.full(len(some), FLOOR)
        if self.landmarks is not None:
            for i in range(0, len(some), AT_ONCE):
                at = some[i : i + AT_ONCE]
                out[i : i + AT_ONCE] = sharpened(self.landmarks.kernel(words.data, words.start[at], words.end[at])) @ self.alpha + self.bias
        return out

    def remembered(self, words: Words) -> np.ndarray:
        """Margins of all distinct words; those met before are looked up."""
        at = np.minimum(np.searchsorted(self.hash, words.hash), max(len(self.hash) - 1, 0))
        known = self.hash[at] == words.hash if len(self.hash) else np.zeros(len(words.hash), bool)
        out = np.empty(len(words.hash))
        out[known] = self.margin[at[known]]
        new = np.flatnonzero(~known)
        out[new] = self.margins(words, new)
        if len(self.hash) + len(new) > REMEMBERED:  # begin again with the words of this block
            self.hash, self.margin = words.hash[:REMEMBERED], out[:REMEMBERED]
        elif len(new):
            place = np.searchsorted(self.hash, words.hash[new])
            self.hash, self.margin = np.insert(self.hash, place, words.hash[new]), np.insert(self.margin, place, out[new])
        return out

    def scores(self, block: Block) -> np.ndarray:
        words = read_words(block)
        return 1 / (1 + np.exp(-(self.slope * pooled(self.remembered(words), words, len(block)) + self.offset)))


def pooled(margin: np.ndarray, words: Words, n: int) -> np.ndarray:
    """Mean of each document's two best margins, given those of the distinct words."""
    f, out = np.minimum(margin, CEILING)[words.word], []
    for _ in range(2):
        best = np.full(n, -np.inf)
        np.maximum.at(best, words.doc, f)
        out.append(np.where(best > -np.inf, best, FLOOR))
        at = np.flatnonzero(f == best[words.doc])
        one = np.full(n, -1)
        one[words.doc[at]] = at  # one token, also of equal ones
        f[one[one >= 0]] = -np.inf
    return (out[0] + out[1]) / 2


def train(texts: list[str], labels: np.ndarray, share: float, landmarks: int = LANDMARKS, rounds: int = 3) -> Model:
    """The machine for labelled texts; share: of toxic ones among all labels, for the logistic fit."""
    words = gathered(blocks([pa.record_batch([pa.nulls(len(texts)), pa.array(texts, pa.large_string())], names=["doc_id", "text"])], max_bytes=TRAIN_BLOCK))
    n, n_words = len(texts), len(words.start)
    toxic = labels.astype(bool)
    nothing = Model(None, np.zeros(0), FLOOR, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not n_words or toxic.all() or not toxic.any():
        return nothing
    pair = np.unique((words.doc.astype(np.int64) << 32) | words.word)
    d, w = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
    del pair
    t, c = (np.bincount(w[of[d]], minlength=n_words) for of in (toxic, ~toxic))
    z = association(t, c, int(toxic.sum()), int((~toxic).sum()))
    pools = (np.argsort(-z)[: 6 * landmarks], landmarks, z > 3), (np.argsort(-np.where(z < 1, c, -1))[: 3 * landmarks], landmarks // 2, c > 0)
    marks: list[int] = []
    for pool, most, fit in pools:
        pool = pool[fit[pool] & (words.end - words.start >= 3)[pool]]
        if not len(pool):
            continue
        at = words.data, words.start[pool], words.end[pool]
        near = Vectors.of(*at).kernel(*at)
        taken: list[int] = []
        for i in range(len(pool)):
            if len(taken) < most and (not taken or near[i, taken].max() < 0.85):
                taken.append(i)
        marks += pool[taken].tolist()
    if not marks:
        return nothing
    vec = Vectors.of(words.data, words.start[marks], words.end[marks])
    values, basis = np.linalg.eigh(sharpened(vec.kernel(words.data, words.start[marks], words.end[marks])).astype(float))
    nystroem = basis / np.sqrt(np.maximum(values, 1e-3))
    frequent = np.argsort(-np.where(z < 2, c, 0))[:4000]
    frequent = frequent[c[frequent] > 0]
    # First the words that go with the label by themselves; then, in turn, the best word of each toxic sentence that the machine accepts.
    good, hard = np.flatnonzero(z > min(SEED, z.max() - 1e-9)), frequent[:0]
    masked = [m for i in good[np.argsort(-z[good])][:SEEDS] for m in disguises(words.data[words.start[i] : words.end[i]])]
    size = np.array([len(m) for m in masked], np.int64)
    at = np.cumsum(size)
    disguised = sharpened(vec.kernel(np.concatenate(masked), at - size, at)) @ nystroem if masked else np.zeros((0, len(values)))
    for _ in range(rounds):
        negative = np.setdiff1d(np.union1d(frequent, hard), good)
        rows = np.concatenate([good, negative])
        y = np.concatenate([np.ones(len(good)), -np.ones(len(negative))])
        x = sharpened(vec.kernel(words.data, words.start[rows], words.end[rows])) @ nystroem
        x, y = np.concatenate([x, disguised]), np.concatenate([y, np.ones(len(disguised))])
        weight = np.append(1 + np.log1p(t[rows] + c[rows]), np.ones(len(disguised)))
        weight = np.where(y > 0, weight / weight[y > 0].sum(), weight / max(1e-9, weight[y < 0].sum()))
        found = svm(x, y, weight * len(y) / 2)
        alpha, bias = nystroem @ found[:-1], float(found[-1])
        score = Model(vec, alpha, bias, 1.0, 0.0).margins(words, np.arange(n_words))  # anew in each round: all words' kernel values would be the driver's largest table
        first, second = ranked(score, d, w)
        best = np.unique(w[np.concatenate([x[toxic[d[x]]] for x in (first, second)])])
        good = np.union1d(np.flatnonzero(z > min(SEED, z.max() - 1e-9)), best[(score[best] > ACCEPT) & (z[best] > LIKELY)])
        hard = np.union1d(hard, w[second[~toxic[d[second]]]])
        hard = hard[np.argsort(-score[hard])][:4000]
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    return Model(vec, alpha, bias, *logistic(pooled(score, words, n), toxic.astype(float), weight))


def ranked(margin: np.ndarray, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct (document, word), in order of documents: the places of each document's best word and of the best one besides it."""
    at = np.lexsort((-margin[word], doc))
    doc = doc[at]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    return at[new], at[1:][new[:-1] & ~new[1:]]


def fit(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on the bounded sample; documents that held_out() names are never used."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y")).filter(~held_out(F.col("doc_id")))
    n_toxic, n_known = known.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter((F.octet_length("text") <= train_bytes) & (F.octet_length("text") > 0))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = [known.filter(F.col("y") == y).orderBy(*by_hash).limit(2 * train_docs) for y in (0, 1)]
    found = small.join(F.broadcast(first[0].union(first[1])), "doc_id")  # at most 4 * train_docs ids; one scan of the texts
    place = F.row_number().over(Window.partitionBy("y").orderBy(*by_hash, F.xxhash64("text")))
    sample = found.withColumn("place", place).filter(F.col("place") <= train_docs).collect()
    sample.sort(key=lambda r: (r.y, r.place))
    texts, labels = [r.text for r in sample], np.array([r.y for r in sample], int)
    del sample
    model = train(texts, labels, n_toxic / max(1, n_known))
    release()
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """Documents whose labels are for testing only."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score(spark: SparkSession, docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(shared.value.scores(block))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(part, "doc_id long, score double")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = score(spark, docs, fit(docs, labels, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """docs without those that score threshold or more; rows stay as they are."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, text_col=text_col, **options))
    names = docs.columns
    at = names.index(text_col)

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(b) for b in blocks([batch], at, at)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(part, docs.schema)
