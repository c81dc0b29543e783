"""LM scoring by a hierarchical Pitman-Yor model.

A text is its words and one end. A word comes from the restaurant of the two words before it;
its parent is the restaurant of the one word before it, whose parent is the words' restaurant,
whose base measure spells a word byte by byte: restaurants of the last three bytes (each folded
to one of 32 classes), which share parents of two, one and no bytes. The customers of a
restaurant are those of the texts or the tables of the restaurants below it. Seating is
sampled by Gibbs sweeps that visit every customer (seating.py); seatings are carried from
sweep to sweep in staged tables. Contexts are swept LOCAL times before each sample, which
also is the burn-in; predictive probabilities are averaged over the samples.

Contexts are dealt to buckets by their last word, so that a restaurant of two words, its
parent and all their dishes meet in one task; a bucket's two lowest levels make LOCAL sweeps,
then the words' tables go to the words' own buckets, where the words' restaurant is seated,
and the words' probabilities come back. The contexts after a word that more than SLICE tokens
follow are dealt to several buckets by the word before it, and two words that more than SLICE
tokens follow by the word after them: that changes who seats a dish, not the model. The one
restaurant of such a word (a head) is seated beside the words' restaurant, dish by dish in the
buckets of the words after it: it gets the tables of all buckets below it, and its
probabilities come back. The restaurant of two such words is told the tables that it has in
other buckets.

Text is read once. A run of documents is a row of numbers of its own words; the runs' words
meet in the words' buckets, which number them. With those numbers each run is inverted: it
gives each bucket of contexts one row, and one row a bucket, with all its dishes and the places
of each, is staged in a table bucketed like the messages, so that no sweep shuffles it.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import astuple, dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seating import STRENGTH, Seating, discount, sweep
from .shared import bucketed, drop_staged, even_slots, memo, staged, trim

#: Characters of text that a bucket, and a run of documents, stand for; documents of a run;
#: buckets at least, and buckets of contexts for one of words.
BUCKET_CHARS, RUN_CHARS, RUN_DOCS, LEAST_BUCKETS, WORD_SHARE = 8_000_000, 9_000_000, 10_000, 24, 8
#: Buckets that a task takes, one after another.
TOGETHER = 4
#: Exchanges between contexts and words (each is a sample), samples that are not kept, sweeps of
#: the contexts before each sample; bytes of a spelling context.
SWEEPS, BURN_IN, LOCAL, ORDER = 3, 0, 2, 3
#: Tokens after one context that a bucket gets at most, about.
SLICE = 250_000
#: A bucket's sums of log10 probabilities are told in such parts of one.
POINT = 4096
#: Class of a byte in a context: letters, the blank, digits, other ASCII, UTF-8's leads, its rest.
_FOLD = np.array([b - 97 if 97 <= b < 123 else 26 if b == 32 else 27 if 48 <= b < 58 else 28 if b < 128 else 29 if b >= 192 else 30 + b % 2 for b in range(256)])
END = b" "  # no word has a blank; also the word before the first


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers from 0 on in as few bytes as the largest of each array needs, or floats;
    compressed byte plane by byte plane."""
    head, planes = [len(arrays)], []
    for x in arrays:
        if x.dtype.kind == "f":
            x, k = x.astype("<f4"), 0
        else:
            top = int(x.max(initial=0))
            k = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
            x = x.astype(f"<u{k}")
        head += [len(x), k]
        planes.append(x.view(np.uint8).reshape(-1, k or 4).T.tobytes())
    return zstandard.compress(np.array(head, "<i8").tobytes() + b"".join(planes), 1)


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, offset=8).reshape(n, 2).tolist()
    out, at = [], 8 * (2 * n + 1)
    for size, k in head:
        x = np.frombuffer(raw, np.uint8, size * (k or 4), offset=at).reshape(k or 4, size).T
        at += size * (k or 4)
        x = np.ascontiguousarray(x)
        out.append(x.view(f"<u{k}").ravel().astype(np.int64) if k else x.view("<f4").ravel().astype(float))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _edges(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on in order, and their places: by one sort of numbers with their places,
    if these fit."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()) >> (62 - bits):
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = (key << bits) | np.arange(len(key))
    both.sort()
    return both >> bits, both & ((1 << bits) - 1)


def _number(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each value among them."""
    values, order = _sorted(key)
    new = np.zeros(len(key), bool)
    new[_edges(values)] = True
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new) - 1
    return values[new], out


def _runs_of(pdf: pd.DataFrame):
    """Runs of a batch's documents."""
    chars = pdf["text"].str.len().to_numpy()
    run = np.maximum(np.cumsum(chars) // RUN_CHARS, np.arange(len(pdf)) // RUN_DOCS)
    edges = [*_edges(run).tolist(), len(pdf)]
    for a, b in zip(edges, edges[1:]):
        yield pdf.iloc[a:b]


def _lines(words: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(words), 1)


def _words(raw: bytes) -> list[bytes]:
    return zstandard.decompress(raw).split(b"\n")


def _word_bucket(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % n


#: rb: deals the runs to buckets. words: END first; c: how often they are learned; tokens: their
#: numbers, text after text; docs: tokens of each text, whether it is learned, its crc32; ids:
#: doc_id of each, then whether it is known.
_RUN = "rb int, run long, words binary, c binary, tokens binary, docs binary, ids binary"


def _read(batches, slots: list[int]):
    """Rows of the runs of a task; documents are numbered within the task."""
    memo("hpyp")
    task = TaskContext.get().partitionId()
    base = task << 40
    for pdf in batches:
        for some in _runs_of(pdf):
            number: dict[bytes, int] = defaultdict(count().__next__)
            number[END]
            flat, crc = [], []
            for t in some["text"]:
                raw = t.encode().lower()
                crc.append(zlib.crc32(raw))
                raw = raw.split()
                raw.append(END)
                flat.append(np.fromiter(map(number.__getitem__, raw), np.int32, len(raw)))
            size = np.array([len(x) for x in flat], np.int64)
            flat, learn = np.concatenate(flat), some["learn"].to_numpy().astype(np.int64)
            c = np.bincount(flat, weights=np.repeat(learn, size), minlength=len(number)).astype(np.int64)
            ids = some["doc_id"].to_numpy().astype("<i8").tobytes() + some["known"].to_numpy().astype("u1").tobytes()
            yield pd.DataFrame([{"rb": slots[task % len(slots)], "run": base, "words": _lines(list(number)), "c": _pack(c), "tokens": _pack(flat), "docs": _pack(size, learn, np.array(crc, np.int64)), "ids": ids}])
            base += len(some)
    trim()


class Tokens:
    """The tokens of a run: numbers of each word and of the two before it."""

    def __init__(self, tokens: bytes, docs: bytes):
        (self.w2,) = _unpack(tokens)
        self.size, self.learn, self.crc = _unpack(docs)
        first = np.cumsum(self.size) - self.size
        self.w1 = np.concatenate([[0], self.w2[:-1]])
        self.w1[first] = 0
        self.w0 = np.concatenate([[0], self.w1[:-1]])
        self.w0[first] = 0


#: id of a word: its place among the words of its bucket, the most frequent first, times the
#: number of buckets, and its bucket.
_TOLD = "q int, rb int, run long, words binary, c binary"
_VOCABULARY = "q int, words binary, c binary, back binary, tokens long, types long"


def _tell(batches, word_buckets: int):
    """The words of each run, by bucket of words."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            words, (c,) = _words(r.words), _unpack(r.c)
            q = _word_bucket(words, word_buckets)
            order = np.argsort(q, kind="stable")
            ends = [*_edges(q[order]).tolist(), len(q)]
            yield pd.DataFrame([{"q": int(q[order[i]]), "rb": r.rb, "run": r.run, "words": _lines([words[k] for k in order[i:j].tolist()]), "c": _pack(c[order[i:j]])} for i, j in zip(ends, ends[1:])])


def _vocabulary(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row with the words of a bucket, and their places for each run."""
    pdf = pdf.sort_values("run")
    number: dict[bytes, int] = defaultdict(count().__next__)
    at = [np.fromiter(map(number.__getitem__, _words(w)), np.int64) for w in pdf["words"]]
    words, c = list(number), np.zeros(len(number), np.int64)
    for i, n in zip(at, pdf["c"]):
        c[i] += _unpack(n)[0]
    order = np.argsort(-c, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    back = _pack(pdf["rb"].to_numpy(np.int64), pdf["run"].to_numpy(np.int64), np.array([len(x) for x in at]), rank[np.concatenate(at)])
    return pd.DataFrame([{"q": int(pdf["q"].iloc[0]), "words": _lines([words[i] for i in order.tolist()]), "c": _pack(c[order]), "back": back, "tokens": int(c.sum()), "types": int((c > 0).sum())}])


def _back(batches):
    """The places of each run's words, by run, and how often they are learned."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            rb, run, size, at = _unpack(r.back)
            (c,) = _unpack(r.c)
            yield pd.DataFrame([{"rb": b, "run": k, "q": r.q, "at": _pack(x, c[x])} for b, k, x in zip(rb.tolist(), run.tolist(), np.split(at, np.cumsum(size)[:-1]))])


def _common(batches, often: list[bytes], share: float):
    """How many tokens each pair of common words has after it, in runs where these are more than
    a share."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            number = {w: i for i, w in enumerate(_words(r.words))}
            mine = [w for w in often if w in number]
            t = Tokens(r.tokens, r.docs)
            of = np.full(len(number), -1)
            of[[number[w] for w in mine]] = np.arange(len(mine))
            a, b = of[t.w0], of[t.w1]
            both = (a >= 0) & (b >= 0)
            pair, n = np.unique(a[both] * max(1, len(mine)) + b[both], return_counts=True)
            some = pair[n > share * len(t.w2)].tolist()
            yield pd.DataFrame({"w0": [mine[i // len(mine)] for i in some], "w1": [mine[i % len(mine)] for i in some], "n": n[n > share * len(t.w2)]})


def _invert(r, at: list[np.ndarray], buckets: list[int], hot: dict):
    """Rows of one run: for each bucket its pairs (word before, word), under each the words
    before those, under each the documents (local number * 2 + learn) and how often. at: the
    places of its words, by bucket of words; hot: the slices of common words and pairs."""
    t, words, k = Tokens(r.tokens, r.docs), _words(r.words), len(at)
    number = {w: i for i, w in enumerate(words)} if hot else {}
    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    ids = np.empty(len(words), np.int64)
    for q, x in enumerate(at):
        ids[crc % k == q] = x * k + q
    v, docs = len(words), len(t.size)
    known = np.lexsort((ids // k, ids % k))  # in the order that buckets have too
    ids, crc = ids[known], crc[known]
    rank = np.empty(v, np.int64)
    rank[known] = np.arange(v)
    number = {w: int(rank[i]) for w, i in number.items()}
    t.w0, t.w1, t.w2 = rank[t.w0], rank[t.w1], rank[t.w2]
    pair, of = _number(t.w1 * v + t.w2)
    tri, order = _sorted(of * v + t.w0)
    of, w0 = np.divmod(tri, v)
    doc = np.repeat(np.arange(docs), t.size)[order]
    new = np.concatenate([[True], (tri[1:] != tri[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    n, of, w0, doc = np.diff(np.append(at, len(of))), of[at], w0[at], doc[at]
    w1, w2 = np.divmod(pair[of], v)
    place = crc.astype(np.uint64)[w1]
    slices = np.ones(v, np.int64)
    for w, many in hot.items():
        if isinstance(w, bytes) and w in number:
            slices[number[w]] = many
    cut = np.flatnonzero(slices[w1] > 1)
    place[cut] += (_mix(crc[w0[cut]].astype(np.uint64)) % slices[w1[cut]].astype(np.uint64) + np.uint64(1)) << np.uint64(32)
    pairs = sorted((number[w[0]] * v + number[w[1]], many) for w, many in hot.items() if isinstance(w, tuple) and w[0] in number and w[1] in number)
    if pairs:
        often, many = np.array(pairs, np.int64).T
        key = w0[cut] * v + w1[cut]
        which = np.minimum(np.searchsorted(often, key), len(often) - 1)
        hit = often[which] == key
        rows = cut[hit]
        place[rows] += (_mix(crc[w2[rows]].astype(np.uint64)) % many[which[hit]].astype(np.uint64) + np.uint64(1)) << np.uint64(48)
    bucket = (_mix(place) % np.uint64(len(buckets))).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if len(buckets) < 1 << 16 else bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(len(buckets) + 1))
    for p, b in enumerate(buckets):
        at = order[ends[p] : ends[p + 1]]
        if not len(at):
            continue
        a, z = of[at], w0[at]
        new_pair = np.concatenate([[True], a[1:] != a[:-1]])
        new_tri = new_pair | np.concatenate([[True], z[1:] != z[:-1]])
        tris, pairs = np.flatnonzero(new_tri), np.flatnonzero(new_pair)
        before = w1[at][pairs]
        first = _edges(before)  # of each word before
        data = _pack(
            ids[before[first]], np.diff(np.append(first, len(before))), ids[w2[at][pairs]], np.add.reduceat(new_tri, pairs).astype(np.int64),
            ids[z[tris]], np.diff(np.append(tris, len(at))), doc[at] * 2 + t.learn[doc[at]], n[at],
        )
        yield {"b": b, "p": p, "rb": r.rb, "run": r.run, "data": data}


_ROW = "b int, p int, rb int, run long, data binary"
#: words: places of the words that stand in dishes, by bucket of words; shape: pairs and triples; seats: what is seated of them;
#: places: by run, the triples of its documents.
_PART = "b int, p int, words binary, shape binary, seats binary, places binary, once array<long>, twice array<long>"


def _merge(pdf: pd.DataFrame, word_buckets: int, heads: np.ndarray, often: np.ndarray) -> pd.DataFrame:
    """One row with all dishes of a bucket, in order, and their places by run. heads: ids of the
    common words; often: pairs of their numbers (last word first) that many tokens follow."""
    pdf = pdf.sort_values("run", kind="stable")
    rows = [_unpack(x) for x in pdf["data"]]
    w1, pairs, w2, tris, w0, entries, doc, n = (np.concatenate(x) for x in zip(*rows))
    size = np.array([len(x[6]) for x in rows])
    del rows
    ids, local = _number(np.concatenate([w1, w2, w0]))
    order = np.lexsort((ids // word_buckets, ids % word_buckets))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ids, v = ids[order], len(ids)
    w1, w2, w0 = np.split(rank[local], np.cumsum([len(w1), len(w2)]))
    pair, of = _number(np.repeat(w1, pairs) * v + w2)
    tri, of = _number(np.repeat(of, tris) * v + w0)
    del w0, w1, w2, local
    k = len(heads)
    head = np.searchsorted(heads, ids)  # 1 + its number for a head, else 0
    head = np.where(heads[np.minimum(head, k - 1)] == ids, head + 1, 0) if k else np.zeros(v, np.int64)
    tri_pair, w0 = np.divmod(tri, v)
    w1, w2 = np.divmod(pair, v)
    many = np.zeros(len(tri), np.int64)  # 1 + the number of a pair that many tokens follow
    if len(often):
        code = (head[w1[tri_pair]] - 1) * k + head[w0] - 1
        at = np.minimum(np.searchsorted(often, code), len(often) - 1)
        many = np.where((often[at] == code) & (head[w1[tri_pair]] > 0) & (head[w0] > 0), at + 1, 0)
    q, place = ids % word_buckets, ids // word_buckets
    items, word = _number((q[w2] * (k + 1) + head[w1]) * v + w2)
    size_of, item_head = np.bincount(items // v // (k + 1), minlength=word_buckets), items // v % (k + 1)
    learned = np.add.reduceat(n * (doc & 1), np.cumsum(entries) - entries)
    c = np.bincount(of, weights=learned, minlength=len(tri)).astype(np.int64)
    start = np.bincount(tri_pair, weights=c > 0, minlength=len(pair)).astype(np.int64)
    start[head[w1] > 0] = 0  # counted where they are seated
    first = _edges(w1)
    dishes = np.diff(np.append(first, len(w1))), word, head[w1], np.bincount(tri_pair, minlength=len(pair)), w0, c, many
    of = np.repeat(of, entries)  # each run's in order
    step, at = np.diff(of, prepend=0), np.cumsum(size) - size
    step[at] = of[at]
    places = _pack(pdf["rb"].to_numpy(np.int64), pdf["run"].to_numpy(np.int64), size, step, doc >> 1, n)
    shape = _pack(*dishes)
    own = Bucket(dishes)
    out = {"b": int(pdf["b"].iloc[0]), "p": int(pdf["p"].iloc[0]), "words": _pack(size_of, item_head, place[items % v]), "shape": shape, "seats": _pack(*astuple(own.seats())), "places": places}
    return pd.DataFrame([out | {"once": [int((c == 1).sum()), int((start == 1).sum())], "twice": [int((c == 2).sum()), int((start == 2).sum())]}])


class Bucket:
    """The dishes of a bucket of contexts."""

    def __init__(self, dishes):
        """dishes: of each word before, how many pairs it has; of each pair the number of what is
        asked for, the head that it follows, and how many triples it has; of each triple the word
        before those, how often it is learned, and its context if many tokens follow that."""
        pairs, self.word, head, tris, w0, self.c, many = dishes
        v = int(w0.max(initial=0)) + 1
        self.w1 = np.repeat(np.arange(len(pairs)), pairs)
        self.items, self.told = int(self.word.max(initial=-1)) + 1, head > 0  # pairs that are seated with the words
        self.pair = np.repeat(np.arange(len(self.word)), tris)
        self.context = _number(self.w1[self.pair] * v + w0)[1]
        self.many = np.zeros(int(self.context.max(initial=-1)) + 1, np.int64)
        self.many[self.context] = many
        learned = np.bincount(self.pair, weights=self.c, minlength=len(self.word))
        self.single = (learned == 1) & ~self.told
        self.low, self.high = np.flatnonzero(self.c > 1), np.flatnonzero((learned > 1) & ~self.told)

    def seats(self) -> "Seats":
        one = self.c == 1
        at = len(self.high) + self.word
        at[self.high] = np.arange(len(self.high))
        contexts, group = _number(self.context[self.low])
        alone = np.bincount(self.context[one], minlength=len(self.many))
        common = np.flatnonzero(self.many)
        apart = self.pair[one & self.told[self.pair]]
        return Seats(
            self.c[self.low], group, alone[contexts], at[self.pair[self.low]], np.bincount(self.pair[one], minlength=len(self.word))[self.high],
            self.w1[self.high], np.bincount(self.w1[self.single], minlength=int(self.w1.max(initial=-1)) + 1),
            self.word[self.high], np.bincount(self.word[self.single], minlength=self.items) + np.bincount(self.word[apart], minlength=self.items),
            self.many[contexts], self.many[common], alone[common], np.bincount(self.context, weights=self.c, minlength=len(self.many)).astype(np.int64)[common],
        )

    def triples(self, low: Seating, high: Seating, words: np.ndarray, d: list[float], opened: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """log probabilities of all triples. opened, customers: of the contexts that many tokens
        follow, in all buckets."""
        c, t = self.single.astype(np.int64), self.single.astype(np.int64)
        c[self.high], t[self.high] = high.c, high.t
        pairs = _level(c, t, self.w1, np.zeros(int(self.w1.max(initial=-1)) + 1, np.int64), d[1], words[self.word])
        pairs = np.where(self.told, words[self.word], pairs)
        t = np.minimum(self.c, 1)
        t[self.low] = low.t
        common = np.flatnonzero(self.many)
        known = common, customers[self.many[common]], opened[self.many[common]]
        return _level(self.c, t, self.context, np.zeros(len(self.many), np.int64), d[0], pairs[self.pair], known)


def _level(c, t, group, more, d, below, known=None) -> np.ndarray:
    """log probabilities of dishes from those of the parent. more: tables, each of one customer,
    that each restaurant has besides; known: some restaurants, and all their customers and tables."""
    total = more + np.bincount(group, weights=c, minlength=len(more))
    opened = more + np.bincount(group, weights=t, minlength=len(more))
    if known is not None:
        total[known[0]], opened[known[0]] = known[1:]
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(c - d * t, 0))
        return np.logaddexp(own, np.log(STRENGTH + d * opened)[group] + below) - np.log(STRENGTH + total)[group]


@dataclass
class Seats:
    """What is seated of a bucket's dishes. Those with one customer have one table, whatever
    happens; the others are the triples that are learned more than once (low), their pairs, and
    those of several triples (high)."""

    c: np.ndarray  # customers of the low dishes, their restaurants, tables there of one customer
    group: np.ndarray
    more: np.ndarray
    above: np.ndarray  # their pairs among the high dishes, then what is asked for (pairs after heads)
    ones: np.ndarray  # customers of the high dishes from triples of one table
    of: np.ndarray  # restaurants of the high dishes, tables there of one customer
    of_more: np.ndarray
    word: np.ndarray  # words of the high dishes among those asked for
    alone: np.ndarray  # tables of what is asked for in dishes of one customer
    many: np.ndarray  # of the low dishes' restaurants: those that other buckets have too, from 1 on
    common: np.ndarray  # all of those here, their tables of one customer, their customers
    common_alone: np.ndarray
    common_c: np.ndarray

    def first(self) -> tuple[Seating, Seating]:
        low = Seating.first(self.c)
        return low, Seating.first(self._customers(low))

    def _below(self, low: Seating) -> np.ndarray:
        return np.bincount(self.above, weights=low.t, minlength=len(self.ones) + len(self.alone)).astype(np.int64)

    def _customers(self, low: Seating) -> np.ndarray:
        return self.ones + self._below(low)[: len(self.ones)]

    def tables(self, low: Seating, high: Seating) -> np.ndarray:
        """Tables of each word, or pair after a head, that is asked for."""
        own = np.bincount(self.word, weights=high.t, minlength=len(self.alone)).astype(np.int64)
        return self.alone + own + self._below(low)[len(self.ones) :]

    def shared(self, low: Seating) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Restaurants that other buckets have too: numbers, tables and customers here."""
        t = np.bincount(self.many[self.group], weights=low.t, minlength=int(self.common.max(initial=0)) + 1).astype(np.int64)
        return self.common, self.common_alone + t[self.common], self.common_c

    def sweeps(self, low: Seating, high: Seating, words: np.ndarray, d: list[float], rng, opened: np.ndarray) -> tuple[Seating, Seating]:
        """words: log probabilities of what is asked for; d: discounts after two words, one;
        opened: tables of the restaurants that several buckets have."""
        below, elsewhere = words[self.word], opened.copy()
        common, here, _ = self.shared(low)
        elsewhere[common] -= here
        more = self.more + elsewhere[self.many]
        for _ in range(LOCAL):
            p = np.concatenate([_level(high.c, high.t, self.of, self.of_more, d[1], below), words])[self.above]
            low = sweep(low, low.c, p, self.group, d[0], rng, more)
            high = sweep(high, self._customers(low), below, self.of, d[1], rng, self.of_more)
        return low, high


class Spelling:
    """Byte probabilities after ORDER folded bytes. A word ends with a blank and begins after
    blanks. keys: context * 256 + byte, at most 2**(5 * ORDER + 8) of them, whatever the corpus;
    such a model goes to every task."""

    def __init__(self, keys: np.ndarray, c: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.keys = keys
        levels = [(keys, 5 * ORDER)]  # keys, bits of their context
        while levels[-1][1]:
            bits = levels[-1][1] - 5
            levels.append((np.unique(levels[-1][0] & ((1 << (bits + 8)) - 1)), bits))
        # At first every dish has one table; then, twice, each level is seated given its parent,
        # from the root on, its customers being the tables above it.
        tables, seats = [np.ones(len(k), np.int64) for k, _ in levels], [None] * len(levels)
        for _ in range(2):
            parent = np.full(256, 1 / 256)
            for i in reversed(range(len(levels))):
                k, bits = levels[i]
                group = k >> 8 if bits else np.zeros(len(k), np.int64)
                n = self._customers(levels[i - 1][0], tables[i - 1], k, bits + 8) if i else c
                d = discount(int((n == 1).sum()), int((n == 2).sum()))
                of = lambda x, g=group, m=1 << bits: np.bincount(g, weights=x, minlength=m)
                seats[i] = sweep(seats[i] or Seating.first(n), n, np.log(parent[k & (len(parent) - 1)]), group, d, rng, np.zeros(1 << bits, np.int64))
                tables[i] = seats[i].t
                own = np.maximum(n - d * tables[i], 0) / (STRENGTH + of(n)[group])
                back = (STRENGTH + d * of(tables[i])) / (STRENGTH + of(n))
                if i:  # all probabilities of this level: the parent of the next
                    rows = parent.reshape(-1, 256)
                    dense = (back[:, None] * rows[np.arange(1 << bits) & (len(rows) - 1)]).ravel()
                    dense[k] += own
                    parent = dense
        self.pair = parent  # probabilities of the level below
        self.table = None  # logs of all probabilities, in a task that asks for them
        self.own, self.back = own, back

    @staticmethod
    def _customers(above: np.ndarray, tables: np.ndarray, k: np.ndarray, bits: int) -> np.ndarray:
        low = above & ((1 << bits) - 1)
        return np.bincount(np.searchsorted(k, low), weights=tables, minlength=len(k)).astype(np.int64)

    def log(self, key: np.ndarray) -> np.ndarray:
        if self.table is None:
            p = (self.back[:, None] * self.pair.reshape(-1, 256)[np.arange(len(self.back)) & (len(self.pair) // 256 - 1)]).ravel()
            p[self.keys] += self.own
            self.table = np.log(p).astype(np.float32)
        return self.table[key].astype(float)


def _bytes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Spelling keys of all words, and where each word's keys begin."""
    s = np.frombuffer(b" " + b" ".join([b"" if w == END else w for w in words]) + b" ", np.uint8)
    blank = s[:-1] == 32
    back, context = s[:-1], np.zeros(len(s) - 1, np.int64)
    for k in range(ORDER):
        context |= np.where(blank, 26, _FOLD[back]) << (5 * k)
        back = np.concatenate([s[:1], back[:-1]])
        blank = blank | (back == 32)
    size = np.array([1 if w == END else len(w) + 1 for w in words], np.int64)
    return (context << 8) | s[1:], np.cumsum(size) - size




def _states(*seatings: Seating) -> bytes:
    return _pack(*[x for s in seatings for x in (s.c, s.t, s.sizes)])


def _seatings(raw: bytes) -> list[Seating]:
    x = _unpack(raw)
    return [Seating(*x[i : i + 3]) for i in range(0, len(x), 3)]


#: Messages to buckets: of sweep k, the words' probabilities, by bucket of words; or with q = -1
#: the seatings there, with q = -2 the tables and customers of contexts that other buckets share.
_DOWN = "b int, p int, k int, q int, data binary"
_UP, _WORDS = "q int, b int, p int, data binary", "q int, words binary, c binary, who binary, once long, twice long, opened long, pair_once long, pair_twice long"
_SEATED = "q int, data binary, grams binary, tables long, customers long, heads binary"


def _shared(seats: Seats, low: Seating, b: int, p: int) -> list[dict]:
    return [{"q": -2, "b": b, "p": p, "data": _pack(*seats.shared(low))}] if len(seats.common) else []


def _ask(batches):
    """Each bucket's words and pairs after heads, by bucket of words: heads, places, and
    customers at first."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            seats, (size, head, at) = Seats(*_unpack(r.seats)), _unpack(r.words)
            low, high = seats.first()
            t, ends = seats.tables(low, high), np.cumsum(size)
            rows = zip(*(np.split(x, ends[:-1]) for x in (head, at, t)))
            out = [{"q": q, "b": r.b, "p": r.p, "data": _pack(*x)} for q, x in enumerate(rows) if len(x[0])]
            yield pd.DataFrame(out + _shared(seats, low, r.b, r.p))


def _gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The words of a bucket, the pairs that end in them after heads (numbered behind the words),
    and which buckets of contexts ask for which."""
    out, right = [], right.sort_values("p")
    for r in left.itertuples(index=False):
        got, v = [_unpack(x) for x in right["data"]], len(_unpack(r.c)[0])
        number = np.concatenate([head * v + at for head, at, _ in got])
        some = number >= v
        pairs, of = _number(number[some])
        number[some] = v + of
        t = np.bincount(number, weights=np.concatenate([n for *_, n in got]), minlength=v + len(pairs)).astype(np.int64)
        t, below = t[:v], t[v:]
        t = t + np.bincount(pairs % v, weights=below > 0, minlength=v).astype(np.int64)
        ends = np.cumsum([len(at) for _, at, _ in got])
        who = _pack(right["p"].to_numpy(np.int64), np.diff(ends, prepend=0), np.concatenate([np.diff(x, prepend=0) for x in np.split(number, ends[:-1])]), pairs)
        counts = {"once": t == 1, "twice": t == 2, "opened": t > 0, "pair_once": below == 1, "pair_twice": below == 2}
        out.append({"q": r.q, "words": r.words, "c": r.c, "who": who} | {k: int(x.sum()) for k, x in counts.items()})
    return pd.DataFrame(out, columns=["q", "words", "c", "who", "once", "twice", "opened", "pair_once", "pair_twice"])


def _who(raw: bytes) -> tuple[dict[int, np.ndarray], np.ndarray]:
    p, size, steps, pairs = _unpack(raw)
    return {b: np.cumsum(x) for b, x in zip(p.tolist(), np.split(steps, np.cumsum(size)[:-1]))}, pairs


def _spelled(words: bytes, model: Spelling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log probability of each word's spelling; all spelling keys and how many each word has."""
    keys, first = _bytes_of(_words(words))
    return np.add.reduceat(model.log(keys), first), keys, np.diff(np.append(first, len(keys)))


def score(docs: DataFrame, learn: str = "learn", seed: int = 1) -> DataFrame:
    """docs: doc_id, text and a boolean column that says which rows are learned from. Returns
    doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    base_score is that of the smoothed word counts, score the log10 of the text's probability:
    the product of its tokens' predictive probabilities, averaged over the kept sweeps. Null
    texts are empty: only the end. A null in the boolean column counts as false, rows with null
    or repeated doc_ids are rows like any other (each is learned from), other columns are not
    read. Without rows to learn from the words are spelled by the flat model."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    chars = src.agg(F.sum(F.length("text").cast("long") + 1)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    word_buckets = max(4, -(-buckets // WORD_SHARE))
    tables = -(-buckets // TOGETHER)
    even = even_slots(spark, tables)
    places = [even[p % tables] for p in range(buckets)]
    slots = even_slots(spark, max(8, -(-chars // (2 * RUN_CHARS))))
    runs = bucketed(src.mapInPandas(lambda it: _read(it, slots), _RUN), "rb", len(slots), "hpyp_runs")
    told = runs.select("rb", "run", "words", "c").mapInPandas(lambda it: _tell(it, word_buckets), _TOLD)
    vocabulary = staged(told.groupBy("q").applyInPandas(_vocabulary, _VOCABULARY), "hpyp")
    tokens, types = (int(x or 0) for x in vocabulary.agg(F.sum("tokens"), F.sum("types")).first())

    def frequent(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                (c,) = _unpack(r.c)
                n = int((c > SLICE).sum())
                yield pd.DataFrame({"w": _words(r.words)[:n], "n": c[:n], "id": np.arange(n) * word_buckets + r.q})

    common = sorted(vocabulary.select("q", "words", "c").mapInPandas(frequent, "w binary, n long, id long").collect(), key=lambda r: r.id)
    hot: dict = {bytes(r.w): -(-r.n // SLICE) for r in common}
    heads, number = np.array([r.id for r in common], np.int64), {bytes(r.w): i for i, r in enumerate(common)}
    if hot:
        often, share = sorted(hot), SLICE / 2 / tokens  # what more than SLICE tokens follow has half of them in such runs
        pairs = runs.select("words", "tokens", "docs").mapInPandas(lambda it: _common(it, often, share), "w0 binary, w1 binary, n long")
        pairs = pairs.groupBy("w0", "w1").agg(F.sum("n").alias("n")).where(F.col("n") > SLICE / 2)
        hot |= {(bytes(r.w0), bytes(r.w1)): -(-r.n // SLICE) for r in pairs.collect()}
    several = np.array(sorted(number[w[1]] * len(heads) + number[w[0]] for w in hot if isinstance(w, tuple)), np.int64)

    def invert(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples(index=False):
            at = [np.zeros(0, np.int64)] * word_buckets
            for q, x in zip(right["q"][right["run"] == r.run].tolist(), right["at"][right["run"] == r.run]):
                at[q] = _unpack(x)[0]
            out += _invert(r, at, places, hot)
        trim()
        return pd.DataFrame(out, columns=["b", "p", "rb", "run", "data"])

    back = vocabulary.select("q", "c", "back").mapInPandas(_back, "rb int, run long, q int, at binary")
    rows = runs.select("rb", "run", "words", "tokens", "docs").groupBy("rb").cogroup(back.groupBy("rb")).applyInPandas(invert, _ROW)
    parts = bucketed(rows.groupBy("b", "p").applyInPandas(lambda pdf: _merge(pdf, word_buckets, heads, several), _PART), "b", tables, "hpyp_contexts")

    def sums(df: DataFrame, name: str) -> list[int]:
        got = dict(df.select(F.posexplode(name).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect())
        return [got.get(k, 0) for k in range(2)]

    single, double = sums(parts, "once"), sums(parts, "twice")
    asked = staged(parts.select("b", "p", "words", "seats").mapInPandas(_ask, _UP), "hpyp")
    words = bucketed(vocabulary.select("q", "words", "c").groupBy("q").cogroup(asked.where("q >= 0").groupBy("q")).applyInPandas(_gather, _WORDS), "q", word_buckets, "hpyp_words")
    once, twice, opened, pair_once, pair_twice = (int(x or 0) for x in words.agg(*map(F.sum, ("once", "twice", "opened", "pair_once", "pair_twice"))).first())
    d = [discount(*x) for x in ((single[0], double[0]), (single[1] + pair_once, double[1] + pair_twice), (once, twice))]
    own_words, shapes = words.select("q", "words", "c", "who"), parts.select("b", "p", "seats")

    def root(state: Seating, spelled: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
        """log probabilities of a bucket's words."""
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(state.c - d[2] * state.t, 0))
        return np.logaddexp(own, math.log(STRENGTH + d[2] * totals[0]) + spelled) - math.log(STRENGTH + totals[1])

    def seat_words(up: DataFrame, before: DataFrame | None, s: int, model, totals: tuple[int, int], of_heads: np.ndarray) -> DataFrame:
        """The words' and heads' restaurants after sweep s, given the tables below them and all
        tables and customers before."""

        def seat(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            for r in left.itertuples(index=False):
                v, (who, pairs), state = len(_unpack(r.c)[0]), _who(r.who), None
                customers = np.zeros(v + len(pairs), np.int64)
                for p, data in zip(right["p"].tolist(), right["data"]):
                    if p < 0:
                        state = _seatings(data)
                    else:
                        customers[who[p]] += _unpack(data)[-1]
                spelled, keys, per = _spelled(r.words, model.value)
                rng = np.random.default_rng([seed, 1, r.q, s])
                (head, word), below = np.divmod(pairs, v), customers[v:]
                after, state = state or (Seating.first(below), None)
                if state and len(pairs):
                    p, more = root(state, spelled, totals)[word], of_heads - np.bincount(head, weights=after.t, minlength=len(of_heads)).astype(np.int64)
                    for _ in range(LOCAL):
                        after = sweep(after, below, p, head, d[1], rng, more)
                customers = customers[:v] + np.bincount(word, weights=after.t, minlength=v).astype(np.int64)
                state = state or Seating.first(customers)
                state = sweep(state, customers, spelled, np.zeros(v, np.int64), d[2], rng, np.array([totals[0] - state.t.sum()]))
                n = np.bincount(keys, weights=np.repeat(state.t, per)).astype(np.int64)
                gram = np.flatnonzero(n)
                out.append({"q": r.q, "data": _states(after, state), "grams": _pack(gram, n[gram]), "tables": int(state.t.sum()), "customers": int(customers.sum()),
                            "heads": _pack(*(np.bincount(head, weights=x, minlength=len(heads) + 1).astype(np.int64) for x in (after.t, below)))})
            return pd.DataFrame(out, columns=["q", "data", "grams", "tables", "customers", "heads"])

        told = up.where("q >= 0").select("q", "p", "data")
        if before is not None:
            told = told.unionByName(before.select("q", F.lit(-1).alias("p"), "data"))
        return staged(own_words.groupBy("q").cogroup(told.groupBy("q")).applyInPandas(seat, _SEATED), "hpyp")

    def spelling(seated: DataFrame, s: int) -> Spelling:
        def grams(batches):
            """Counts by a part of their keys."""
            for pdf in batches:
                for x in pdf["grams"]:
                    k, n = _unpack(x)
                    part = k >> (5 * ORDER + 4)
                    ends = [*_edges(part).tolist(), len(k)]
                    yield pd.DataFrame([{"part": int(part[i]), "data": _pack(k[i:j], n[i:j])} for i, j in zip(ends, ends[1:])])

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:
            got = [_unpack(x) for x in pdf["data"]]
            k, of = _number(np.concatenate([x[0] for x in got]))
            n = np.bincount(of, weights=np.concatenate([x[1] for x in got])).astype(np.int64)
            return pd.DataFrame([{"part": int(pdf["part"].iloc[0]), "data": _pack(k[n > 0], n[n > 0])}])

        parts = seated.select("grams").mapInPandas(grams, "part int, data binary").groupBy("part").applyInPandas(summed, "part int, data binary")
        got = [_unpack(bytes(r.data)) for r in sorted(parts.collect(), key=lambda r: r.part)]
        keys, n = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in got]]) for i in (0, 1))
        return Spelling(keys, n, seed + s)

    def down(seated: DataFrame, s: int, model, totals: tuple[int, int], of_heads: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """Probabilities of the words, and after heads, after sweep s, for each bucket that asks."""

        def tell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            for r, data in zip(left.itertuples(index=False), right["data"]):
                (after, state), (who, pairs) = _seatings(data), _who(r.who)
                log = root(state, _spelled(r.words, model.value)[0], totals)
                head, word = np.divmod(pairs, len(log))
                with np.errstate(divide="ignore"):
                    own = np.log(np.maximum(after.c - d[1] * after.t, 0))
                tables, customers = (x[head] for x in of_heads)
                log = np.concatenate([log, np.logaddexp(own, np.log(STRENGTH + d[1] * tables) + log[word]) - np.log(STRENGTH + customers)])
                out += [{"b": places[p], "p": p, "k": s, "q": r.q, "data": _pack(log[at])} for p, at in who.items()]
            return pd.DataFrame(out, columns=["b", "p", "k", "q", "data"])

        return own_words.groupBy("q").cogroup(seated.select("q", "data").groupBy("q")).applyInPandas(tell, _DOWN)

    def carried(up: DataFrame, s: int) -> DataFrame:
        return up.where("q = -1").select("b", "p", F.lit(s).alias("k"), "q", "data")

    def seat_contexts(told: DataFrame, s: int, opened: np.ndarray) -> DataFrame:
        def seat(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            right = right.sort_values("q")
            for r in left.itertuples(index=False):
                own, mine = Seats(*_unpack(r.seats)), right[right["p"] == r.p]
                says = mine[mine["q"] >= 0]
                given = [_unpack(x)[0] for x in says["data"]]
                state = [_seatings(x) for x in mine["data"][mine["q"] < 0]]
                low, high = own.sweeps(*(state[0] if state else own.first()), np.concatenate(given), d, np.random.default_rng([seed, 0, r.p, s]), opened)
                out.append({"q": -1, "b": r.b, "p": r.p, "data": _states(low, high)})
                out += _shared(own, low, r.b, r.p)
                for q, x in zip(says["q"].tolist(), np.split(own.tables(low, high), np.cumsum([len(g) for g in given])[:-1])):
                    out.append({"q": q, "b": r.b, "p": r.p, "data": _pack(x)})
            return pd.DataFrame(out, columns=["q", "b", "p", "data"])

        return staged(shapes.groupBy("b").cogroup(told.groupBy("b")).applyInPandas(seat, _UP), "hpyp")

    def totals_of(seated: DataFrame) -> tuple[int, int]:
        return tuple(int(x or 0) for x in seated.agg(F.sum("tables"), F.sum("customers")).first())

    def heads_of(seated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Tables and customers of the heads' restaurants, from 1 on."""
        out = np.zeros((2, len(heads) + 1), np.int64)
        for r in seated.select("heads").toLocalIterator() if len(heads) else ():
            out += np.stack(_unpack(bytes(r.heads)))
        return tuple(out)

    def several_of(up: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The same of the contexts of two words that several buckets have."""
        out = np.zeros((2, len(several) + 1), np.int64)
        for r in up.where("q = -2").select("data").toLocalIterator() if len(several) else ():
            at, *x = _unpack(bytes(r.data))
            out[:, at] += np.stack(x)
        return tuple(out)

    none = np.zeros(0, np.int64)
    send = spark.sparkContext.broadcast
    seated, up, told = seat_words(asked, None, 0, send(Spelling(none, none, 0)), (opened, 0), np.zeros(len(heads) + 1, np.int64)), None, None
    gone, kept, of_heads, of_several, known = [], None, heads_of(seated), several_of(asked), {}
    for s in range(1, SWEEPS + 1):
        model, totals = send(spelling(seated, s - 1)), totals_of(seated)
        told = down(seated, s - 1, model, totals, of_heads)
        new = seat_contexts(told if up is None else told.unionByName(carried(up, s - 1)), s, of_several[0])
        again = seat_words(new, seated, s, model, totals, of_heads[0])
        for old, of in ((up, s - 1), (seated, s - 1)):
            if old is not None and of <= BURN_IN:
                drop_staged(old)
            elif old is not None:
                gone.append(old)
        seated, up = again, new
        of_heads, of_several = heads_of(seated), several_of(up)
        known[s] = of_several
        if s > BURN_IN:
            after = down(seated, s, send(spelling(seated, s)), totals_of(seated), of_heads).unionByName(carried(up, s))
            kept = after if kept is None else kept.unionByName(after)
    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The documents' sums of a bucket, by run: log10 probabilities in POINT-ths."""
        out = []
        right = right.sort_values(["k", "q"])
        for r in left.itertuples(index=False):
            own, logs = Bucket(_unpack(r.shape)), []
            for k, one in right[right["p"] == r.p].groupby("k"):
                given = np.concatenate([_unpack(x)[0] for x in one["data"][one["q"] >= 0]])
                logs.append(own.triples(*_seatings(one["data"][one["q"] < 0].iloc[0]), given, d, *known[k]))
            log = np.rint((np.logaddexp.reduce(logs) - math.log(len(logs))) / math.log(10) * -POINT).astype(np.int64)
            rb, run, entries, step, doc, n = _unpack(r.places)
            ends = np.cumsum(entries)
            for b, k, i, j in zip(rb.tolist(), run.tolist(), (ends - entries).tolist(), ends.tolist()):
                total = np.bincount(doc[i:j], weights=n[i:j] * log[np.cumsum(step[i:j])]).astype(np.int64)
                some = np.flatnonzero(np.bincount(doc[i:j]))
                out.append({"rb": b, "run": k, "q": -1, "at": _pack(np.diff(some, prepend=0), total[some])})
        return pd.DataFrame(out, columns=["rb", "run", "q", "at"])

    floor = math.log10(1 / (tokens + 0.1 * (types + 1))) if tokens or types else 1.0

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples(index=False):
            mine = right[right["run"] == r.run]
            size, crc = _unpack(r.docs)[0], _word_bucket(_words(r.words), word_buckets)
            c, total = np.zeros(len(crc), np.int64), np.zeros(len(size), np.int64)
            for q, x in zip(mine["q"].tolist(), mine["at"]):
                at, value = _unpack(x)
                if q < 0:
                    total[np.cumsum(at)] += value
                else:
                    c[crc == q] = value
            first = np.cumsum(size) - size
            of = c[_unpack(r.tokens)[0]]
            known = np.frombuffer(r.ids, "u1", len(size), offset=8 * len(size)) > 0
            ids = pd.array(np.frombuffer(r.ids, "<i8", len(size)), dtype="Int64")
            ids[~known] = pd.NA
            base = np.add.reduceat(np.log10(of + 0.1), first) + floor * size
            out.append(pd.DataFrame({"doc_id": ids, "n_tokens": size, "n_known": np.add.reduceat((of > 0).astype(np.int64), first), "base_score": base, "score": -total / POINT}))
        trim()
        return pd.concat(out)

    part = parts.select("b", "p", "shape", "places").groupBy("b").cogroup(kept.groupBy("b")).applyInPandas(scored, "rb int, run long, q int, at binary")
    part = part.unionByName(back.select("rb", "run", "q", "at"))
    every = runs.select("rb", "run", "words", "tokens", "docs", "ids").groupBy("rb").cogroup(part.groupBy("rb")).applyInPandas(summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    done = staged(every.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"), "hpyp")
    for old in (*gone, seated, up, asked, words, vocabulary, parts, runs):
        drop_staged(old)
    return done
