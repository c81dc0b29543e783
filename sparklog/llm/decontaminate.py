"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are words (runs of letters and digits, lower-cased). A document is contaminated by
an item if some stretch of it is within an edit distance of floor(0.2 * words of the item).

Windows of an item's size are embedded by the CGK random walk: step by step the walk writes the
word it stands on and then moves on or stays, by a random bit of (step, word). So edit distance
becomes Hamming distance, and keys of a few sampled places of the walk collide for similar
texts. An item of more than LONGEST words is looked for by parts of even length, as one of them
has no greater share of edits than the item. Items (or parts) of near lengths share windows of
the shortest one's size; a longer one is looked for by its first words and by its last. For each size the numbers of walks and of sampled
places follow from a simulation: items with all the edits that they may have, spread or all in
one half, must be found with probability RECALL. Every collision is verified by an exact
alignment. Windows that hold too few of the benchmark's word pairs to be within the distance of
any item are not embedded: an edit destroys two word pairs at most, so this loses nothing.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import memo, trim

SIMILARITY, TABLES = 0.8, 16
#: Items whose lengths differ by no more than this factor share windows of the least length.
CLASS_FACTOR = 1.3
#: Words that an item is looked for by as a whole.
LONGEST = 160
#: The simulated recall, at allowed edits; items simulated; walks and sampled places to choose
#: from (the more places, the fewer windows collide by chance).
RECALL, TRIALS, MOST_WALKS, SAMPLES = 0.99, 100, 16, (3, 2, 1)
#: Items that one pass looks for; a larger benchmark takes more passes over the documents.
PASS_ITEMS = 20_000
#: Words of text that are searched at a time.
RUN_WORDS = 400_000
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_TABLE).split()


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return int(n * (1 - SIMILARITY) + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walks:
    """CGK walks over numbered words, and LSH keys of sampled places.

    Of a window's 3n steps those after 9n/4 are not made, as no place there is sampled: by then
    the walk, which moves on at every other step, has left the window."""

    def __init__(self, words: int):
        self.words, self.made = words, {}

    def bit(self, walk: int, step: int) -> np.ndarray:
        """Whether the walk moves on, for each word."""
        if (walk, step // 64) not in self.made:
            of = np.arange(self.words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            self.made[walk, step // 64] = _mix(of + _mix(np.uint64(97 * (walk + 1) + (step // 64 << 20)).reshape(1)))
        return self.made[walk, step // 64] >> np.uint64(step % 64) & np.uint64(1)

    def keys(self, flat: np.ndarray, start: np.ndarray, n: int, stop: np.ndarray, walk: int, sampled: int) -> np.ndarray:
        """Keys (window, table) of windows of n words from start, cut at stop."""
        end, at, last = np.minimum(start + n, stop), start.copy(), len(flat) - 1
        places = np.random.default_rng([3, n, walk]).integers(0, max(1, 9 * n // 4), (TABLES, sampled))
        asked, used = set(places.ravel().tolist()), {}
        for j in range(int(places.max()) + 1):
            w = np.where(at < end, flat[np.minimum(at, last)], self.words)
            if j in asked:
                used[j] = w
            at = at + self.bit(walk, j)[w].astype(np.int64)
        out = np.zeros((len(start), TABLES), np.uint64)
        for t in range(TABLES):
            h = np.full(len(start), (n << 16) + t, np.uint64)
            for p in places[t].tolist():
                h = _mix(h * np.uint64(0x100000001B3) + used[p].astype(np.uint64) + np.uint64(1))
            out[:, t] = h
        return out


def plan(size: int, longest: int) -> tuple[int, int]:
    """(walks, sampled places) for windows of a size that serve items of up to longest words."""
    rng = np.random.default_rng([5, size, longest])
    k, fill = allowed(longest), 0
    lists = []
    for trial in range(TRIALS):
        item = np.arange(longest) + trial * longest + 1
        text = item.tolist()
        upto = longest if trial % 2 else max(1, longest // 2)  # spread, or all in the first half
        for at in sorted(rng.choice(upto, min(k, upto), replace=False).tolist(), reverse=True):
            fill -= 1
            text[at : at + int(rng.integers(0, 2))] = [fill] * int(rng.integers(0, 2))
        lists.append(text)
    words = TRIALS * longest + 1
    lists = [[x if x > 0 else words - x for x in t] for t in lists]
    words += 1 - fill
    flat = np.array([x for t in lists for x in t] + [0], np.int64)
    own = np.repeat(np.arange(TRIALS), [len(t) for t in lists])
    end = np.cumsum([len(t) for t in lists])
    start = np.arange(len(own))
    near = start - (end - [len(t) for t in lists])[own] <= longest - size + k
    start, own = start[near], own[near]
    items = np.append(np.arange(TRIALS * longest) + 1, 0)
    head = np.arange(TRIALS) * longest
    walks = Walks(words)
    for sampled in SAMPLES:
        found = np.zeros(TRIALS, bool)
        for walk in range(MOST_WALKS):
            got = walks.keys(flat, start, size, end[own], walk, sampled)
            for first in (head, head + longest - size):
                keys = walks.keys(items, first, size, head + longest, walk, sampled)
                found[own[(got == keys[own]).any(1)]] = True
            if found.mean() >= RECALL:
                return walk + 1, sampled
    return MOST_WALKS, SAMPLES[-1]


class Index:
    """Items by length, their word pairs and their LSH keys. plans: walks and places by size."""

    def __init__(self, items: list[tuple[int, str]], plans: dict[int, tuple[int, int]] | None = None):
        parsed = [(i, words_of(t)) for i, t in items]
        parsed = [(i, w) for i, w in parsed if w]
        self.items = [i for i, _ in parsed]
        self.vocabulary: dict[bytes, int] = {}
        for _, w in parsed:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        v = len(self.vocabulary) + 1
        self.base = v
        self.words = [np.array([self.vocabulary[x] for x in w], np.int64) for _, w in parsed]
        # Parts of items: whose, from where, how many words.
        parts = []
        for i, w in enumerate(self.words):
            cuts = np.linspace(0, len(w), -(-len(w) // LONGEST) + 1).astype(int).tolist()
            parts += [(i, a, b - a) for a, b in zip(cuts, cuts[1:])]
        part = np.array(parts, np.int64).reshape(-1, 3)
        self.class_of: dict[int, int] = {}  # the window's words, by the part's words
        for n in sorted(set(part[:, 2].tolist())):
            first = max(self.class_of.values(), default=0)
            self.class_of[n] = first if first and n <= CLASS_FACTOR * first else n
        self.lengths = sorted(set(self.class_of.values()))
        pairs = [w[:-1] * v + w[1:] for w in self.words if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        # A Bloom-like table of the pairs answers most look-ups.
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self._slot(self.pairs)] = True
        of_class = {c: [n for n, k in self.class_of.items() if k == c] for c in self.lengths}
        # Pairs of words, and words, that a stretch near an item of the class has at least.
        self.need = {c: min(max(0, n - 1 - 2 * allowed(n)) for n in ns) for c, ns in of_class.items()}
        self.least = {c: min(n - allowed(n) for n in ns) for c, ns in of_class.items()}
        self.most = {c: max(n + allowed(n) for n in ns) for c, ns in of_class.items()}
        self.plans = {c: (plans or {}).get(c) or plan(c, max(ns)) for c, ns in of_class.items()}
        self.walks = Walks(v)
        flat = np.concatenate([*self.words, np.zeros(1, np.int64)]) if self.words else np.zeros(1, np.int64)
        size = np.array([len(w) for w in self.words], np.int64)
        start = np.cumsum(size) - size
        owner, begin, n = part.T
        window = np.array([self.class_of[x] for x in n.tolist()], np.int64)
        self.step = np.maximum(8, size // 16)
        self.keys: dict[tuple[int, int], tuple] = {}  # by size and walk: keys, items, where the window begins in the item
        for c in self.lengths:
            mine = np.flatnonzero(window == c)
            longer = mine[n[mine] > c]
            whose = np.concatenate([owner[mine], owner[longer]])
            shift = np.concatenate([begin[mine], begin[longer] + n[longer] - c])
            for walk in range(self.plans[c][0]):
                k = self.walks.keys(flat, start[whose] + shift, c, (start + size)[whose], walk, self.plans[c][1]).ravel()
                order = np.argsort(k, kind="stable")
                quick = np.zeros(1 << 18, bool)
                quick[k >> np.uint64(46)] = True
                self.keys[c, walk] = k[order], np.repeat(whose, TABLES)[order], np.repeat(shift, TABLES)[order], quick

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def is_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((a > 0) & (b > 0))
        pair = a[at] * self.base + b[at]
        some = self.quick[self._slot(pair)]
        at, pair = at[some], pair[some]
        out = np.zeros(len(a), bool)
        if len(self.pairs):
            k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            out[at[self.pairs[k] == pair]] = True
        return out

    def search(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows (doc, item, first word, words, distance): for each document and item the
        stretch of least distance. flat: word numbers, 0 for words of no item and once more at
        the end; begin and end bound the documents."""
        if not len(self.items) or not len(flat):
            return np.zeros((0, 5), np.int64)
        doc_of = np.repeat(np.arange(len(begin)), end - begin)
        n = len(doc_of)
        hit = self.is_pair(flat[:-1], flat[1:])[:n]
        hit[end[end > begin] - 1] = False
        upto = np.concatenate([[0], np.cumsum(hit)])
        stop = end[doc_of]
        pos = np.arange(n)
        widest = max(self.most.values())
        near = upto[np.minimum(pos + widest, stop)] - upto[pos]
        pos = pos[near >= min(self.need.values())]
        found = [np.zeros((0, 2), np.int64)]
        for m in self.lengths:
            enough = upto[np.minimum(pos + self.most[m], stop[pos])] - upto[pos] >= self.need[m]
            enough &= stop[pos] - pos >= self.least[m] - (self.most[m] - m)
            start = pos[enough]
            for i in range(0, len(start), 25_000):
                found.append(self._collide(flat, start[i : i + 25_000], m, begin[doc_of], stop))
        return self._verify(flat, np.unique(np.concatenate(found), axis=0), doc_of, begin, end)

    def _collide(self, flat, start, n, begin, stop) -> np.ndarray:
        """(place, item) of windows of n words that share a key with an item, place being where
        the item would begin, rounded down to eight words of its text, or a sixteenth of a long
        item: near windows are verified together."""
        out = []
        for walk in range(self.plans[n][0]):
            keys, owner, shift, quick = self.keys[n, walk]
            k = self.walks.keys(flat, start, n, stop[start], walk, self.plans[n][1]).ravel()
            some = np.flatnonzero(quick[k >> np.uint64(46)])
            lo = np.searchsorted(keys, k[some], "left")
            many = np.searchsorted(keys, k[some], "right") - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            place = start[np.repeat(some // TABLES, many)]
            first = begin[place]
            place = np.maximum(place - shift[at], first)
            out.append(np.stack([place - (place - first) % self.step[owner[at]], owner[at]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def _verify(self, flat, pairs, doc_of, begin, end) -> np.ndarray:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        size = np.array([len(w) for w in self.words])
        for m in np.unique(size[pairs[:, 1]]).tolist():
            group = pairs[size[pairs[:, 1]] == m]
            k = allowed(m)
            some = max(1, min(4096, 2_000_000 // m))
            for i in range(0, len(group), some):
                place, item = group[i : i + some].T
                doc = doc_of[place]
                lo = np.maximum(place - k, begin[doc])
                width = m + 2 * k + max(8, m // 16)
                cols = lo[:, None] + np.arange(width)
                text = np.where(cols < end[doc][:, None], flat[np.minimum(cols, len(flat) - 1)], -1)
                pattern = np.stack([self.words[x] for x in item.tolist()])
                dist, last = _align(pattern, text)
                for j in np.flatnonzero(dist <= k).tolist():
                    row = text[j, : last[j]][::-1]
                    _, taken = _align(pattern[j : j + 1, ::-1], row[None, :], anchored=True)
                    first = int(lo[j] + last[j] - taken[0] - begin[doc[j]])
                    new = (int(dist[j]), first, int(taken[0]))
                    key = (int(doc[j]), int(item[j]))
                    if key not in best or new < best[key]:
                        best[key] = new
        return np.array([(d, i, f, n, e) for (d, i), (e, f, n) in sorted(best.items())], np.int64).reshape(-1, 5)


def _align(pattern: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least edit distance between the pattern and a stretch of the text
    (anchored: one that begins at its first word), and the place after the stretch's end; of
    equal distances the earliest end. -1 in a text matches nothing."""
    rows, m = pattern.shape
    step = np.arange(m + 1)
    col = np.broadcast_to(step, (rows, m + 1)).copy()
    best, last = col[:, m].copy(), np.zeros(rows, np.int64)
    for j in range(text.shape[1]):
        c = text[:, j]
        new = np.empty_like(col)
        new[:, 0] = j + 1 if anchored else 0
        new[:, 1:] = np.minimum(col[:, :-1] + (pattern != c[:, None]), col[:, 1:] + 1)
        new = np.minimum.accumulate(new - step, axis=1) + step
        col = new
        better = (col[:, m] < best) & (c >= 0)
        best[better], last[better] = col[better, m], j + 1
    return best, last


def _matches(texts: list[str], index: Index) -> list[list[tuple]]:
    """(item, first word, words, distance) of each text."""
    out: list[list[tuple]] = [[] for _ in texts]
    i = 0
    while i < len(texts):
        lists, total, first = [], 0, i
        while i < len(texts) and total < RUN_WORDS:
            lists.append(words_of(texts[i]))
            total += len(lists[-1])
            i += 1
        flat = np.zeros(total + 1, np.int64)
        size = np.array([len(x) for x in lists], np.int64)
        end = np.cumsum(size)
        for x, e, n in zip(lists, end.tolist(), size.tolist()):
            flat[e - n : e] = np.fromiter(map(index.vocabulary.get, x, repeat(0)), np.int64, n)
        for d, item, at, n, e in index.search(flat, end - size, end).tolist():
            out[first + d].append((index.items[item], at, n, e, len(index.words[item])))
    return out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "matches") -> DataFrame:
    """Adds to docs an array of struct(item_id, first_word, n_words, distance, item_words):
    for each item the stretch of the text nearest to it, where that is near enough.

    Items (item_id, text) without words or id are left out; of items with one id all count.
    Null and empty texts match nothing. A column of that name is replaced. The benchmark goes
    to the tasks in passes of PASS_ITEMS items; the documents are never shuffled."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    kind = "array<struct<item_id:long,first_word:int,n_words:int,distance:int,item_words:int>>"
    out = docs.withColumn(name, F.array().cast(kind))
    while items := [(r.item_id, r.text) for r in islice(rows, PASS_ITEMS)]:
        sent = docs.sparkSession.sparkContext.broadcast((items, Index(items).plans))

        @F.pandas_udf(kind)
        def matched(texts: pd.Series) -> pd.Series:
            kept, key = memo("decontaminate"), ("benchmark", hash(tuple(sent.value[0])))
            if key not in kept:
                kept[key] = Index(*sent.value)
            found = _matches(texts.tolist(), kept[key])
            trim()
            return pd.Series([[dict(zip(("item_id", "first_word", "n_words", "distance", "item_words"), m)) for m in ms] for ms in found])

        out = out.withColumn(name, F.concat(name, matched(F.coalesce(F.col(text), F.lit("")))))
    return out
