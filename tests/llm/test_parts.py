"""Parts of operators on their own."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklog.llm import hpyp, packing, seating, secret_scan, simhash, simple8b, vector_dedup
from sparklog.llm.shared import components

from . import brute as B


def test_window_entropy_and_many_spans(spark):
    r = random.Random(1)
    letters = "ABCDEFghijklmn0123456789+/"
    texts = ["".join(r.choice(letters) for _ in range(n)) for n in (0, 1, 23, 24, 25, 200)] + ["a" * 50]
    entropy = lambda x: -sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values()) if x else 0.0
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", secret_scan.window_entropy(F.col("s"), 24).alias("e")).collect()
    for x in rows:
        s = texts[x.i]
        assert x.e == pytest.approx(max(entropy(s[i : i + 24]) for i in range(max(1, len(s) - 23))), abs=1e-9)
    text = " ".join(f"{r.getrandbits(64):016x}" for _ in range(2000))
    found = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found.base_spans) == B.op9(1, text)[1]


def test_simple8b():
    r = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 3000):
        for high in (0, 1, 100, 1 << 17, 1 << 59, 1 << 60, (1 << 64) - 1):
            v = r.integers(0, high, n, dtype=np.uint64, endpoint=True)
            words, offsets = simple8b.encode(v)
            assert (simple8b.decode(words) == v).all()
            for b, at in enumerate(offsets.tolist()):  # any block alone
                end = offsets[b + 1] if b + 1 < len(offsets) else len(words)
                assert (simple8b.decode(words[at:end]) == v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_packing():
    r = random.Random(2)
    for _ in range(30):
        sizes = [r.choice((1, 5, 90, 100, 101, 350, r.randrange(1, 400))) for _ in range(r.randrange(1, 80))]
        used: dict = {}
        seen: dict = {}
        for doc, at, n, b in packing.pack(sizes, 100):
            used[b] = used.get(b, 0) + n
            seen.setdefault(doc, []).append((at, n))
        assert max(used.values()) <= 100 and 100 * len(used) - sum(sizes) < 100
        for doc, parts in seen.items():
            assert sum(n for _, n in parts) == sizes[doc] and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))


def test_ball_links_when_split(monkeypatch):
    import pandas as pd

    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    flip = lambda k: np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False)))
    fps = np.unique(np.concatenate([base] + [base ^ flip(k) for k in (1, 2, 3, 4, 5)] + [base[:1] ^ flip(3) for _ in range(80)]))
    ids = fps.view(np.int64).tolist()
    want = B.classes(ids, [(ids[i], ids[j]) for i in range(len(ids)) for j in (np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1).tolist()])
    frame = pd.DataFrame({"fp": ids, "id": ids, "group": ids, "left": 2, "parts": 1, "part": 0} | {c: np.zeros(len(ids), np.int64) for c in simhash.CHECKS})
    for task in (10**9, 20_000, 3_000):
        monkeypatch.setattr(simhash, "TASK_VARIANTS", task)
        got = simhash._bucket_links(frame, 64, 2)
        assert B.classes(ids, list(zip(got.a.tolist(), got.b.tolist()))) == want


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = B.classes({x for e in edges for x in e}, edges)
    assert all(want[k] == v for k, v in got.items()) and {k for e in edges if e[0] != e[1] for k in e} == set(got)


def customerwise(c, p, d, sweeps, r):
    """Mean tables of the dishes of one restaurant: every customer leaves and is seated anew."""
    tables, total = [[n] for n in c], np.zeros(len(c))
    for s in range(sweeps):
        for w in range(len(c)):
            for _ in range(c[w]):
                k = r.choices(range(len(tables[w])), tables[w])[0]
                tables[w][k] -= 1
                tables[w] = [n for n in tables[w] if n]
                new = (seating.STRENGTH + d * sum(map(len, tables))) * p[w]
                k = r.choices(range(len(tables[w]) + 1), [*(n - d for n in tables[w]), new])[0]
                tables[w] = [n + (i == k) for i, n in enumerate(tables[w])] + [1] * (k == len(tables[w]))
        if s >= sweeps // 5:
            total += [len(x) for x in tables]
    return total / (sweeps - sweeps // 5)


@pytest.mark.parametrize("exact", [48, 4])
def test_seating_as_customer_by_customer(monkeypatch, exact):
    monkeypatch.setattr(seating, "EXACT", exact)
    monkeypatch.setattr(seating, "memo", lambda owner: {})
    r = np.random.default_rng(4)
    c, p, d = np.array([2, 3, 5, 8, 20, 1, 30, 6]), np.array([0.1, 0.05, 0.2, 0.02, 0.05, 0.01, 0.3, 0.01]), 0.6
    now, total, n = seating.Seating.first(c), np.zeros(len(c)), 2500
    for s in range(n):
        now = seating.sweep(now, c, np.log(p), np.zeros(len(c), np.int64), d, r, np.zeros(1, np.int64))
        assert ((now.t >= 1) & (now.t <= c)).all() and now.sizes.sum() == c[c > exact].sum() and len(now.sizes) == now.t[c > exact].sum()
        total += now.t * (s >= n // 5)
    want = customerwise(c.tolist(), p.tolist(), d, 700, random.Random(1))
    assert total / (n - n // 5) == pytest.approx(want, rel=0.17)


def test_seating_follows_its_customers():
    r = np.random.default_rng(5)
    c = r.integers(0, 300, 400)
    now, group = seating.Seating.first(c), r.integers(0, 9, 400)
    for _ in range(6):
        c = np.where(r.random(400) < 0.3, np.maximum(c + r.integers(-90, 90, 400), (c > 0).astype(int)), c)
        now = seating.sweep(now, c, np.log(r.random(400) / 50), group, 0.5, r, np.zeros(9, np.int64))
        assert ((now.t >= (c > 0)) & (now.t <= c)).all() and (now.sizes > 0).all()
        ends = np.cumsum(now.t[c > seating.EXACT])
        assert [int(x.sum()) for x in np.split(now.sizes, ends[:-1])] == c[c > seating.EXACT].tolist()
    few, many = (seating.sweep(seating.Seating.first(np.full(300, 30)), np.full(300, 30), np.full(300, np.log(p)), np.arange(300), 0.5, r, np.zeros(300, np.int64)).t.mean() for p in (1e-4, 0.9))
    assert few < many


def plain_model(train, sweeps, seed, d, spelled):
    """Probability of a word after two words, by a sampler that moves one customer at a time
    through restaurants of two words, one, none."""
    r, seats = random.Random(seed), {}
    path = lambda a, b: [(a, b), (b,), ()]

    def prob(chain, w, level=0):
        if level == 3:
            return spelled[w]
        rest = seats.get(chain[level], {})
        c, t = sum(map(sum, rest.values())), sum(map(len, rest.values()))
        own = rest.get(w, [])
        return ((sum(own) - d[level] * len(own)) + (seating.STRENGTH + d[level] * t) * prob(chain, w, level + 1)) / (seating.STRENGTH + c)

    def add(chain, w, level=0):
        if level == 3:
            return
        rest = seats.setdefault(chain[level], {})
        own = rest.setdefault(w, [])
        t = sum(map(len, rest.values()))
        k = r.choices(range(len(own) + 1), [*(n - d[level] for n in own), (seating.STRENGTH + d[level] * t) * prob(chain, w, level + 1)])[0]
        if k == len(own):
            own.append(0)
            add(chain, w, level + 1)
        own[k] += 1

    def drop(chain, w, level=0):
        if level == 3:
            return
        own = seats[chain[level]][w]
        k = r.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            drop(chain, w, level + 1)

    tokens = [(path(a, b), w) for a, b, w in train]
    for chain, w in tokens:
        add(chain, w)
    total, kept = {}, 0
    for s in range(sweeps):
        for chain, w in tokens:
            drop(chain, w)
            add(chain, w)
        if s >= sweeps // 4:
            kept += 1
            for a, b, w in set(train):
                total[a, b, w] = total.get((a, b, w), 0) + prob(path(a, b), w)
    return {k: v / kept for k, v in total.items()}


def test_model_as_one_customer_at_a_time(spark, monkeypatch):
    """Scores of texts against a plain sampler's, which gets the spelling as it is."""
    r = random.Random(3)
    voc = ["ab", "cd", "ef", "gh", "ij"]
    texts = [" ".join(r.choice(voc if r.random() < 0.6 else voc[:2]) for _ in range(r.randrange(3, 9))) for _ in range(40)]
    spelled = {}
    monkeypatch.setattr(hpyp, "SWEEPS", 8)
    monkeypatch.setattr(hpyp, "BURN_IN", 2)
    flat = hpyp.Spelling(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    for w in [*voc, " "]:
        spelled[w] = float(np.exp(flat.log(hpyp._bytes_of([w.encode()])[0]).sum()))
    monkeypatch.setattr(hpyp.Spelling, "__init__", lambda self, *a: self.__dict__.update(flat.__dict__))
    asked = []
    monkeypatch.setattr(hpyp, "discount", lambda a, b: asked.append(seating.discount(a, b)) or asked[-1])
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean")
    got = {x.doc_id: x.score for x in hpyp.score(df).collect()}
    train = []
    for t in texts:
        w = [" ", " ", *t.split(), " "]
        train += list(zip(w, w[1:], w[2:]))
    want = plain_model(train, 60, 1, asked, spelled)
    for i, t in enumerate(texts):
        w = [" ", " ", *t.split(), " "]
        assert got[i] == pytest.approx(sum(math.log10(want[x]) for x in zip(w, w[1:], w[2:])), rel=0.06)


def test_common_contexts_are_split(spark, monkeypatch):
    """A word and a pair that most tokens follow: nothing is lost when they have many slices."""
    r = random.Random(5)
    texts = [" ".join(["a b"] * r.randrange(1, 30) + [r.choice("cdefg") for _ in range(5)]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, i % 4 > 0) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean")
    whole = {x.doc_id: x for x in hpyp.score(df).collect()}
    monkeypatch.setattr(hpyp, "SLICE", 200)
    split = {x.doc_id: x for x in hpyp.score(df).collect()}
    for i, x in whole.items():
        assert (split[i].n_tokens, split[i].n_known, split[i].train_tokens, split[i].base_score) == (x.n_tokens, x.n_known, x.train_tokens, pytest.approx(x.base_score))
        assert split[i].score == pytest.approx(x.score, rel=0.35)


def test_slices_are_of_one_model(spark, monkeypatch):
    """Common contexts that many buckets seat have the scores that they have in one."""
    r = random.Random(5)
    texts = [" ".join(["a b"] * r.randrange(1, 30) + [r.choice("cdefg") for _ in range(5)]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, i % 4 > 0) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean")
    whole = {x.doc_id: x.score for x in hpyp.score(df).collect()}
    monkeypatch.setattr(hpyp, "SLICE", 40)
    split = {x.doc_id: x.score for x in hpyp.score(df).collect()}
    assert split == pytest.approx(whole, rel=0.08)  # two seeds differ by 0.04
    assert sum(split.values()) == pytest.approx(sum(whole.values()), rel=0.02)


def test_spelling_is_a_distribution():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << (5 * hpyp.ORDER + 8), 4000))
    model = hpyp.Spelling(keys, np.random.default_rng(6).integers(1, 50, len(keys)), 1)
    for context in [0, int(keys[0] >> 8), int(keys[-1] >> 8)]:
        assert np.exp(model.log((context << 8) | np.arange(256))).sum() == pytest.approx(1)


@pytest.mark.parametrize("dim, n", [(2, 5000), (8, 20_000), (64, 200), (64, 4500), (64, 25_000), (256, 100_000)])
def test_every_vector_has_filters_and_links_share_one(dim, n):
    r = np.random.default_rng(dim + n)
    a, z = (vector_dedup._unit(r.standard_normal((2000, dim))) for _ in range(2))
    z = vector_dedup._unit(z - (z * a).sum(1, keepdims=True) * a)
    caps = vector_dedup.CapFilters(dim, n * vector_dedup.FILTERS // vector_dedup.BUCKET)
    (row, x), (_, y) = caps.decode(a), caps.decode(0.98 * a + math.sqrt(1 - 0.98**2) * z)
    assert (np.bincount(row, minlength=2000) == vector_dedup.FILTERS).all()
    total = np.zeros((5, 1))
    for p in caps.products(a[:5]):  # all directions, in order
        total = (total[:, :, None] + p[:, None, :]).reshape(5, -1)
    least = np.sort(total, axis=1)[:, -vector_dedup.FILTERS]
    assert all((total[i, f] >= least[i] - 1e-12).all() for i, f in enumerate(x.reshape(2000, -1)[:5]))
    shared = [len(np.intersect1d(p, q)) > 0 for p, q in zip(x.reshape(2000, -1), y.reshape(2000, -1))]
    assert np.mean(shared) >= 0.998


@pytest.mark.parametrize("n", [15, 38, 60, 120, 250, 500])
@pytest.mark.parametrize("where", ["front", "back", "spread"])
def test_recall_of_edited_items(n, where):
    """Items with all the edits that they may have, beside shorter and longer items."""
    from sparklog.llm import decontaminate as D

    r = random.Random(n)
    word = lambda: f"w{r.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(m))) for i, m in enumerate([n] * 60 + [int(n / 1.25), int(n * 1.2)])]
    texts = []
    for _, t in items[:60]:
        w = t.split()
        k = D.allowed(n)
        places = {"front": range(max(k, n // 4)), "back": range(n - max(k, n // 4), n), "spread": range(n)}[where]
        for at in sorted(r.sample(places, k), reverse=True):
            w[at : at + r.randrange(2)] = [word()] * r.randrange(2)
        texts.append(" ".join([word() for _ in range(r.randrange(80))] + w + [word() for _ in range(r.randrange(80))]))
    found = D._matches(texts, D.Index(items))
    assert sum(any(m[0] == i for m in ms) for i, ms in enumerate(found)) >= 57
    for t, ms in zip(texts[:6], found):
        for i, _, _, edits, size in ms:
            assert size == len(items[i][1].split()) and B.distance7(items[i][1].split(), t.split()) == edits <= size // 5
