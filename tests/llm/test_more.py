"""Measured recall, plain versions of what the methods add, hot keys, long texts."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklog.llm import packing, quality, secret_scan
from sparklog.llm import queries as Q

from . import brute as B

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the tables")
def test_recall_of_similar_sets(spark):
    """Of all pairs of similarity 0.8 or more at least 99 in a hundred are in one group. Pairs are
    found by the rarest shingles, which loses none."""
    from sparklog.llm import simhash

    r = random.Random(9)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for k, (_, t) in enumerate(rows[:1500]):  # more near copies, of texts of all lengths
        w = (t or "").split()
        share = r.uniform(0.002, 0.03)
        rows.append((10**6 + k, " ".join(r.choice(w) + "q" if r.random() < share else x for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets: dict = {}
    for d, t in rows:
        w = B.low(t).split()
        sets.setdefault(frozenset(hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))) if w else frozenset(), d)
    df = Counter(x for s in sets for x in s)
    index = defaultdict(list)
    for s, d in sets.items():
        for x in sorted(s, key=lambda x: (df[x], x))[: len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1]:
            index[x].append((s, d))
    pairs = set()
    for rows in index.values():
        for i, (s, a) in enumerate(rows):
            for t, b in rows[:i]:
                if 0.8 * len(s) <= len(t) <= 1.25 * len(s) and (b, a) not in pairs and len(s & t) >= 0.8 * len(s | t):
                    pairs.add((b, a))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert len(pairs) > 800 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def entropy_spans(text):
    """All spans of a text, the entropy scan's too."""
    base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in B.op9(0, text)[1].split(",") if x)]
    out = [(a, i, k, b) for k, a, b in base for i in [["assign", "access", "hex"].index(k)]]
    for m in re.finditer(secret_scan.CANDIDATE, text):
        if any(a <= m.start() and m.end() <= b for _, a, b in base) or re.search(secret_scan.ALLOW, m[0]):
            continue
        for kind, pattern, width, bits in secret_scan.CLASSES:
            if re.search(pattern, m[0]):
                best = max(
                    -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values()) for i in range(max(1, len(m[0]) - width + 1)) for w in [m[0][i : i + width]]
                )
                if best >= bits:
                    out.append((m.start(), 3, kind, m.end()))
                break
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_added_spans(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    texts = []
    for k in range(150):
        parts = []
        for _ in range(r.randrange(12)):
            pool = r.choice([letters, letters[:26], letters[:52], "0123456789abcdef", "0123456789ABCDEF", letters[:5] + "01", "ab1"])
            parts.append(r.choice(["", "token=", "x", "password: ", "é", "example"]) + "".join(r.choice(pool) for _ in range(r.choice((5, 19, 20, 24, 40, 64)))))
        texts.append(r.choice([" ", "\n", ", ", '"']).join(parts))
    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {x.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in x.spans) for x in rows}
    assert got == {d: entropy_spans(t) for d, t in enumerate(texts)}
    assert sum("entropy" in x for x in got.values()) > 30


def test_bradley_terry_is_at_its_minimum(monkeypatch):
    """The weights are where the penalised logistic loss of the preferences is least."""
    monkeypatch.setattr(quality, "PAIRS", 4000)
    r = np.random.default_rng(3)
    x = r.standard_normal((400, len(quality.FEATURES)))
    good = x[:, 0] + 0.5 * x[:, 3] + r.standard_normal(400) > 0
    model = quality.Model(x, good)
    z = (model._spread(x) - model.mean) / model.scale
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(good), quality.PAIRS)] - z[draw.choice(np.flatnonzero(~good), quality.PAIRS)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality.PENALTY / 2 * w @ w
    w, at = np.zeros(z.shape[1]), np.inf
    for _ in range(3000):  # plain gradient descent
        step = quality.PENALTY * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0)
        w = w - 0.05 * step
        if abs(at - (at := loss(w))) < 1e-9:
            break
    assert loss(model.weights) <= at + 1e-6 and loss(model.weights) < 0.98 * math.log(2)
    pairs = model.strength(x)[good][:, None] > model.strength(x)[~good][None, :]
    assert pairs.mean() > 0.8


def folder(spark, at, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_hot_keys(spark, tmp_path, monkeypatch):
    """A third of the rows have no doc_id, a third have one, and many of those one text."""
    r = random.Random(2)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(30))
    text = lambda n: " ".join(word() for _ in range(n))
    same = text(80) + " under the MIT License token=abcdef0123456789abcd"
    rows = [(None, same if i % 2 else text(40)) for i in range(120)] + [(7, same if i % 2 else text(40)) for i in range(120)] + [(1000 + i, text(60)) for i in range(120)]
    at = folder(spark, str(tmp_path), rows)
    monkeypatch.setattr(packing, "GROUP_CHARS", 4000)
    out = {q: [x.asDict() for x in Q.QUERIES[q](spark, at).collect()] for q in ("op2_license_scan", "op3_token_output", "op5_quality", "op6_simhash", "op8_packing", "op9_secret_scan", "op10_lm_score")}
    for q, got in out.items():
        assert q == "op8_packing" or sorted(str(x["doc_id"]) for x in got) == sorted(str(d) for d, _ in rows), q
    by = lambda got, *k: Counter(tuple(x[c] for c in k) for x in got)
    assert by(out["op2_license_scan"], "doc_id", "n_words", "n_base") == Counter((d, *B.op2(d, t)[1:3]) for d, t in rows)
    assert by(out["op9_secret_scan"], "doc_id", "base_sha256") == Counter((d, B.op9(d, t)[0][4]) for d, t in rows)
    assert by(out["op6_simhash"], "doc_id", "fingerprint") == Counter((d, f"{B.op6_print(t):016x}") for d, t in rows)
    ids = B.ids_of([t for _, t in rows], 2)
    assert by(out["op3_token_output"], "doc_id", "n_tokens", "ids_crc32") == Counter((d, len(x), B.crc(x)) for (d, _), x in zip(rows, ids))
    assert sorted(x["start"] for x in out["op3_token_output"])[-1] + 0 < sum(map(len, ids))
    packed = defaultdict(list)
    for x in out["op8_packing"]:
        packed[x["sequence_id"]].append((x["offset"], x["length"]))
    assert sum(n for p in packed.values() for _, n in p) == sum(map(len, ids))
    for p in packed.values():
        p.sort()
        assert [o for o, _ in p] == np.cumsum([0] + [n for _, n in p])[:-1].tolist() and sum(n for _, n in p) <= 2048
    assert len({x["sequence_id"] >> 32 for x in out["op8_packing"]}) > 3  # not one task
    scores = defaultdict(set)
    for x in out["op5_quality"]:
        scores[x["doc_id"]].add(x["held_out"])
    assert scores[None] == {False}


def test_long_texts(spark, tmp_path):
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "license", "x1", "é"]) + str(r.randrange(500))
    long = " ".join(word() for _ in range(120_000)) + " Apache License, Version 2 " + " ".join(f"{r.getrandbits(80):020x}" for _ in range(300))
    rows = [(1, long), (2, "k" * 400_000), (3, long.replace("the1 ", "the2 ", 1)), (4, None), (5, "a " * 100_000)]
    at = folder(spark, str(tmp_path), rows)
    got = {q: {x.doc_id: x for x in Q.QUERIES[q](spark, at).collect()} for q in Q.QUERIES if q[2:4] not in ("1_", "4_", "7_", "8_")}
    for d, t in rows:
        x = got["op2_license_scan"][d]
        assert (x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == B.op2(d, t)
        assert got["op9_secret_scan"][d].base_sha256 == B.op9(d, t)[0][4]
        assert got["op6_simhash"][d].fingerprint == f"{B.op6_print(t):016x}"
        assert got["op10_lm_score"][d].n_tokens == len(B.low(t).split()) + 1
    assert {tuple(x) for x in got["op3_token_output"].values()} == B.op3([(d, t or "") for d, t in rows])


def test_ball_links_in_rounds(spark, monkeypatch):
    """Many prefixes are dealt round by round, with the same components."""
    from sparklog.llm import simhash
    from sparklog.llm.shared import components

    r = random.Random(4)
    rows = []
    for k in range(120):
        fps = [r.getrandbits(40) for _ in range(simhash.TABLES)]
        rows += [(t, fp, 2 * k, 2 * k) for t, fp in enumerate(fps)]
        rows += [(t, fp ^ sum(1 << i for i in r.sample(range(40), 4 if t == k % 16 else 12)), 2 * k + 1, 2 * k + 1) for t, fp in enumerate(fps)]
    df = spark.createDataFrame(rows, "table long, fp long, id long, group long").withColumns({c: F.lit(0).cast("long") for c in simhash.CHECKS})
    monkeypatch.setattr(simhash, "GROUP_VARIANTS", 240 * simhash.ball(40, 2) / 20)  # 32 prefixes, 16 rows a fingerprint
    dealt = []
    staged = simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda frame, name: dealt.append(frame) or staged(frame, name))
    got = {x.node: x.root for x in components(simhash.ball_links(df, 40, 4)).collect()}
    assert got == {2 * k + i: 2 * k for k in range(120) for i in (0, 1)}
    assert len(dealt) == 9  # two of 16 tables a round, and all rounds' links
    for copies in (2, 16, 29, 137):
        rounds = simhash._rounds(list(range(16)), copies)
        assert all(len(t) * copies / n <= simhash.ROUND_COPIES for t, _, n in rounds)
        assert sorted((t, s) for some, s, _ in rounds for t in some) == [(t, s) for t in range(16) for s in range(rounds[0][2])]
