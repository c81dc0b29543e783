"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. Pairs of a good and a bad labelled
document are preferences; their logistic loss on feature differences is minimised by Newton
steps. Then all documents get strengths, and the cut lies midway between two quantiles of those
of all labelled documents: the low TAIL of the good ones and the high TAIL of the bad ones. The
score is a logistic function of the strength that is 0.7 at the cut.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import memo

#: The fit takes this many labelled documents of each class at most, the first by a hash of
#: the doc_id, and so many pairs of them.
SAMPLE, PAIRS, PENALTY, TAIL = 6_000, 60_000, 1e-3, 0.002
CUT_SCORE = 0.7
FEATURES = ["words", "word_len", "distinct", "letters", "symbols", "upper", "digits", "bars", "bangs", "top_word", "short_words", "lines", "repeated_lines", "sentences", "capitalised", "repeated_shingles"]
_LETTER, _UPPER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b".,;:'\"()-?")] = True


def features(text: str) -> list[float]:
    """Features of a whole text, FEATURES by name; an empty text has zeros."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    counts = Counter(words)
    ink = max(1, n - int(chars[_SPACE].sum()))
    letters = int(chars[_LETTER].sum())
    lines = [x for x in raw.split(b"\n") if x]
    shingles = list(zip(words, words[1:], words[2:]))
    return [
        np.log1p(len(words)), ink / k, len(counts) / k, letters / ink, 1 - int(chars[_LETTER | _DIGIT | _PLAIN].sum()) / ink + int(chars[_SPACE].sum()) / ink,
        int(chars[_UPPER].sum()) / max(1, letters), int(chars[_DIGIT].sum()) / ink, int(chars[124]) / k, int(chars[33]) / k,
        (counts.most_common(1)[0][1] if words else 0) / k, sum(c for w, c in counts.items() if len(w) < 4) / k,
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), int(chars[46]) / k,
        sum(c for w, c in counts.items() if 65 <= w[0] < 91) / k, 1 - len(set(shingles)) / max(1, len(shingles)),
    ]


class Model:
    """Standardised features and hinges at their quartiles, weights, and the cut."""

    def __init__(self, x: np.ndarray, good: np.ndarray, seed: int = 7):
        self.knots = np.quantile(x, [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98], axis=0)
        raw = self._spread(x)
        self.mean, self.scale = raw.mean(0), raw.std(0) + 1e-9
        z = (raw - self.mean) / self.scale
        self.weights = np.zeros(z.shape[1])
        yes, no = np.flatnonzero(good), np.flatnonzero(~good)
        self.cut = 0.0
        if not len(yes) or not len(no):  # nothing to prefer: all alike
            self.cut = -1.0 if len(yes) or not len(no) else 1.0
            return
        rng = np.random.default_rng(seed)
        d = z[rng.choice(yes, PAIRS)] - z[rng.choice(no, PAIRS)]
        for _ in range(12):  # Newton steps on the pairs' logistic loss
            p = 1 / (1 + np.exp(np.clip(d @ self.weights, -30, 30)))
            gradient = PENALTY * self.weights - d.T @ p / PAIRS
            hessian = (d * (p * (1 - p))[:, None]).T @ d / PAIRS + PENALTY * np.eye(len(self.weights))
            step = np.linalg.solve(hessian, gradient)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break

    def _spread(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, *[np.maximum(0, x - k) for k in self.knots]])

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self._spread(x) - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.strength(x) - self.cut, -30, 30) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-z))


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels (doc_id, quality) and the documents they name. Labels without a
    quality of 0 or 1 are not used; of several for one document the least counts. All rows of
    one doc_id have its label; rows with a null doc_id have none. Ties of strengths don't
    matter. Without both classes every document scores alike."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = None
    for q in (0, 1):
        one = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        picked = one if picked is None else picked.unionByName(one)
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def seen(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "x": list(_matrix(pdf["text"]))})

    texts = src.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInPandas(seen, "doc_id long, quality int, x array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    good = rows["quality"].to_numpy() == 1
    if not len(rows):
        x, good = np.zeros((1, len(FEATURES))), np.array([True])
    model = Model(x, good)
    if good.any() and not good.all():
        strengths = src.select("doc_id", _strength(model)(F.col("text")).alias("s")).join(known, "doc_id")
        tails = {r.quality: r.tail for r in strengths.groupBy("quality").agg(F.percentile_approx("s", [TAIL, 1 - TAIL], 100_000).alias("tail")).collect()}
        model.cut = (tails[1][0] + tails[0][1]) / 2
    return model


def _strength(model: Model):
    @F.pandas_udf("double")
    def strength(text: pd.Series) -> pd.Series:
        memo("quality")
        return pd.Series(model.strength(_matrix(text)))

    return strength


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.7) to docs. Null texts score as
    empty ones, repeated rows alike. Columns of docs named like those added are replaced."""

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        memo("quality")
        return pd.Series(model.score(_matrix(text)))

    out = docs.withColumn("score", scored(F.coalesce("text", F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= CUT_SCORE).cast("int"))
