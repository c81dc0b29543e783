"""Embedding near-dedup by spherical-cap filters.

Filter directions are a random product code: the dimensions are dealt to blocks by a fixed
permutation, each block has a random code of unit vectors, and a direction is one code word of
each block. A vector is list-decoded to the FILTERS directions of greatest inner product with
it, so that every vector has as many: of the sums of one product a block, those can be among
the greatest whose ranks in the blocks have a product of FILTERS at most. Vectors are joined on (label, filter); each pair is verified in double precision and
counted in the first filter it shares. Equal vectors are one representative with a count. A
bucket gives rows in proportion to its members, never its pairs; large buckets are split into
chunks whose pairs are tasks of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, staged

#: Filters of every vector, vectors of a label in a filter on average, members of a chunk of a
#: large bucket, and the least dimensions and most code words of a block.
FILTERS, BUCKET, CHUNK, LEAST_DIM, MOST_WORDS = 36, 6, 1500, 8, 512
#: Members of a bucket whose pairs are listed, and pairs that are compared at a time.
FEW, PAIRS = 64, 200_000


class CapFilters:
    """Directions for vectors of one dimension, about count of them, and at least FILTERS."""

    def __init__(self, dim: int, count: int, seed: int = 11):
        count = max(2, FILTERS, count)
        self.blocks = max(1, min(dim // LEAST_DIM, math.ceil(math.log(count) / math.log(160))))
        self.size = min(MOST_WORDS, math.ceil(count ** (1 / self.blocks)))
        rng = np.random.default_rng([seed, dim, self.blocks, self.size])
        self.order = rng.permutation(dim)
        self.codes = []
        for part in np.array_split(np.arange(dim), self.blocks):
            c = rng.standard_normal((self.size, len(part)))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.blocks))
        # Ranks, one a block, of the sums that can be among the FILTERS greatest.
        ranks: list[tuple] = [()]
        for _ in range(self.blocks):
            ranks = [(*r, k) for r in ranks for k in range(1, min(self.size, FILTERS // math.prod(r)) + 1)]
        self.ranks = np.array(ranks) - 1

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        x, at, out = unit[:, self.order], 0, []
        for c in self.codes:
            out.append(x[:, at : at + c.shape[1]] @ c.T)
            at += c.shape[1]
        return out

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of each row's FILTERS directions of greatest inner product."""
        total, code = np.zeros((len(unit), len(self.ranks))), np.zeros((len(unit), len(self.ranks)), np.int64)
        for p, rank in zip(self.products(unit), self.ranks.T):
            best = np.argsort(-p, axis=1, kind="stable")[:, :FILTERS]
            total += np.take_along_axis(p, best, 1)[:, rank]
            code = code * self.size + best[:, rank]
        best = np.argsort(-total, axis=1, kind="stable")[:, :FILTERS]
        return np.repeat(np.arange(len(unit)), best.shape[1]), np.take_along_axis(code, best, 1).ravel()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _numbers(parts, kind: str, each: int) -> np.ndarray:
    """The rows of numbers, `each` in a row, that were packed in four or eight bytes a number."""
    raw = b"".join(parts)
    size = len(parts.iloc[0]) // each
    return np.frombuffer(raw, f"<{kind}{size}").reshape(-1, each).astype(f"<{kind}8")


def _emit(batches, single: bool):
    """A row for each filter of each vector. n: vectors of its label and length; labels of about
    as many share their filters. single: four bytes hold each component."""
    made: dict[tuple[int, int], CapFilters] = {}
    for pdf in batches:
        pdf = pdf.assign(power=np.ceil(np.log2(pdf["n"])).astype(int))
        for (label, dim, power), part in pdf.groupby(["label", "dim", "power"]):
            caps = made.setdefault((dim, power), None) or CapFilters(dim, (1 << power) * FILTERS // BUCKET)
            made[dim, power] = caps
            x = np.frombuffer(b"".join(np.asarray(e, "<f8").tobytes() for e in part["embedding"]), "<f8").reshape(-1, dim)
            for i in range(0, len(x), 1000):
                row, code = caps.decode(_unit(x[i : i + 1000]))
                ends = np.searchsorted(row, np.arange(len(x[i : i + 1000]) + 1))
                some = part.iloc[i + row]
                packed = [v.tobytes() for v in x[i : i + 1000].astype("<f4" if single else "<f8")]
                width = "<i4" if caps.size**caps.blocks < 1 << 31 else "<i8"
                lists = [np.sort(code[a:b]).astype(width).tobytes() for a, b in zip(ends, ends[1:])]
                yield pd.DataFrame({"label": label, "dim": dim, "filter": code, "rep": some["rep"].to_numpy(), "mult": some["mult"].to_numpy(), "x": [packed[r] for r in row.tolist()], "all": [lists[r] for r in row.tolist()]})


def _shared_before(own: list[np.ndarray], other: list[np.ndarray], code: int) -> np.ndarray:
    """Whether members (rows) and others (columns) share a filter before this one."""
    a, b = [f[f < code] for f in own], [f[f < code] for f in other]
    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa, fb)
    if not len(both):
        return np.zeros((len(own), len(other)), bool)

    def incidence(lists, flat):
        m = np.zeros((len(lists), len(both)), np.float32)
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        m[np.repeat(np.arange(len(lists)), [len(f) for f in lists])[hit], at[hit]] = 1
        return m

    return incidence(a, fa) @ incidence(b, fb).T > 0


def _verify(group: pd.DataFrame, least: float) -> list[tuple[int, int, int]]:
    """Rows (rep, links counted here, smallest rep of its part of the bucket)."""
    code, dim = int(group["filter"].iloc[0]), int(group["dim"].iloc[0])
    x = _numbers(group["x"], "f", dim)
    norm = np.linalg.norm(x, axis=1)
    rep, mult = group["rep"].to_numpy(), group["mult"].to_numpy()
    near = (x @ x.T) / np.outer(norm, norm) >= least
    side = group["side"].to_numpy()
    if group["two"].iloc[0]:  # two chunks: only pairs across them
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    linked = np.flatnonzero(near.any(1))
    if not len(linked):
        return []
    near, rep, mult = near[np.ix_(linked, linked)], rep[linked], mult[linked]
    lists = list(_numbers(group["all"].iloc[linked], "i", FILTERS))
    counted = (near & ~_shared_before(lists, lists, code)) @ mult
    root = rep.copy()
    while True:
        low = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            break
        root = low
    return list(zip(rep.tolist(), counted.astype(np.int64).tolist(), root.tolist()))


def _small(rows: pd.DataFrame, begin: np.ndarray, size: np.ndarray, least: float) -> list[np.ndarray]:
    """The same for many buckets of a few members at once, given where each begins: their pairs
    side by side. Rows (rep, links counted, smallest rep linked)."""
    out, done = [], 0
    load = np.cumsum(size * (size - 1) // 2)
    while done < len(begin):
        upto = max(done + 1, int(np.searchsorted(load, (load[done - 1] if done else 0) + PAIRS, "right")))
        first, n = begin[done:upto], size[done:upto]
        done = upto
        i, member = _ranges(n)  # each member, then those after it in its bucket
        k, step = _ranges(n[i] - 1 - member)
        a = first[i[k]] + member[k]
        b = a + 1 + step
        dim = rows["dim"].to_numpy()[a]
        for length in np.unique(dim).tolist():
            x, y = a[dim == length], b[dim == length]
            used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            v = _numbers(rows["x"].iloc[used], "f", length)
            at = at.reshape(2, -1)
            norm = np.linalg.norm(v, axis=1)
            near = np.einsum("ij,ij->i", v[at[0]], v[at[1]]) / (norm[at[0]] * norm[at[1]]) >= least
            x, y = x[near], y[near]
            rep, mult, code = rows["rep"].to_numpy(), rows["mult"].to_numpy(), rows["filter"].to_numpy()
            own, some = {}, np.unique(np.concatenate([x, y]))
            width = rows["all"].iloc[some].str.len().to_numpy()
            for size in np.unique(width).tolist():
                mine = some[width == size]
                own |= dict(zip(mine.tolist(), _numbers(rows["all"].iloc[mine], "i", FILTERS)))
            new = np.array([not len(np.intersect1d(own[p][own[p] < code[p]], own[q], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist())], bool)
            low = np.minimum(rep[x], rep[y])
            out += [np.stack([rep[x], mult[y] * new, low], 1), np.stack([rep[y], mult[x] * new, low], 1)]
    return out


def _ranges(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number, so many rows: its index, and 0, 1, ..."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _buckets(batches, least: float):
    """Runs of rows with one key, across batches; the rows come sorted by key."""
    keys, held = ["label", "dim", "filter", "lo", "hi"], None

    def verified(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        begin, size = edges[:-1], np.diff(edges)
        few = (size > 1) & (size <= FEW) & ~pdf["two"].to_numpy()[begin]
        out = _small(pdf, begin[few], size[few], least)
        for a, n in zip(begin[~few & (size > 1)].tolist(), size[~few & (size > 1)].tolist()):
            out.append(np.array(_verify(pdf.iloc[a : a + n], least), np.int64).reshape(-1, 3))
        return pd.DataFrame(np.concatenate([np.zeros((0, 3), np.int64), *out]), columns=["rep", "n", "root"])

    for pdf in batches:
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        k = pdf[keys].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1])
        yield verified(pdf, edges)
        held = pdf.iloc[edges[-1] :]
    if held is not None and len(held) > 1:
        yield verified(held.reset_index(drop=True), np.array([0, len(held)]))


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine is at least `least`. Null, zero
    and empty vectors, those with a null or non-finite component, and rows with a null label or
    vec_id link with nothing. Only vectors of one length are compared. Repeated rows are
    vectors like any other and count as links. Columns besides the three are not read."""
    spark = vectors.sparkSession
    src = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    src = src.withColumn("ok", ok).withColumn("h", F.xxhash64("embedding"))
    reps = staged(src.where("ok").groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("dim", F.size("embedding")), "caps")

    sized = reps.join(reps.groupBy("label", "dim").agg(F.count("*").alias("n")), ["label", "dim"])
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = staged(sized.mapInPandas(lambda it: _emit(it, single), "label long, dim int, filter long, rep long, mult long, x binary, all binary"), "caps")
    key = ["label", "dim", "filter"]
    big = rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > 2 * CHUNK)
    big = staged(big.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).drop("size"), "caps")
    dealt = rows.join(big, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(*key, F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), (F.col("side") != F.col("other")).alias("two"), "side", "rep", "mult", "x", "all")
    by = [*key, "lo", "hi"]
    found = staged(dealt.repartition(*by).sortWithinPartitions(*by).mapInPandas(lambda it: _buckets(it, least), "rep long, n long, root long"), "caps")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    table = reps.select("label", "h", "embedding", "rep", "mult").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    table = staged(table.select("label", "h", "embedding", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "caps")
    done = src.where("ok").join(table, ["label", "h", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = src.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
