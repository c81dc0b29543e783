"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 4 bits apart have a common variant at most 2 bits from each. Every
distinct fingerprint emits all its variants within 2 bits. The variants are dealt by their
leading bits: a fingerprint goes once to each prefix that one of its variants has, and the
variants of that prefix are made and compared there, so that what is shuffled is a small part
of all variants. All fingerprints with one variant are within 4 bits of each other; what the
variants of a prefix join is given as links to one of its members. Prefixes with many variants
are split by a hash of the variant.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import components, drop_staged, memo, staged, trim

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Variants that a task compares at a time, about, and that all come to one group of a prefix;
#: groups at least.
TASK_VARIANTS, GROUP_VARIANTS, LEAST_GROUPS = 1_000_000, 150_000_000, 32
MAX_PREFIX = 16
#: Rows that are dealt at a time for each fingerprint of a table, all tables together.
ROUND_COPIES = 40
#: Bits besides the fingerprint that screen a pair, as longs, and the most that may differ. Large
#: sets of similarity 0.8 differ in 38 of 256 on average, with a deviation of 6, and in 60 as good
#: as never. What is within SAME of another stands with it: it differs in 60 from nothing that
#: differs in more than APART from the other.
CHECKS = ("c0", "c1", "c2", "c3")
CHECK, APART, SAME = 64 * len(CHECKS), 80, 20


def fingerprint(text: str) -> int:
    """64 bits over XXH64 of 4-word shingles of a whole text; no words: zero."""
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), n)
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += part.sum(0, dtype=np.int32)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long. Null texts have no words. A column of that name
    is replaced."""

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, signed(F.coalesce(F.col(text), F.lit(""))))


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def ball(bits: int, radius: int) -> int:
    """How many variants of so many bits there are within a radius."""
    return len(_masks(bits, radius))


def _bucket_links(pdf: pd.DataFrame, low: int, radius: int) -> pd.DataFrame:
    """Links of the variants that begin with one prefix. low: bits after the prefix; left: how
    many of them may still be flipped; one of parts shares the variants by a hash."""
    fps, ids, left = pdf["fp"].to_numpy().view(np.uint64), pdf["id"].to_numpy(), pdf["left"].to_numpy()
    group, check = pdf["group"].to_numpy(), np.ascontiguousarray(pdf[list(CHECKS)].to_numpy()).view(np.uint64)
    parts, part = int(pdf["parts"].iloc[0]), int(pdf["part"].iloc[0])
    # Ids of one fingerprint are joined; the least of them stands for those as good as equal.
    order = np.lexsort((ids, fps))
    fps, ids, left, group, check = fps[order], ids[order], left[order], group[order], check[order]
    first = np.concatenate([[True], fps[1:] != fps[:-1]])
    least = np.flatnonzero(first)[np.cumsum(first) - 1]
    ends = np.append(np.flatnonzero(first), len(fps))
    out = [ids[_joined(check, group, np.arange(i, j))] for i, j in zip(ends, ends[1:]) if j - i > 1]
    first |= np.bitwise_count(check ^ check[least]).sum(1) > SAME
    out += _split_links(fps[first], ids[first], group[first], check[first], left[first], low, radius, parts, part)
    memo("simhash")
    links = _forest(np.concatenate(out))
    known = dict(zip(ids.tolist(), group.tolist()))
    far = np.array([known[a] != known[b] for a, b in links.tolist()], bool)
    trim()
    return pd.DataFrame({"a": links[far, 0], "b": links[far, 1]})


def _forest(pairs: np.ndarray) -> np.ndarray:
    """For each set of ids that pairs join, pairs of each id with the one that is in the most
    pairs: as many rows as ids, whatever the pairs."""
    ids, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    n = np.bincount(ends.ravel(), minlength=len(ids))
    order = np.lexsort((ids, -n, root))
    first = np.concatenate([[True], root[order][1:] != root[order][:-1]])[: len(order)]
    center = np.zeros(len(ids), np.int64)
    center[order] = ids[order][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(ids) else 0
    out = np.stack([np.maximum(ids, center), np.minimum(ids, center)], 1)[ids != center]
    return np.unique(out, axis=0)


def _close(check: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(check[a] ^ check[b]).sum(-1) <= APART


def _joined(check: np.ndarray, group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pairs of rows that are close, fewer than two a row, by which all that a chain of close
    pairs (or a group) joins stays joined: the first row's, then those of the rows that are not
    close to it, and so on; each of these with one of the former, if any is close."""
    out = [np.zeros((0, 2), np.int64)]
    while len(rows) > 1:
        near = _close(check, rows, rows[0]) | (group[rows] == group[rows[0]])
        near[0] = True
        with_it, rest = rows[near], rows[~near]
        own = with_it[group[with_it] != group[rows[0]]]
        out.append(np.stack([own, np.full(len(own), rows[0])], 1))
        step = max(1, 1_000_000 // len(with_it))
        for i in range(0, len(rest) if len(with_it) > 1 else 0, step):
            hit = _close(check, rest[i : i + step, None], with_it[None, :])
            some = np.flatnonzero(hit.any(1))
            out.append(np.stack([rest[i + some], with_it[hit[some].argmax(1)]], 1))
        rows = rest
    return np.concatenate(out)


def _split_links(fps, ids, group, check, left, low: int, radius: int, parts: int, part: int) -> list[np.ndarray]:
    """Links of distinct fingerprints; many variants are split by more leading bits."""
    load = sum(int((left == k).sum()) * ball(low, k) for k in range(radius + 1))
    bits = int(np.ceil(np.log2(max(1, load / parts / TASK_VARIANTS))))
    if not bits or low <= 16:
        return [_compare(fps, ids, group, check, left, low, radius, parts, part)]
    bits = min(bits, 8, low - 8)
    low -= bits
    own = ((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    rows, to, rest = [], [], []
    for m in _masks(bits, radius):
        at = np.flatnonzero(left >= m.bit_count())
        rows.append(at)
        to.append(own[at] ^ m)
        rest.append(left[at] - m.bit_count())
    rows, to, rest = np.concatenate(rows), np.concatenate(to), np.concatenate(rest)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange((1 << bits) + 1))
    out = []
    for a, b in zip(ends, ends[1:]):
        if b - a > 1:
            at = order[a:b]
            out += _split_links(fps[rows[at]], ids[rows[at]], group[rows[at]], check[rows[at]], rest[at], low, radius, parts, part)
    return out


def _compare(fps, ids, group, check, left, low: int, radius: int, parts: int, part: int) -> np.ndarray:
    keep = np.uint64((1 << low) - 1)
    made, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for k in range(radius + 1):
        at = np.flatnonzero(left == k)
        mask = np.array(_masks(low, k), np.uint64)
        step = max(1, 500_000 // len(mask))
        for i in range(0, len(at), step):
            v = ((fps[at[i : i + step]] & keep)[:, None] ^ mask[None, :]).ravel()
            own = np.repeat(at[i : i + step].astype(np.int32), len(mask))
            if parts > 1:
                mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts) == part
                v, own = v[mine], own[mine]
            made.append(v)
            owners.append(own)
    v, own = np.concatenate(made), np.concatenate(owners)
    ordered = np.sort(v)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return np.zeros((0, 2), np.int64)
    at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == v)
    bucket, row = at[hit], own[hit]
    # A bucket's hub is its member that is in most buckets: the middle of a group of copies is
    # the hub of many, so that a member has few hubs.
    seen = -np.bincount(row)
    order = np.lexsort((ids[row], seen[row], bucket))
    bucket, row = bucket[order], row[order]
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    hub = row[np.flatnonzero(first)[np.cumsum(first) - 1]]
    near = (group[row] != group[hub]) & _close(check, row, hub)
    pairs = [np.stack([row[near], hub[near]], 1)]
    # Where a member is not close to the hub, it may be to other members.
    begins = np.append(np.flatnonzero(first), len(row))
    far = np.add.reduceat((group[row] != group[hub]) & ~near, begins[:-1])
    done = set()
    for k in np.flatnonzero((far > 0) & (np.diff(begins) > 2)).tolist():
        members = row[begins[k] : begins[k + 1]]
        if (key := members.tobytes()) not in done:
            done.add(key)
            pairs.append(_joined(check, group, members))
    pair = np.sort(ids[np.concatenate(pairs)], axis=1)
    return np.unique(pair[:, ::-1], axis=0)


def _rounds(tables: list[int], copies: int) -> list[tuple[list[int], int, int]]:
    """(tables, slice, slices): tables, or slices of one's prefixes, that are dealt at a time,
    where each fingerprint of a table goes to so many prefixes."""
    some, slices = max(1, ROUND_COPIES // copies), -(-copies // ROUND_COPIES)
    return [(tables[i : i + some], s, slices) for i in range(0, len(tables), some) for s in range(slices)]


def ball_links(rows: DataFrame, width: int = 64, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between ids of (table, fp, id, group, *CHECKS), all longs, within each table: of any
    two fingerprints of `width` bits at most radius bits apart, both are joined by links of each
    variant that they share. What is of one group is known to be linked: no link within
    it is given. CHECKS are further bits: links join what chains of pairs that differ in 60 of
    them at most join, and nothing that chains of pairs that differ in APART don't."""
    half = radius // 2
    tables, n = rows.groupBy("table").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    groups = max(LEAST_GROUPS / max(1, tables), (n or 0) * ball(width, half) / GROUP_VARIANTS)
    bits = min(MAX_PREFIX, max(1, int(np.ceil(np.log2(groups)))))
    low = width - bits
    own = F.shiftrightunsigned(F.col("fp"), low)
    # Variants of each prefix, from the histograms of the fingerprints' own prefixes.
    seen: dict[int, np.ndarray] = {}
    for r in rows.groupBy("table", own.alias("p")).agg(F.count("*").alias("n")).collect():
        seen.setdefault(r.table, np.zeros(1 << bits, np.int64))[r.p] = r.n
    masks = [(m, m.bit_count()) for m in _masks(bits, half)]
    many: dict[int, int] = {}
    for table, hist in seen.items():
        load = sum(hist[np.arange(1 << bits) ^ m] * ball(low, half - k) for m, k in masks)
        many |= {(table << bits) + int(p): int(-(-load[p] // GROUP_VARIANTS)) for p in np.flatnonzero(load > 2 * GROUP_VARIANTS)}
    parts = F.lit(1)
    if many:
        place = F.shiftleft(F.col("table"), bits) + F.col("prefix")
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in many.items() for x in (k, v)]), place), parts)
    to = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(half - k).alias("left")) for m, k in masks]))

    def found(tables: list[int], one: int, slices: int) -> DataFrame:
        dealt = rows.where(F.col("table").isin(tables)).select("table", "fp", "id", "group", *CHECKS, own.alias("own"), to.alias("to"))
        dealt = dealt.select("table", "fp", "id", "group", *CHECKS, F.col("own").bitwiseXOR(F.col("to.m")).alias("prefix"), "to.left")
        if slices > 1:
            dealt = dealt.where(F.pmod("prefix", F.lit(slices)) == one)
        dealt = dealt.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return dealt.groupBy("table", "prefix", "part").applyInPandas(lambda pdf: _bucket_links(pdf, low, half), "a long, b long").distinct()

    # More prefixes mean more rows for a fingerprint: these are shuffled round by round, and
    # a round's shuffle files go when it is staged.
    rounds = _rounds(sorted(seen) or [0], len(masks))
    if len(rounds) == 1:
        return found(*rounds[0])
    each = [staged(found(*r), "simhash") for r in rounds]
    out = staged(reduce(DataFrame.unionByName, each).distinct(), "simhash")
    for old in each:
        drop_staged(old)
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (one long column), enough of them that any
    two at most radius bits apart are in one component; never a link farther apart."""
    fp = F.col(fps.columns[0])
    return ball_links(fps.select(F.lit(0).cast("long").alias("table"), fp.alias("fp"), fp.alias("id"), fp.alias("group"), *[F.lit(0).cast("long").alias(k) for k in CHECKS]), 64, radius)


def near_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of every row.

    Equal fingerprints are linked; so are those of texts without words. A null doc_id is never
    a component's id while another is there. Repeated rows are members like any other."""
    own = staged(with_fingerprint(docs.select("doc_id", text), text).select("doc_id", "fp"), "simhash")
    firsts = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash")
    roots = components(staged(links(firsts.select("fp"), radius), "simhash"))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = staged(rooted.join(ids, "root").select("fp", "component_id"), "simhash")
    return own.join(table, "fp").select("doc_id", "fp", "component_id")


#: For similarity of shingle sets: words of a shingle, least Jaccard similarity, fingerprints of
#: a set and their bits.
SET_SHINGLE, SIMILARITY, TABLES, WIDTH = 5, 0.8, 16, 40
#: Shingles of a set that is short, and members of a block that a task compares with another.
SHORT, BLOCK = 64, 256


def _shingle_set(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    n = max(1, len(words) - SET_SHINGLE + 1) if words else 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(SET_SHINGLE)))) if len(words) >= SET_SHINGLE else [b" ".join(words)] * n
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.dtype("<u8"), n))


def _packed(h: np.ndarray) -> bytes:
    """32 bits of each hash of a set: differences in order, byte by byte, which compress."""
    low = np.unique((h & np.uint64(0xFFFFFFFF)).astype("<u4"))
    return np.diff(low, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _set_prints(h: np.ndarray) -> list[int]:
    """TABLES fingerprints of WIDTH bits of a set of hashes, then CHECK bits as longs."""
    size = TABLES * WIDTH + CHECK
    total = np.zeros(size, np.int64)
    more = (np.arange(-(-size // 64), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for i in range(0, len(h), 16384):
        x = h[i : i + 16384, None] + more
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(x.view(np.uint8), axis=1)[:, :size].sum(0, dtype=np.int32)
    bits = 2 * total > len(h)
    tables = bits[: TABLES * WIDTH].reshape(TABLES, WIDTH) @ (1 << np.arange(WIDTH, dtype=np.int64))
    return tables.tolist() + np.packbits(bits[TABLES * WIDTH :]).view("<i8").tolist()


def _rows_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [_unpacked(x) for x in pdf["grams"]]


def _compare_sets(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between similar sets of two blocks (or of one, where side is the same), but none
    within a class; of each set only to the least key that it is linked to."""
    key, known, side = pdf["key"].to_numpy(), pdf["e"].to_numpy(), pdf["side"].to_numpy()
    sets = _rows_of(pdf)
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    owner, at = owner[n[at] > 1], at[n[at] > 1]
    at = np.unique(at, return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at.max(initial=-1)) + 1, 8192):
        i, j = np.searchsorted(at, (low, low + 8192))
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[i:j], at[i:j] - low] = 1
        both += m @ m.T
    near = (both > 0) & (both >= similarity * (size[:, None] + size[None, :] - both)) & (known[:, None] != known[None, :])
    if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
        near &= side[:, None] != side[None, :]
    least = np.where(near, key[None, :], np.iinfo(np.int64).max).min(1)
    root = np.minimum(key, least)
    while not ((low := np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))) == root).all():
        root = low
    return pd.DataFrame({"a": key, "b": root})[root != key]


def _similar_within(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) by similarity of sets, for (place, e, key, grams): enough to join any two
    similar sets that have a place in common. What has one e is joined already.

    The largest class of a place is compared with the others only; blocks of members are
    compared by tasks of their own."""
    class_size = rows.groupBy("place", "e").agg(F.count("*").alias("n"))
    places = class_size.groupBy("place").agg(F.max(F.struct("n", "e")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("classes"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    places = staged(places.where("classes > 1").select("place", F.col("main.e").alias("main"), blocks(F.col("main.n")).alias("own"), blocks(F.col("all") - F.col("main.n")).alias("others")), "simhash")
    dealt = rows.join(places, "place")
    hashed = F.xxhash64("key")
    mine = F.col("e") == F.col("main")  # the main class has sides below zero
    dealt = dealt.withColumn("side", F.when(mine, -1 - F.pmod(hashed, F.col("own"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(mine, F.lit(0)).otherwise(-F.col("own")), F.col("others") - 1)))
    dealt = dealt.select("place", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "e", "key", "grams")
    return dealt.groupBy("place", "lo", "hi").applyInPandas(lambda pdf: _compare_sets(pdf, similarity), "a long, b long")


def similar_groups(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable) of every row, linking what
    near_groups() links and also texts whose sets of 5-word shingles are similar.

    Candidates are joined by pairs that agree in a ball of any of TABLES short fingerprints of the
    sets and in enough of CHECK further bits. These pairs are compared first, then any two that
    such pairs join and that are not linked yet; short sets, also all that have one of their
    rarest shingles in common. The exact Jaccard similarity decides.
    Texts of one shingle set are one class. Texts without words are one class."""

    def described(batches):
        memo("simhash")
        for pdf in batches:
            rows = []
            for known, doc, t in zip(pdf["known"].tolist(), pdf["doc_id"].tolist(), pdf["text"].tolist()):
                h = _shingle_set(t)
                key = xxh64_intdigest(h.tobytes(), SEED)
                rows.append((doc if known else None, np.uint64(fingerprint(t)).astype(np.int64), np.uint64(key).astype(np.int64), _set_prints(h), _packed(h)))
            out = pd.DataFrame(rows, columns=["doc_id", "fp", "key", "prints", "grams"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        trim()

    src = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = staged(src.mapInPandas(described, "doc_id long, fp long, key long, prints array<long>, grams binary"), "simhash")
    # Links by fingerprints of whole texts come first: their components are groups of keys.
    roots = components(staged(links(own.select("fp").distinct()), "simhash"))
    pairs = own.select("key", "fp").distinct().join(roots, F.col("fp") == F.col("node"), "left")
    kept = staged(pairs.select("key", F.coalesce("root", "fp").alias("root")).distinct(), "simhash")
    least = kept.groupBy("root").agg(F.min("key").alias("least"))
    same = kept.join(least, "root").select(F.col("key").alias("a"), F.col("least").alias("b")).where("a <> b")
    reps = own.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("prints").alias("prints"))
    reps = staged(reps.join(kept.groupBy("key").agg(F.min("root").alias("group")), "key"), "simhash")
    more = [F.get("prints", F.lit(TABLES + i)).alias(k) for i, k in enumerate(CHECKS)]
    rows = reps.select("key", "group", *more, F.posexplode(F.slice("prints", 1, TABLES)).alias("table", "fp")).select(F.col("table").cast("long").alias("table"), "fp", F.col("key").alias("id"), "group", *CHECKS)
    pairs = staged(ball_links(rows, WIDTH, RADIUS), "simhash")
    brief = F.length("grams") <= 4 * SHORT
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(same.select("a")).union(same.select("b")).union(own.where(brief).select("key")).distinct()
    sets = staged(own.select("key", "grams").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "simhash")
    slim = staged(own.select("doc_id", "key"), "simhash")
    drop_staged(own)

    def verified(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["ga"], pdf["gb"]):
                x, y = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    of = lambda k: sets.select(F.col("key").alias(k), F.col("grams").alias(f"g{k}"))
    similar = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ga", "gb").mapInPandas(verified, "a long, b long")
    similar = staged(similar.unionByName(same).distinct(), "simhash")
    linked = components(similar)
    known = staged(sets.join(linked, sets.key == linked.node, "left").select("key", F.coalesce("root", "key").alias("e"), "grams"), "simhash")
    # Any two that candidates join.
    joined = components(staged(pairs.select("a", "b").unionByName(same).distinct(), "simhash"))
    found = _similar_within(known.join(joined, F.col("key") == F.col("node")).select(F.col("root").alias("place"), "e", "key", "grams"), similarity)

    # Short sets: of two similar ones, the first shingles in any one order have one in common.
    def shingles(batches):
        for pdf in batches:
            lists = _rows_of(pdf)
            yield pd.DataFrame({"key": np.repeat(pdf["key"].to_numpy(), [len(x) for x in lists]), "place": np.concatenate([*lists, np.zeros(0, np.uint32)]).astype(np.int64)})

    each = staged(known.where(brief & (F.length("grams") > 0)).select("key", "grams").mapInPandas(shingles, "key long, place long"), "simhash")
    common = each.groupBy("place").agg(F.count("*").alias("n"))
    ordered = each.join(common, "place").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("l"))
    n = F.size("l")
    firsts = ordered.select("key", F.explode(F.slice("l", 1, n - F.ceil(F.lit(similarity) * n - 1e-9).cast("int") + 1)).alias("x")).where("x.n > 1").select("key", F.col("x.place").alias("place"))
    found = found.unionByName(_similar_within(staged(firsts.join(known, "key").select("place", "e", "key", "grams"), "simhash"), similarity))
    roots = components(staged(similar.unionByName(found).distinct(), "simhash"))
    rooted = reps.join(roots, reps.key == roots.node, "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = staged(rooted.join(ids, "root").select("key", "component_id"), "simhash")
    return slim.select("doc_id", "key").join(table, "key").select("doc_id", "component_id")
