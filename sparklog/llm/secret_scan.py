"""Secret scans in DataFrame functions only.

Pattern spans (assignments, access keys, hex runs) and, beside them, candidate strings whose
Shannon entropy in some window is high for their character class. The entropy of a sliding
window comes from incremental counts: a step changes the counts of the character that leaves
and of the one that enters, and the sum of c*log2(c) by the same two terms. An allow-list
suppresses placeholders, identifiers and checksums among the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, and the length at least (of the group named).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = [("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16)]
#: A document without any of these can have no match of the kind.
NEEDLES = {"assign": ["password", "passwd", "secret", "token", "apikey", "api_key"], "access": ["akia"]}
#: Candidate strings of the entropy scan: this many characters at least.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Character classes in order: pattern of the whole candidate, window, bits at least.
CLASSES = [
    ("entropy_hex", r"^(?=.*[0-9])[0-9a-fA-F]+$", 20, 2.8), ("entropy_base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 24, 3.9),
    ("entropy_alnum", r"^(?=.*[0-9])[A-Za-z0-9+/_=-]+$", 24, 3.6), ("entropy_letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z+/_=-]+$", 24, 4.2),
]
#: Candidates that are never reported (case is ignored).
ALLOW = r"(?i)example|sample|dummy|placeholder|changeme|lorem|xxxx|0{8}|1234567|abcdef0|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9_/=+-]+$"
SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _located(text: Column, pattern: str, group: int, rank: int, kind: str) -> Column:
    """All leftmost non-overlapping matches as array of struct(start, rank, kind, end, size,
    match), size being the group's length. Segments that each end where a match ends give the
    places: \\G keeps a segment from beginning anywhere but at the last match's end."""
    upto = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    def rows(ends: Column) -> Column:
        zipped = F.arrays_zip(ends.alias("e"), whole.alias("m"), part.alias("g"))
        return F.transform(zipped, lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), z["e"].alias("end"), F.length(z["g"]).alias("size"), z["m"].alias("match")))

    return _let(_running_sums(F.transform(upto, lambda u: F.length(u).cast("long"))), rows)


def _let(value: Column, body) -> Column:
    """body(value), value being evaluated once however often body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running_sums(sizes: Column) -> Column:
    """Sums up to each element, by blocks of about the root of their number."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)

    def blocked(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        count = F.greatest(F.ceil(F.size(x) / width).cast("int"), F.lit(1))

        def summed(w: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(x, b * w + 1, w)))

            def each(s: Column) -> Column:
                return F.transform(x, lambda _, i: total(F.slice(s, F.lit(1), (i / w).cast("int"))) + total(F.slice(x, (i / w).cast("int") * w + 1, i % w + 1)))

            return _let(blocks, each)

        return _let(width, summed)

    return _let(sizes, blocked)


def _blocks(spans: Column) -> Column:
    """Spans, in order of their starts, in blocks of about the root of their number, each with
    its first start and its last end: what lies within a span is found in two short steps."""
    def cut(w: Column) -> Column:
        lists = F.transform(F.sequence(F.lit(0), F.ceil(F.size(spans) / w).cast("int") - 1), lambda b: F.slice(spans, b * w + 1, w))
        return F.transform(lists, lambda x: F.struct(F.get(x, F.lit(0))["start"].alias("start"), F.array_max(F.transform(x, lambda y: y["end"])).alias("end"), x.alias("spans")))

    return F.when(F.size(spans) > 0, _let(F.ceil(F.sqrt(F.size(spans))).cast("int"), cut)).otherwise(F.array().cast(f"array<struct<start:long,end:long,spans:{SPAN}>>"))


def _within(r: Column, b: Column) -> Column:
    return (b["start"] <= r["start"]) & (r["end"] <= b["end"])


def _longer(least: int):
    return lambda r: r["size"] >= least


def window_entropy(s: Column, width: int) -> Column:
    """The largest Shannon entropy, in bits, over windows of so many characters of an ASCII
    string; a shorter string is one window."""
    return _let(F.filter(F.split(s, ""), lambda x: x != ""), lambda c: _entropy_of(c, width))


def _entropy_of(c: Column, width: int) -> Column:
    n = F.size(c)
    term = lambda k: F.when(k > 0, k * F.log2(F.greatest(k, F.lit(1.0)))).otherwise(0.0)
    code = lambda i: F.ascii(F.get(c, i))

    def step(acc: Column, i: Column) -> Column:
        enter, leave = code(i), F.when(i >= width, code(i - width)).otherwise(-1)
        n_in, n_out = F.get(acc["count"], enter), F.get(acc["count"], F.greatest(leave, F.lit(0)))
        moved = leave != enter
        total = acc["total"] + F.when(moved, term(n_in + 1) - term(n_in) + F.when(leave >= 0, term(n_out - 1) - term(n_out)).otherwise(0.0)).otherwise(0.0)
        changed = lambda e, l: F.transform(acc["count"], lambda k, j: k + (j == e).cast("double") - (j == l).cast("double"))  # noqa: E731, E741
        count = F.when(moved, _let(F.struct(enter.alias("e"), leave.alias("l")), lambda m: changed(m["e"], m["l"]))).otherwise(acc["count"])
        size = F.least(i + 1, F.lit(width)).cast("double")
        full = (i + 1 >= width) | (i + 1 == n)
        best = F.when(full, F.greatest(acc["best"], F.log2(size) - total / size)).otherwise(acc["best"])
        return F.struct(count.alias("count"), total.alias("total"), best.alias("best"))

    zero = F.struct(F.array_repeat(F.lit(0.0), 128).alias("count"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda a: a["best"])).otherwise(0.0)


def scan(docs: DataFrame, text: str = "text", classes=CLASSES, allow: str = ALLOW) -> DataFrame:
    """Adds base_spans and spans to docs: arrays of struct(start, rank, kind, end), in code
    points, end exclusive, ordered by start, then kind. spans also has what the entropy scan
    finds outside the base spans. Null texts count as empty; repeated rows are scanned alike.
    Columns of docs named like those added are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    df = docs.withColumn("_sparklog_t", t).withColumn("_sparklog_low", F.lower("_sparklog_t"))
    gate = {kind: F.lit(False) for kind, *_ in KINDS}
    for kind, needles in NEEDLES.items():
        for x in needles:
            gate[kind] = gate[kind] | F.contains(F.col("_sparklog_low"), F.lit(x))
    gate["hex"] = F.col("_sparklog_t").rlike(r"[0-9a-f]{16}")
    gate["entropy"] = F.col("_sparklog_t").rlike(CANDIDATE)
    df = df.withColumns({f"_sparklog_g_{k}": g for k, g in gate.items()})
    cut = lambda rows: F.transform(rows, lambda r: F.struct(r["start"], r["rank"], r["kind"], r["end"]))
    got = {}
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        # Shorter hex runs only fail; the other kinds' failing matches also use up text.
        pattern = r"(?<![0-9a-f])[0-9a-f]{16,}+" if kind == "hex" else pattern
        found = F.filter(_located(F.col("_sparklog_t"), pattern, group, rank, kind), _longer(least))
        got[kind] = F.when(F.col(f"_sparklog_g_{kind}"), cut(found)).otherwise(none)
    df = df.withColumn("base_spans", F.array_sort(F.concat(*[got[k] for k, *_ in KINDS])))
    base = F.col("base_spans")
    some = _located(F.col("_sparklog_t"), CANDIDATE, 0, len(KINDS), "")
    loose = _let(_blocks(base), lambda bl: F.filter(some, lambda r: ~r["match"].rlike(allow) & ~F.exists(bl, lambda b: _within(r, b) & F.exists(b["spans"], lambda x: _within(r, x)))))
    df = df.withColumn("_sparklog_loose", F.when(F.col("_sparklog_g_entropy"), loose))

    def classed(r: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern, width, bits in reversed(classes):
            kind = F.when(r["match"].rlike(pattern), F.when(window_entropy(r["match"], width) >= bits, name)).otherwise(kind)
        return F.struct(r["start"].alias("start"), r["rank"].alias("rank"), kind.alias("kind"), r["end"].alias("end"))

    more = F.filter(F.transform(F.col("_sparklog_loose"), classed), lambda r: r["kind"].isNotNull())
    df = df.withColumn("spans", F.when(F.size("_sparklog_loose") > 0, F.array_sort(F.concat(base, more))).otherwise(base))
    return df.drop("_sparklog_t", "_sparklog_low", "_sparklog_loose", *[f"_sparklog_g_{k}" for k in gate])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of scan() by [kind]; overlapping spans become one. Texts without
    spans, null ones included, stay as they are. Needs the column spans and keeps it."""
    t = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(t, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.col("spans"), start, step, lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    return docs.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(t))
