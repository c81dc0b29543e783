"""Text functions on columns; only ASCII letters fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The first entry with a word in the text gives its class.
SEVERITY_WORDS = [
    (2, ["default"]), (5, ["ftl", "fatal", "fault", "crit", "emerg", "alert", "panic"]), (4, ["err"]), (3, ["wrn", "warn"]),
    (2, ["inf", "notice"]), (1, ["dbg", "debug"]), (0, ["trc", "trace", "vrb", "verbose"]),
]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z. lower() is right for texts of ASCII only and much faster than translate();
    the others are few."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def lower_literal(s: str) -> str:
    return "".join(c.lower() if c in UPPER else c for c in s)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def find(text: Column, needle: str, fold: bool = False) -> Column:
    """Characters before the first occurrence, -1 without one; an empty needle is at 0."""
    if not needle:
        return F.lit(0)
    return (F.instr(ascii_lower(text), lower_literal(needle)) if fold else F.instr(text, needle)) - 1


def trim(c: Column) -> Column:
    """Without leading blanks and tabs, and trailing ones, carriage returns and newlines."""
    return F.regexp_replace(c, r"\A[ \t]++|[ \t\r\n]++\z", "")


def truncate(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def severity_class(c: Column) -> Column:
    """0 trace, 1 debug, 2 info, 3 warning, 4 error, 5 fatal, -1 none."""
    low = ascii_lower(c)
    out = None
    for k, words in SEVERITY_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(-1)


def hit_positions(text: Column, needle: str) -> Column:
    """Positions (from 0) of all occurrences, overlapping ones too, ignoring ASCII case."""
    if not needle:
        return F.array().cast("array<int>")
    low, n = ascii_lower(text), len(needle)
    last = F.length(text) - n
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(low, i + 1, F.lit(n)) == lower_literal(needle))
    return F.when(F.contains(low, F.lit(lower_literal(needle))), at).otherwise(F.array().cast("array<int>"))


def mask_control(c: Column) -> Column:
    """Characters below blank as blanks."""
    return F.regexp_replace(c, r"[\x00-\x1F]", " ")


def wrap(c: Column, width: int) -> Column:
    """Pieces of so many characters, the last one shorter; an empty text has none."""
    n = F.ceil(F.length(c) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(c, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def expand_tabs(c: Column) -> Column:
    """Tabs to the next multiple of eight, other characters below blank as question marks."""
    parts = F.split(F.regexp_replace(c, r"[\x00-\x08\x0A-\x1F]", "?"), "\t")
    joined = F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), lambda acc, p: F.concat(acc, F.repeat(F.lit(" "), 8 - F.length(acc) % 8), p))
    return joined
