"""Timestamp layouts: one table of directives for matching, literals and epoch columns.

A layout becomes a regex without backtracking (the same in Java and Python) whose groups are
the parts of a wall clock. Offsets and zones are matched and discarded; parts that a layout
lacks are those of 1970-01-01 00:00:00. Days roll over (31 February is 3 March).
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = [m.lower() for m in calendar.month_name[1:]]
_MONTH = "(?>(?i:" + "|".join(MONTHS + [m[:3] for m in MONTHS]) + "))"
_DAY = "0[1-9]|[12][0-9]|3[01]|[1-9](?![0-9])"
_MON = "0[1-9]|1[0-2]|[1-9](?![0-9])"
_SIXTY = "[0-5][0-9]|[0-9](?![0-9])"
_YEARDAY = (
    "(?=(?:0{0,2}[1-9]|0?[1-9][0-9]|[12][0-9]{2}|3[0-5][0-9]|36[0-6])(?![0-9])"
    "|(?:[12][0-9]{2}|3[0-5][0-9]|36[0-6]|0[1-9][0-9]|00[1-9]))"
)
#: Directive: (part, before the group, the group, what it says of a literal).
PARTS = {
    "Y": ("Y", "", "[0-9]{4}", "date"), "y": ("y", "", "[0-9]{2}", "date"), "m": ("m", "", _MON, "date"),
    "b": ("b", "", _MONTH, "date"), "B": ("b", "", _MONTH, "date"), "h": ("b", "", _MONTH, "date"),
    "d": ("d", "", _DAY, "date"), "e": ("d", "[ ]*+", _DAY, "date"), "j": ("j", _YEARDAY, "[0-9]{1,3}+", "date"),
    "H": ("H", "", "[01][0-9]|2[0-3]|[0-9](?![0-9])", "hour"), "I": ("H", "", _MON, "hour"),
    "M": ("M", "", _SIXTY, "minute"), "S": ("S", "", "[0-5][0-9]|60|[0-9](?![0-9])", "second"),
    "f": ("f", "", "[0-9]{1,9}+", "fraction"), "p": ("p", "", "[AaPp][Mm]", ""),
}
#: Directives that are skipped.
SKIPPED = {
    "a": "[A-Za-z]++", "A": "[A-Za-z]++", "Z": "(?:[ ]*+[A-Za-z]++)?+", "%": "%",
    "z": r"[ ]*+(?:[Zz]|[+-][0-9]{1,2}+(?:[:.][0-9]{2}|(?![:.])(?:[0-9]{2})?+))",
}
#: Layouts that a filter's literal may have besides its field's own, in order.
FALLBACKS = [
    "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M",
    "%Y-%m-%d", "%b %e %H:%M:%S", "%b %e %H:%M", "%H:%M:%S.%f", "%H:%M:%S", "%H:%M",
]


@dataclass(frozen=True)
class Layout:
    """pieces: (part or None, before, regex) in order; says: what kinds of parts it has."""

    pieces: tuple[tuple[str | None, str, str], ...]
    says: frozenset[str]

    def last(self) -> dict[str, int]:
        """Of each part, the piece that counts: the last one."""
        return {part: i for i, (part, _, _) in enumerate(self.pieces) if part}

    def regex(self, capture: bool = True) -> tuple[str, list[str]]:
        """The regex and the parts of its groups in order."""
        out, groups, last = "", [], self.last()
        for i, (part, before, body) in enumerate(self.pieces):
            if part is None:
                out += body
            elif capture and last[part] == i:
                out += f"{before}({body})"
                groups.append(part)
            else:
                out += f"{before}(?:{body})"
        return out, groups


@cache
def layout(fmt: str) -> Layout:
    pieces: list[tuple[str | None, str, str]] = []
    says = set()
    for m in re.finditer(r"%(.?)|([ \t]+)|(.)", fmt, re.S):
        if m[2]:
            pieces.append((None, "", r"[ \t]++"))
        elif m[3]:
            pieces.append((None, "", quote(m[3])))
        elif m[1] in PARTS:
            part, before, body, kind = PARTS[m[1]]
            pieces.append((part, before, body))
            says.add(kind)
        else:
            pieces.append((None, "", SKIPPED.get(m[1], "(?!)")))  # an unknown one never matches
    return Layout(tuple(pieces), frozenset(says - {""}))


def quote(text: str) -> str:
    """A literal in a regex, for Java and Python alike."""
    return re.sub(r"([^0-9A-Za-z_\x80-\U0010FFFF \n\t])", r"\\\1", text).replace("\n", r"\n").replace("\t", r"\t")


def month_number(name: str) -> int:
    return [m[:3] for m in MONTHS].index(name[:3].lower()) + 1


def _epoch(parts: dict[str, str]) -> float:
    year = int(parts["Y"]) if "Y" in parts else 1970
    if "y" in parts:
        year = int(parts["y"]) + (2000 if int(parts["y"]) < 70 else 1900)
    month = month_number(parts["b"]) if "b" in parts else int(parts.get("m", 1))
    days = _days(year, 1) + int(parts["j"]) - 1 if "j" in parts else _days(year, month) + int(parts.get("d", 1)) - 1
    hour = int(parts.get("H", 0))
    if "p" in parts:
        pm = parts["p"][0] in "pP"
        hour = hour + 12 if pm and hour < 12 else 0 if not pm and hour == 12 else hour
    seconds = days * 86400 + hour * 3600 + int(parts.get("M", 0)) * 60 + int(parts.get("S", 0))
    return seconds + (int(parts["f"]) / 10 ** len(parts["f"]) if "f" in parts else 0.0)


def _days(year: int, month: int) -> int:
    if year == 0:  # a leap year before Python's first
        return _days(400, month) - 146097
    return date(year, month, 1).toordinal() - 719163


@cache
def _compiled(fmt: str):
    regex, groups = layout(fmt).regex()
    return re.compile(regex), groups


def parse(text: str, fmt: str) -> tuple[float, int, frozenset[str]] | None:
    """(wall clock in epoch seconds, characters used, kinds of parts) of a text's beginning."""
    regex, groups = _compiled(fmt)
    m = regex.match(text)
    if not m:
        return None
    return _epoch(dict(zip(groups, m.groups()))), m.end(), layout(fmt).says


def literal(text: str, fmt: str) -> tuple[float, frozenset[str]] | None:
    """A filter's literal by its field's layout, else by the first fallback that takes it whole."""
    for f in (fmt, *FALLBACKS):
        if (got := parse(text, f)) and got[1] == len(text):
            return got[0], got[2]
    return None


def epoch(parts: dict[str, Column]) -> Column:
    """Wall clock in epoch seconds, double, from columns with the texts of the parts."""
    number = lambda k, default: F.coalesce(F.nullif(parts[k], F.lit("")).cast("int"), F.lit(default)) if k in parts else F.lit(default)
    year = number("Y", 1970)
    if "y" in parts:
        short = number("y", 70)
        year = short + F.when(short < 70, 2000).otherwise(1900)
    if "b" in parts:
        month = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m[:3], i + 1)]), F.lower(F.substring(parts["b"], 1, 3))), F.lit(1))
    else:
        month = number("m", 1)
    if not {"Y", "y", "m", "b", "d", "j"} & parts.keys():
        days = F.lit(0)
    elif "j" in parts:
        days = F.unix_date(F.make_date(year, F.lit(1), F.lit(1))) + number("j", 1) - 1
    else:
        days = F.unix_date(F.make_date(year, month, F.lit(1))) + number("d", 1) - 1
    hour = number("H", 0)
    if "p" in parts:
        pm = F.lower(F.substring(parts["p"], 1, 1)) == "p"
        hour = F.when(pm & (hour < 12), hour + 12).when(~pm & (hour == 12), 0).otherwise(hour)
    whole = days.cast("long") * 86400 + hour * 3600 + number("M", 0) * 60 + number("S", 0)
    out = whole.cast("double")
    if "f" in parts:
        digits = F.coalesce(F.nullif(parts["f"], F.lit("")), F.lit("0"))
        out = out + digits.cast("double") / F.pow(F.lit(10.0), F.length(digits).cast("double"))
    return out
