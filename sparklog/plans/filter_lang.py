"""The filter language: comparisons of fields with literals, joined by and, or, not.

    or  := and (('||' | 'or') and)*        not binds tightest, then and, then or
    and := not (('&&' | 'and') not)*
    not := '(' or ')' | ('!' | 'not') not | field operator value

A filter is compiled once, on the driver, to a boolean column over parsed rows. It is
two-valued: every comparison of a field is false on a row that no shape matched.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, lower_literal
from . import tsfmt
from .template import FilterError, Template

MAX_IDENT, MAX_VALUE = 63, 511
ORDER = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
#: Operators as they are read, longer ones first; the word contains is ~.
_OPERATOR = re.compile(r"==|!=|!~|>=|<=|~|>|<|=|(?i:contains)(?![A-Za-z0-9_.])")
_STRTOD = re.compile(r"[ \t\n\v\f\r]*[+-]?(?:0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:infinity|inf|nan))\Z")


@dataclass(frozen=True)
class Node:
    """op: and, or, not, or a comparison's operator; field: an index, or raw or line."""

    op: str
    parts: tuple["Node", ...] = ()
    field: int | str = ""
    value: str = ""
    number: float | None = None
    granule: float | None = None  # of a timestamp: seconds that its equality covers
    of_day: bool = False


def c_double(text: str) -> float | None:
    """A whole text as C reads a double, hexadecimal, inf and nan included."""
    if not _STRTOD.match(text):
        return None
    t = text.strip(" \t\n\v\f\r").lower()
    if "0x" in t:
        try:
            return float.fromhex(t)
        except OverflowError:
            return math.inf
    return float(t)


class _Reader:
    def __init__(self, text: str, template: Template):
        self.text, self.at, self.template = text, 0, template

    def fail(self, what: str):
        raise FilterError(f"{what} (at {self.at + 1} of {self.text!r})")

    def take(self, regex: str) -> str | None:
        m = re.compile(r"[ \t]*(" + regex + ")").match(self.text, self.at)
        if m:
            self.at = m.end()
        return m and m[1]

    def whole(self) -> Node:
        node = self.either()
        if not self.take(r"\Z") and self.take(r"\Z") is None:
            self.fail("unexpected text")
        return node

    def joined(self, op: str, regex: str, part) -> Node:
        parts = [part()]
        while self.take(regex):
            parts.append(part())
        return parts[0] if len(parts) == 1 else Node(op, tuple(parts))

    def either(self) -> Node:
        return self.joined("or", r"\|\||(?i:or)(?![A-Za-z0-9_.])", self.both)

    def both(self) -> Node:
        return self.joined("and", r"&&|(?i:and)(?![A-Za-z0-9_.])", self.one)

    def one(self) -> Node:
        if self.take(r"\("):
            node = self.either()
            if not self.take(r"\)"):
                self.fail("a parenthesis is not closed")
            return node
        if self.take(r"!(?![=~])|(?i:not)(?![A-Za-z0-9_.])"):
            return Node("not", (self.one(),))
        return self.comparison()

    def comparison(self) -> Node:
        name = self.take(rf"[A-Za-z0-9_.]{{1,{MAX_IDENT}}}")
        if not name:
            self.fail("a field name is missing")
        field: int | str | None = "raw" if name == "raw" else "line" if name in ("line", "lineno") else self.template.index(name)
        if field is None:
            self.fail(f"there is no field {name!r}")
        op = self.take(_OPERATOR.pattern)
        if not op:
            self.fail(f"an operator is missing after {name!r}")
        op = {"=": "==", "contains": "~"}.get(op.lower(), op)
        return self.typed(field, op, self.value())

    def value(self) -> str:
        if quote := self.take("[\"']"):
            end = self.text.find(quote, self.at)
            if end < 0 or len(self.text[self.at : end].encode()) > MAX_VALUE:
                self.fail("a quoted value is not closed or too long")
            got, self.at = self.text[self.at : end], end + 1
            return got
        got = self.take(rf"[^ \t)&|]{{1,{MAX_VALUE}}}")
        if not got:
            self.fail("a value is missing")
        return got

    def typed(self, field: int | str, op: str, value: str) -> Node:
        node = Node(op, (), field, value)
        if field == "raw":
            return node
        kind = "line" if field == "line" else self.template.fields[field].type
        if kind == "line":
            number = c_double(value)
            if op in ("~", "!~") or number is None:
                self.fail("line is compared as a number with a number")
            return Node(op, (), field, value, number)
        if kind in ("int", "float"):
            number = c_double(value)
            if number is None and op in ORDER:
                self.fail(f"{self.template.fields[field].name} is a number, {value!r} is none")
            return Node(op, (), field, value, number)
        if kind == "timestamp":
            got = tsfmt.literal(value, self.template.fields[field].format)
            if got is None:
                if op not in ("~", "!~"):
                    self.fail(f"{value!r} is no timestamp")
                return node
            number, says = got
            granule = 0.0 if "fraction" in says else 1.0 if "second" in says else 60.0 if "minute" in says else 3600.0 if "hour" in says else 86400.0
            return Node(op, (), field, value, number, granule, "hour" in says and "date" not in says)
        return node


def parse(text: str, template: Template) -> Node:
    """The filter's tree; FilterError says what is wrong with it and where."""
    return _Reader(text, template).whole()


def _text(op: str, value: str, text: Column) -> Column:
    if op in ("~", "!~"):
        has = F.contains(ascii_lower(text), F.lit(lower_literal(value)))
        return has if op == "~" else ~has
    if op in ORDER:
        return ORDER[op](text, F.lit(value))
    return text == F.lit(value) if op == "==" else text != F.lit(value)


def _number(op: str, value: float, number: Column) -> Column:
    if math.isnan(value):
        return F.lit(op == "!=")
    if op in ORDER:
        return ORDER[op](number, F.lit(value))
    same = F.abs(number - F.lit(value)) < 1e-9
    return same if op == "==" else ~same


def _moment(node: Node, number: Column) -> Column:
    x, v = (number % 86400.0, math.fmod(node.number, 86400.0)) if node.of_day else (number, node.number)
    if node.op in ORDER:
        return ORDER[node.op](x, F.lit(v))
    same = (x >= v) & (x < v + node.granule) if node.granule else F.abs(x - v) < 1e-9
    return same if node.op == "==" else ~same


def to_column(node: Node, template: Template) -> Column:
    """Over parsed rows (raw, lineno, matched, f, n); never null."""
    if node.op in ("and", "or"):
        out = to_column(node.parts[0], template)
        for p in node.parts[1:]:
            out = out & to_column(p, template) if node.op == "and" else out | to_column(p, template)
        return out
    if node.op == "not":
        return ~to_column(node.parts[0], template)
    if node.field == "raw":
        return F.coalesce(_text(node.op, node.value, F.col("raw")), F.lit(False))
    if node.field == "line":
        return _number(node.op, node.number, F.col("lineno").cast("double"))
    name = template.fields[node.field].name
    text, number = F.col("f")[name], F.col("n")[name]
    if node.number is None or node.op in ("~", "!~"):
        said = _text(node.op, node.value, text)
    else:
        said = _moment(node, number) if node.granule is not None else _number(node.op, node.number, number)
        if not all(node.field in v for v in template.variants):  # a shape may lack the field
            said = F.when(number.isNotNull(), said).otherwise(_text(node.op, node.value, text))
    return F.coalesce(F.col("matched") & said, F.lit(False))


def compile_filter(text: str, template: Template) -> Column:
    """A filter expression as a boolean column over rows parsed by the template."""
    return to_column(parse(text, template), template)


def names_of(text: str, template: Template) -> set[str]:
    """What a filter looks at: fields, raw, line."""
    def walk(node: Node) -> set:
        return {node.field} - {None} | {f for p in node.parts for f in walk(p)}

    return {x if isinstance(x, str) else template.fields[x].name for x in walk(parse(text, template))}


def fields_of(text: str, template: Template) -> list[str]:
    """The fields that a filter looks at."""
    seen = names_of(text, template)
    return [f.name for f in template.fields if f.name in seen]
