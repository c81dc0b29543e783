"""Log templates: named, typed fields and up to four line shapes.

The definition text (.lxt) has `key: value` lines: name, description, entry (a pattern with
%{field} or %{field:type} and %% for a percent sign) and `field NAME: attribute=value ...`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import types as T

#: Limits of a template, and of its parts in bytes.
MAX_FIELDS, MAX_TOKENS, MAX_VALUES, MAX_VARIANTS = 16, 48, 24, 4
MAX_LINE, MAX_SPEC, MAX_ATTRIBUTE, LITERAL_CHUNK = 511, 95, 255, 63
MAX_NAME, MAX_DESCRIPTION, MAX_UNIT, MAX_FORMAT = 31, 95, 15, 63
#: Type names and their aliases; fields that are the severity by their name.
TYPES = {"string": "string", "text": "string", "word": "word", "int": "int", "integer": "int", "float": "float", "double": "float", "number": "float", "timestamp": "timestamp", "enum": "enum"}
SEVERITY_NAMES = ("level", "severity", "lvl", "loglevel", "priority", "pri")
DEFAULT_FORMAT = "%Y-%m-%d %H:%M:%S"
NUMERIC = ("int", "float", "timestamp")


class LogError(ValueError):
    """Base of this package's errors. exit_code: what the command line returns."""

    exit_code = 2


class TemplateError(LogError):
    """A template definition that can't be used."""


class FilterError(LogError):
    """A filter expression that can't be used."""


class LogIOError(LogError):
    """A file that can't be read or written."""

    exit_code = 1


@dataclass(frozen=True)
class Field:
    """A column: its type, and for timestamps a layout, for enums the values."""

    name: str
    type: str = "string"
    format: str = ""
    values: tuple[str, ...] = ()
    unit: str = ""
    color: int | None = None


@dataclass(frozen=True)
class Template:
    """variants: tuples of tokens, an int (index of a field) or a str (literal text)."""

    name: str
    description: str
    fields: tuple[Field, ...]
    variants: tuple[tuple[int | str, ...], ...]
    severity: int | None = None

    def index(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.fields) if f.name == name), None)

    def schema(self) -> T.StructType:
        """Schema of parsed rows; the fields' attributes are column metadata."""
        text, number = T.StructType(), T.StructType()
        for f in self.fields:
            meta = {"lxt_type": f.type, "unit": f.unit, "format": f.format, "values": list(f.values), "color": -1 if f.color is None else f.color}
            text.add(T.StructField(f.name, T.StringType(), True, meta))
            number.add(T.StructField(f.name, T.DoubleType(), True, meta))
        return (
            T.StructType().add("path", "string").add("lineno", "long").add("raw", "string").add("matched", "boolean")
            .add("cont", "boolean").add("entry_id", "long").add("f", text).add("n", number)
        )

    def to_lxt(self) -> str:
        """The definition text; parsing it gives the same template."""
        out = [f"name: {self.name}"] + [f"description: {self.description}"] * bool(self.description) + [""]
        for v in self.variants:
            out.append("entry: " + "".join(f"%{{{self.fields[t].name}}}" if isinstance(t, int) else t.replace("%", "%%") for t in v))
        out.append("")
        for i, f in enumerate(self.fields):
            attributes = [f"type={f.type}"]
            attributes += [f'format="{f.format}"'] * bool(f.format) + ["values=" + ("|".join(f.values) if " " not in "".join(f.values) else f'"{"|".join(f.values)}"')] * bool(f.values)
            attributes += [f"unit={f.unit}"] * bool(f.unit) + [f"color=#{f.color or 0:06X}"] * (f.color is not None) + ["severity=yes"] * (i == self.severity)
            out.append(f"field {f.name}: {' '.join(attributes)}")
        return "\n".join(out) + "\n"


def parse_color(text: str) -> int:
    """#RRGGBB, RRGGBB or #RGB (or RGB) as a number; -1 if it is none."""
    digits = text.removeprefix("#")
    if not re.fullmatch(r"[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3}", digits):
        return -1
    return int("".join(c * 2 for c in digits) if len(digits) == 3 else digits, 16)


def _chunks(literal: str) -> list[str]:
    out, size = [""], 0
    for c in literal:
        n = len(c.encode())
        if size + n > LITERAL_CHUNK:
            out.append("")
            size = 0
        out[-1] += c
        size += n
    return out


def literal_chunks(variant: tuple[int | str, ...]) -> list[int | str]:
    """Tokens with long literals cut as the matcher sees them."""
    return [x for t in variant for x in ([t] if isinstance(t, int) else _chunks(t))]


class _Builder:
    def __init__(self):
        self.fields: list[Field] = []
        self.variants: list[tuple[int | str, ...]] = []
        self.severity: int | None = None

    def field(self, name: str) -> int:
        name = name.encode()[:MAX_NAME].decode(errors="ignore") if len(name.encode()) > MAX_NAME else name
        for i, f in enumerate(self.fields):
            if f.name == name:
                return i
        if len(self.fields) == MAX_FIELDS:
            raise TemplateError(f"a template has {MAX_FIELDS} fields at most")
        self.fields.append(Field(name))
        return len(self.fields) - 1

    def entry(self, pattern: str) -> None:
        if len(self.variants) == MAX_VARIANTS:
            raise TemplateError(f"a template has {MAX_VARIANTS} entry patterns at most")
        tokens: list[int | str] = []
        literal = ""
        for part in re.finditer(r"%\{([^}]*)(\})?|%%|.", pattern, re.S):
            if not part[0].startswith("%{"):
                literal += "%" if part[0] == "%%" else part[0]
                continue
            if literal:
                tokens.append(literal)
                literal = ""
            if part[2] is None:
                raise TemplateError("%{ without } in an entry pattern")
            if len(part[1].encode()) > MAX_SPEC:
                raise TemplateError("a field reference in an entry pattern is too long")
            name, colon, kind = part[1].partition(":")
            if not trim(name):
                raise TemplateError("a field reference in an entry pattern has no name")
            i = self.field(trim(name))
            if colon:
                self.fields[i] = replace(self.fields[i], type=_type(trim(kind)))
            tokens.append(i)
        if literal:
            tokens.append(literal)
        if not tokens:
            raise TemplateError("an entry pattern is empty")
        if len(literal_chunks(tuple(tokens))) > MAX_TOKENS:
            raise TemplateError("an entry pattern has too many parts")
        self.variants.append(tuple(tokens))

    def attributes(self, i: int, text: str) -> None:
        at = 0
        while m := re.compile(r"[ \t,]*([^= \t]+)").match(text, at) or (re.compile(r"[ \t,]*(=)").match(text, at)):
            key, at = m[1], m.end()
            if key == "=":
                key, at = "", at - 1
            if text[at : at + 1] != "=":
                raise TemplateError(f"field {self.fields[i].name}: {key!r} is not attribute=value")
            m = re.compile(r'="([^"]*)"|=([^ \t,"][^ \t,]*|)').match(text, at)
            if not m:
                raise TemplateError(f"field {self.fields[i].name}: a quote is not closed")
            value, at = m[1] if m[1] is not None else m[2], m.end()
            if len(value.encode()) > MAX_ATTRIBUTE:
                raise TemplateError(f"field {self.fields[i].name}: the value of {key} is too long")
            self.attribute(i, key, value)

    def attribute(self, i: int, key: str, value: str) -> None:
        f = self.fields[i]
        if key == "type":
            f = replace(f, type=_type(value))
        elif key == "format":
            f = replace(f, format=value[:MAX_FORMAT], type="timestamp" if f.type == "string" else f.type)
        elif key == "values":
            values = f.values + tuple(v for v in map(trim, re.split(r"[|,]", value)) if v)
            if len(values) > MAX_VALUES:
                raise TemplateError(f"field {f.name}: more than {MAX_VALUES} values")
            values = tuple(sorted(values, key=lambda v: -len(v.encode())))
            f = replace(f, values=values, type="enum" if f.type in ("string", "word") else f.type)
        elif key == "unit":
            f = replace(f, unit=value[:MAX_UNIT])
        elif key == "severity":
            if value.lower() in ("yes", "true", "1"):
                self.severity = i
        elif key in ("color", "colour"):
            color = parse_color(value)
            if color < 0:
                raise TemplateError(f"field {f.name}: {value!r} is not a colour like #5FAFD7")
            f = replace(f, color=color)
        else:
            raise TemplateError(f"field {f.name}: there is no attribute {key!r}")
        self.fields[i] = f


def trim(s: str) -> str:
    """Without leading blanks and tabs, and trailing ones, carriage returns and newlines."""
    return s.lstrip(" \t").rstrip(" \t\r\n")


def _type(name: str) -> str:
    kind = TYPES.get(name.lower())
    if kind is None:
        raise TemplateError(f"there is no field type {name!r}")
    return kind


def parse(text: str) -> Template:
    """A template from its definition; TemplateError says what is wrong with it."""
    made, name, description = _Builder(), "", ""
    for number, line in enumerate(text.split("\n"), 1):
        if len(line.encode()) > MAX_LINE:
            raise TemplateError(f"line {number} is too long")
        line = trim(line)
        if not line or line.startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if not colon:
            raise TemplateError(f"line {number} is not `key: value`")
        key, value = trim(key), trim(value)
        if key == "name":
            name = value[:MAX_NAME]
        elif key == "description":
            description = value[:MAX_DESCRIPTION]
        elif key == "entry":
            made.entry(value)
        elif re.match(r"field[ \t]", key):
            made.attributes(made.field(trim(key[5:])), value)
        else:
            raise TemplateError(f"line {number}: there is no key {key!r}")
    if not made.variants:
        raise TemplateError("a template needs an entry pattern")
    fields = tuple(replace(f, format=DEFAULT_FORMAT) if f.type == "timestamp" and not f.format else f for f in made.fields)
    severity = made.severity
    if severity is None:
        severity = next((i for i, f in enumerate(fields) if f.name.lower() in SEVERITY_NAMES), None)
    return Template(name or "custom", description, fields, tuple(made.variants), severity)


def load(path: str) -> Template:
    """A template from a file."""
    try:
        return parse(Path(path).read_text())
    except OSError as e:
        raise LogIOError(str(e)) from e
