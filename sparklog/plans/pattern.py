"""A template as one regex, evaluated once a line.

Every token is atomic or possessive: a line's match never backtracks into an earlier token, and
only the variants alternate. Captures stand outside atomic groups (Java would keep them after a
failed variant). The result of a match is one string with the slots between newlines, which no
line contains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import tsfmt
from .template import Template, literal_chunks

INT = "[+-]?+[0-9]++"
FLOAT = r"[+-]?(?:[0-9]++\.?+[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+"


@dataclass(frozen=True)
class Pattern:
    """regex; replacement: all slots; slots: (field, part or "") of each, in order; total: whether every line matches."""

    regex: str
    replacement: str
    slots: tuple[tuple[int, str], ...]
    total: bool


def _literal(text: str) -> str:
    return "".join(r"[ \t]++" if x[0] == " " else tsfmt.quote(x) for x in re.findall(r" +|[^ ]+", text))


def _enum(values: tuple[str, ...]) -> str:
    if not values:
        return "(?!)"
    return "(?>" + "|".join(tsfmt.quote(v) + ("(?![0-9A-Za-z_])" if re.search(r"[0-9A-Za-z_]\Z", v) else "") for v in values) + ")"


def build(template: Template, wanted: set[str] | None = None) -> Pattern:
    """wanted: fields to capture, all by default."""
    groups: dict[tuple[int, str], list[int]] = {}
    count = 0
    variants = []
    for variant in template.variants:
        tokens = literal_chunks(variant)
        last = {t: i for i, t in enumerate(tokens) if isinstance(t, int)}
        out = ""
        for i, token in enumerate(tokens):
            if isinstance(token, str):
                out += _literal(token)
                continue
            field = template.fields[token]
            keep = last[token] == i and (wanted is None or field.name in wanted)
            if keep:
                count += 1
                groups.setdefault((token, ""), []).append(count)
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            ahead = _literal(after) if isinstance(after, str) else None
            before, parts = "", []
            if field.type == "string":
                body = f"(?>.*?(?={ahead}))" if ahead else ".*+"
            elif field.type == "word":
                before = f"(?!{ahead})" if ahead else ""
                body = rf"(?>[^ \t]+?(?={ahead}))" if ahead else r"[^ \t]++"
            elif field.type == "int":
                body = INT
            elif field.type == "float":
                before, body = r"[ \t]*+", FLOAT
            elif field.type == "enum":
                body = _enum(field.values)
            else:
                body, parts = tsfmt.layout(field.format).regex(keep)
            out += before + (f"({body})" if keep else f"(?:{body})")
            for part in parts:
                count += 1
                groups.setdefault((token, part), []).append(count)
        variants.append(out + r"[ \t\r]*+\z")
    slots = tuple(sorted(groups))
    replacement = "\n" + "\n".join("".join(f"${g}" for g in groups[s]) for s in slots)
    total = any(len(v) == 1 and isinstance(v[0], int) and template.fields[v[0]].type == "string" for v in template.variants)
    return Pattern(r"(?s)\A(?:" + "|".join(variants) + ")", replacement, slots, total)


def python_regex(template: Template) -> re.Pattern:
    """The pattern for driver-side samples."""
    return re.compile(build(template).regex.replace(r"\z", r"\Z"))


def match(template: Template, line: str) -> dict[str, str] | None:
    """Field texts of one line on the driver, or None; absent fields are empty."""
    p = build(template)
    m = python_regex(template).match(line)
    if not m:
        return None
    index = {s: k for k, s in enumerate(p.slots)}
    values = p.replacement.split("\n")[1:]
    out = {f.name: "" for f in template.fields}
    for (field, part), k in index.items():
        if not part:
            out[template.fields[field].name] = "".join(m[int(g)] or "" for g in values[k].split("$")[1:])
    return out
