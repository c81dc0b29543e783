"""A slow character-by-character matcher, written from the semantics, to test the regexes."""

import re

from sparklog.plans.template import literal_chunks

BLANK = " \t"


def literal(text, s, at):
    i = 0
    while i < len(text):
        if text[i] == " ":
            while i < len(text) and text[i] == " ":
                i += 1
            begin = at
            while at < len(s) and s[at] in BLANK:
                at += 1
            if at == begin:
                return None
        elif at < len(s) and s[at] == text[i]:
            i, at = i + 1, at + 1
        else:
            return None
    return at


def digits(s, at, most):
    end = at
    while end < len(s) and end - at < most and s[end] in "0123456789":
        end += 1
    return s[at:end], end


MONTHS = "january february march april may june july august september october november december".split()


def moment(fmt, s, at):
    """The end of a timestamp, or None."""
    i = 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%":
            d, i = fmt[i + 1], i + 2
            if d == "Y":
                got, end = digits(s, at, 4)
                if len(got) < 4:
                    return None
            elif d == "y":
                got, end = digits(s, at, 2)
                if len(got) < 2:
                    return None
            elif d in "mdeHIMSj":
                if d == "e":
                    while at < len(s) and s[at] == " ":
                        at += 1
                got, end = digits(s, at, 3 if d == "j" else 2)
                low, high = {"m": (1, 12), "d": (1, 31), "e": (1, 31), "H": (0, 23), "I": (1, 12), "M": (0, 59), "S": (0, 60), "j": (1, 366)}[d]
                if not got or not low <= int(got) <= high:
                    return None
            elif d in "bBh":
                name = next((m for m in MONTHS + [m[:3] for m in MONTHS] if s[at : at + len(m)].lower() == m), None)
                if not name:
                    return None
                end = at + len(name)
            elif d == "f":
                got, end = digits(s, at, 9)
                if not got:
                    return None
            elif d == "p":
                if s[at : at + 2].upper() not in ("AM", "PM"):
                    return None
                end = at + 2
            elif d in "aA":
                end = at
                while end < len(s) and re.match("[A-Za-z]", s[end]):
                    end += 1
                if end == at:
                    return None
            elif d == "Z":
                end = at
                while end < len(s) and s[end] == " ":
                    end += 1
                word = end
                while end < len(s) and re.match("[A-Za-z]", s[end]):
                    end += 1
                end = at if end == word else end
            elif d == "z":
                while at < len(s) and s[at] == " ":
                    at += 1
                if s[at : at + 1] in ("Z", "z"):
                    end = at + 1
                elif s[at : at + 1] in ("+", "-"):
                    got, end = digits(s, at + 1, 2)
                    if not got:
                        return None
                    if s[end : end + 1] in (":", "."):
                        got, end = digits(s, end + 1, 2)
                        if len(got) < 2:
                            return None
                    else:
                        got, more = digits(s, end, 2)
                        end = more if len(got) == 2 else end
                else:
                    return None
            elif d == "%":
                if s[at : at + 1] != "%":
                    return None
                end = at + 1
            else:
                return None
            at = end
        elif c in BLANK:
            while i < len(fmt) and fmt[i] in BLANK:
                i += 1
            begin = at
            while at < len(s) and s[at] in BLANK:
                at += 1
            if at == begin:
                return None
        else:
            if s[at : at + 1] != c:
                return None
            i, at = i + 1, at + 1
    return at


def token(field, after, s, at):
    """(text, end) or None."""
    if field.type in ("string", "word"):
        if isinstance(after, str):
            end = at
            while literal(after, s, end) is None:
                if end >= len(s) or field.type == "word" and s[end] in BLANK:
                    return None
                end += 1
            return None if field.type == "word" and end == at else (s[at:end], end)
        if field.type == "string":
            return s[at:], len(s)
        end = at
        while end < len(s) and s[end] not in BLANK:
            end += 1
        return (s[at:end], end) if end > at else None
    if field.type == "int":
        end = at + (s[at : at + 1] in ("+", "-"))
        got, end = digits(s, end, 10**9)
        return (s[at:end], end) if got else None
    if field.type == "float":
        while at < len(s) and s[at] in BLANK:
            at += 1
        m = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?").match(s, at)
        return (m[0], m.end()) if m else None
    if field.type == "timestamp":
        end = moment(field.format, s, at)
        return None if end is None else (s[at:end], end)
    word = re.compile("[0-9A-Za-z_]")
    for v in field.values:
        end = at + len(v)
        if s.startswith(v, at) and not (word.match(v[-1]) and word.match(s[end : end + 1] or " ")):
            return v, end
    return None


def match(template, s):
    """Field texts, or None."""
    for variant in template.variants:
        tokens, at = literal_chunks(variant), 0
        out = {f.name: "" for f in template.fields}
        for i, t in enumerate(tokens):
            if isinstance(t, str):
                at = literal(t, s, at)
            else:
                got = token(template.fields[t], tokens[i + 1] if i + 1 < len(tokens) else None, s, at)
                at = None if got is None else got[1]
                if got is not None:
                    out[template.fields[t].name] = got[0]
            if at is None:
                break
        if at is not None and not s[at:].strip(" \t\r"):
            return out
    return None
