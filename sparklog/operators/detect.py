"""Which built-in template a log has."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import pattern
from ..plans.builtins import all_builtins, builtin
from ..plans.template import Template
from ..sources.lines import sample

#: Lines looked at, and the share that must match.
LINES, SHARE = 50, 0.6


def ratios(lines: DataFrame) -> list[tuple[str, float]]:
    """The share of the first lines (not empty, not indented) that each built-in but plain
    matches."""
    some = sample(lines, LINES, indented=False)
    out = []
    for name, t in all_builtins().items():
        if name != "plain":
            regex = pattern.python_regex(t)
            out.append((name, sum(regex.match(x) is not None for x in some) / len(some) if some else 0.0))
    return out


def detect(lines: DataFrame) -> Template:
    """The built-in of the largest share, the earliest of equals, if that is 0.6 or more; else
    plain. Custom templates are never detected."""
    name, share = max(ratios(lines), key=lambda x: x[1])
    return builtin(name if share >= SHARE else "plain")
