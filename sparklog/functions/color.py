"""Colours of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.template import parse_color
from .text import severity_class

#: Levels of the 6x6x6 cube of 256-colour terminals.
CUBE = [0, 95, 135, 175, 215, 255]


def rgb_to_256(rgb: int) -> int:
    """The nearest terminal colour: of the cube, or of the 24 greys where one is strictly nearer."""
    want = [rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255]
    near = [min(range(6), key=lambda i: (abs(CUBE[i] - c), i)) for c in want]
    grey = min(range(24), key=lambda i: (sum((8 + 10 * i - c) ** 2 for c in want), i))
    off = sum((CUBE[i] - c) ** 2 for i, c in zip(near, want))
    if sum((8 + 10 * grey - c) ** 2 for c in want) < off:
        return 232 + grey
    return 16 + 36 * near[0] + 6 * near[1] + near[2]


def style(severity: Column, cont: Column, is_severity_field: bool, color: int | None) -> Column:
    """How a cell is drawn: dim, bold red, red, yellow, cyan, grey, or its field's colour."""
    k = severity_class(severity)
    out = F.when(cont, "dim").when(k >= 5, "bold red").when(k == 4, "red")
    if is_severity_field:
        out = out.when(k == 3, "yellow").when(k == 1, "cyan").when(k == 0, "grey")
    return out.otherwise("" if color is None else f"256:{rgb_to_256(color)}")


__all__ = ["parse_color", "rgb_to_256", "style"]
