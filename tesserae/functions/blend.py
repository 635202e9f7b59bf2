"""Blend modes as column expressions of a backdrop ``b`` and a source ``s`` in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Far below the resolution of the single-precision arithmetic that results are compared with.
TIE = 1e-7


def _screen(b, s):
    return b + s - b * s


def _hard(b, s):
    return F.when(s <= 0.5, 2 * b * s).otherwise(_screen(b, 2 * s - 1))


def _burn(b, s):
    return F.when(b >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), (1 - b) / s))


def _dodge(b, s):
    return F.when(b <= 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(F.lit(1.0), b / (1 - s)))


def _unit(v):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


SEPARABLE = {
    "normal": lambda b, s: s,
    "darken": lambda b, s: F.least(b, s),
    "multiply": lambda b, s: b * s,
    "color-burn": _burn,
    "linear-burn": lambda b, s: F.greatest(F.lit(0.0), b + s - 1),
    "lighten": lambda b, s: F.greatest(b, s),
    "screen": _screen,
    "color-dodge": _dodge,
    "linear-dodge": lambda b, s: F.least(F.lit(1.0), b + s),
    "overlay": lambda b, s: _hard(s, b),
    "soft-light": lambda b, s: F.when(s <= 0.5, 2 * b * s + b * b * (1 - 2 * s)).otherwise(F.sqrt(b) * (2 * s - 1) + 2 * b * (1 - s)),
    "hard-light": _hard,
    "vivid-light": lambda b, s: F.when(s <= 0.5, _burn(b, 2 * s)).otherwise(_dodge(b, 2 * (s - 0.5))),
    "linear-light": lambda b, s: _unit(b + 2 * s - 1),
    "pin-light": lambda b, s: F.when(s <= 0.5, F.least(b, 2 * s)).otherwise(F.greatest(b, 2 * s - 1)),
    "hard-mix": lambda b, s: F.when(b + s >= 1 - 1e-6, 1.0).otherwise(0.0),
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
    "subtract": lambda b, s: F.greatest(F.lit(0.0), b - s),
    "divide": lambda b, s: F.when(s <= 0, F.when(b <= 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), b / F.nullif(s, F.lit(0.0)))),
}


def lum(c: list[Column]) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def sat(c: list[Column]) -> Column:
    return F.greatest(*c) - F.least(*c)


def set_lum(c: list[Column], to: Column) -> list[Column]:
    """The colour with another luminosity, pulled towards grey where it leaves 0..1."""
    moved = [x + (to - lum(c)) for x in c]
    low, high, grey = F.least(*moved), F.greatest(*moved), lum(moved)
    out = [F.when(low < 0, grey + (x - grey) * grey / (grey - low)).otherwise(x) for x in moved]
    return [F.when(high > 1, grey + (x - grey) * (1 - grey) / (high - grey)).otherwise(x) for x in out]


def set_sat(c: list[Column], to: Column) -> list[Column]:
    low, span = F.least(*c), sat(c)
    return [F.when(span > 0, (x - low) * to / span).otherwise(0.0) for x in c]


WHOLE = {
    "darker-color": lambda b, s: [F.when(lum(s) < lum(b), y).otherwise(x) for x, y in zip(b, s)],
    "lighter-color": lambda b, s: [F.when(lum(s) > lum(b), y).otherwise(x) for x, y in zip(b, s)],
    "color": lambda b, s: set_lum(s, lum(b)),
    "luminosity": lambda b, s: set_lum(b, lum(s)),
    "hue": lambda b, s: set_lum(set_sat(s, sat(b)), lum(b)),
    "saturation": lambda b, s: set_lum(set_sat(b, sat(s)), lum(b)),
}


def blend(mode: str, b: list[Column], s: list[Column]) -> list[Column]:
    if mode in WHOLE:
        return WHOLE[mode](b, s)
    return [SEPARABLE[mode](x, y) for x, y in zip(b, s)]


def quantise(v: Column) -> Column:
    """0..1 to 0..255, halves up; what lies within TIE of a half counts as one, however its sum was rounded."""
    return F.floor(_unit(v) * 255 + (0.5 + TIE)).cast("int")


#: The separable modes in SQL.
SQL = {
    "normal": "{s}", "darken": "least({b}, {s})", "multiply": "{b} * {s}",
    "color-burn": "CASE WHEN {b} >= 1 THEN 1 WHEN {s} <= 0 THEN 0 ELSE 1 - least(1, (1 - {b}) / {s}) END",
    "linear-burn": "greatest(0, {b} + {s} - 1)", "lighten": "greatest({b}, {s})", "screen": "{b} + {s} - {b} * {s}",
    "color-dodge": "CASE WHEN {b} <= 0 THEN 0 WHEN {s} >= 1 THEN 1 ELSE least(1, {b} / (1 - {s})) END",
    "linear-dodge": "least(1, {b} + {s})",
    "overlay": "CASE WHEN {b} <= 0.5 THEN 2 * {s} * {b} ELSE {s} + (2 * {b} - 1) - {s} * (2 * {b} - 1) END",
    "soft-light": "CASE WHEN {s} <= 0.5 THEN 2 * {b} * {s} + {b} * {b} * (1 - 2 * {s}) ELSE sqrt({b}) * (2 * {s} - 1) + 2 * {b} * (1 - {s}) END",
    "hard-light": "CASE WHEN {s} <= 0.5 THEN 2 * {b} * {s} ELSE {b} + (2 * {s} - 1) - {b} * (2 * {s} - 1) END",
    "vivid-light": (
        "CASE WHEN {s} <= 0.5 THEN CASE WHEN {b} >= 1 THEN 1 WHEN {s} <= 0 THEN 0 ELSE 1 - least(1, (1 - {b}) / (2 * {s})) END "
        "ELSE CASE WHEN {b} <= 0 THEN 0 WHEN {s} >= 1 THEN 1 ELSE least(1, {b} / (1 - 2 * ({s} - 0.5))) END END"
    ),
    "linear-light": "least(1, greatest(0, {b} + 2 * {s} - 1))",
    "pin-light": "CASE WHEN {s} <= 0.5 THEN least({b}, 2 * {s}) ELSE greatest({b}, 2 * {s} - 1) END",
    "hard-mix": "CASE WHEN {b} + {s} >= 1 - 1e-6 THEN 1 ELSE 0 END", "difference": "abs({b} - {s})",
    "exclusion": "{b} + {s} - 2 * {b} * {s}", "subtract": "greatest(0, {b} - {s})",
    "divide": "CASE WHEN {s} <= 0 THEN CASE WHEN {b} <= 0 THEN 0 ELSE 1 END ELSE least(1, {b} / {s}) END",
}
