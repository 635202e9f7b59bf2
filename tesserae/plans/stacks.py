"""Queries of the layer fold: whole stacks of layers with alpha, masks, clipping, groups, knockout, fills and adjustments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import blend
from ..functions.blend import quantise
from ..operators import compose
from ..sources.adapters import LAYERED_SQL, layered
from .common import ORACLES, QUERIES, level
from .tones import d, luma

RGBA = ("r", "g", "b", "a")


def _query(name: str, layers: list[dict], steps: str, last: str) -> None:
    """A stack; ``steps`` are common table expressions after doc, ``last`` the buffer that holds the result."""

    def run(spark, sf_dir):
        out = compose.composite(layered(spark, sf_dir), layers)
        return out.select("img", "x", "y", *[quantise(F.col(c)).alias(c) for c in RGBA])

    QUERIES[f"composite_{name}"] = run
    ORACLES[f"composite_{name}"] = f"WITH {LAYERED_SQL}{steps} SELECT img, x, y, " + ", ".join(f"{level(f'{last}_{c}')} AS {c}" for c in RGBA) + f" FROM {last}"


def pixel(source: str, **more) -> dict:
    return {"kind": "pixel", "source": f"l{source}", **more}


def start(name: str, source: str = "doc") -> str:
    """An empty buffer."""
    return f", {name} AS (SELECT *, " + ", ".join(f"0.0::DOUBLE AS {name}_{c}" for c in RGBA) + f" FROM {source})"


def over(name: str, below: str, src: str, strength: str = "1", mode: str = "normal", rows: str | None = None) -> str:
    """Buffer ``name``: columns {src}_r.. over {below}_r.. of the rows of ``rows``, by Porter and Duff with a blend mode."""
    sa, ab = f"({src}_a * {strength})", f"{below}_a"
    out = []
    for c in "rgb":
        cb, cs = f"{below}_{c}", f"{src}_{c}"
        mixed = cs if mode == "normal" else f"CASE WHEN {ab} > 0 THEN {blend.SQL[mode].format(b=cb, s=cs)} ELSE {cs} END"
        out.append(f"CASE WHEN {sa} <= 0 THEN {cb} ELSE ({sa} * (1 - {ab}) * {cs} + {sa} * {ab} * ({mixed}) + (1 - {sa}) * {ab} * {cb}) / ({sa} + {ab} * (1 - {sa})) END AS {name}_{c}")
    out.append(f"CASE WHEN {sa} <= 0 THEN {ab} ELSE {sa} + {ab} * (1 - {sa}) END AS {name}_a")
    return f", {name} AS (SELECT *, {', '.join(out)} FROM {rows or below})"


def lerp(name: str, before: str, after: str, part: str, rows: str, channels=RGBA) -> str:
    return f", {name} AS (SELECT *, " + ", ".join(
        f"{before}_{c} + ({after}_{c} - {before}_{c}) * {part} AS {name}_{c}" if c in channels else f"{before}_{c} AS {name}_{c}" for c in RGBA) + f" FROM {rows})"


def knocked(name: str, buf: str, floor: str, src: str, mask: str, strength: str, rows: str) -> str:
    """The source over the floor inside the hole that its alpha cuts into the buffer, mixed by premultiplied colour."""
    t, s = f"{name}t", f"({src}_a * {mask})"
    ar = f"({buf}_a + ({t}_a - {buf}_a) * {s})"
    out = [f"CASE WHEN {s} <= 0 THEN {buf}_{c} WHEN {ar} <= 0 THEN 0 ELSE least(1, greatest(0, ({buf}_{c} * {buf}_a + ({t}_{c} * {t}_a - {buf}_{c} * {buf}_a) * {s}) / {ar})) END AS {name}_{c}" for c in "rgb"]
    out.append(f"CASE WHEN {s} <= 0 THEN {buf}_a ELSE greatest({ar}, 0) END AS {name}_a")
    return over(t, floor, src, strength, rows=rows) + f", {name} AS (SELECT *, {', '.join(out)} FROM {t})"


_A = start("b0") + over("b1", "b0", "la")
_query("alpha", [pixel("a"), pixel("b", opacity=0.7), pixel("c", fill_opacity=0.5)], _A + over("b2", "b1", "lb", "0.7::DOUBLE") + over("b3", "b2", "lc", "0.5::DOUBLE"), "b3")
_query("transparent_base", [pixel("b", opacity=0.4), pixel("c", blend="screen")], start("b0") + over("b1", "b0", "lb", "0.4::DOUBLE") + over("b2", "b1", "lc", mode="screen"), "b2")
_query(
    "modes", [pixel("a"), pixel("b", blend="multiply"), pixel("c", blend="soft-light", opacity=0.8), pixel("d", blend="color-dodge")],
    _A + over("b2", "b1", "lb", mode="multiply") + over("b3", "b2", "lc", "0.8::DOUBLE", "soft-light") + over("b4", "b3", "ld", mode="color-dodge"), "b4",
)
_query("mask", [pixel("a"), pixel("b", mask="m")], _A + over("b2", "b1", "lb", "m"), "b2")
_query("mask_density", [pixel("a"), pixel("b", mask="m", density=0.6, opacity=0.9)], _A + over("b2", "b1", "lb", "(0.9::DOUBLE * (1 - 0.6::DOUBLE * (1 - m)))"), "b2")
_query("hidden", [pixel("a"), pixel("b", visible=False), pixel("c", clip=True), pixel("d")], _A + over("b2", "b1", "ld"), "b2")
_query(
    "clipping", [pixel("a"), pixel("b", opacity=0.8, fill_opacity=0.9, blend="multiply"), pixel("c", clip=True), pixel("d", clip=True, blend="screen", opacity=0.5)],
    _A + start("g0", "b1") + over("g1", "g0", "lb", "0.9::DOUBLE") + over("g2", "g1", "lc") + ", g2x AS (SELECT * EXCLUDE (g2_a), g1_a AS g2_a FROM g2)"
    + over("g3", "g2", "ld", "0.5::DOUBLE", "screen", "g2x") + ", g3x AS (SELECT * EXCLUDE (g3_a), g1_a AS g3_a FROM g3)" + over("b2", "b1", "g3", "0.8::DOUBLE", "multiply", "g3x"), "b2",
)
_query(
    "pass_through_group", [pixel("a"), {"kind": "group", "pass_through": True, "opacity": 0.6, "mask": "m", "children": [pixel("b", blend="multiply"), pixel("c", opacity=0.5)]}],
    _A + over("b2", "b1", "lb", mode="multiply") + over("b3", "b2", "lc", "0.5::DOUBLE") + lerp("b4", "b1", "b3", "(0.6::DOUBLE * m)", "b3"), "b4",
)
_query(
    "isolated_group", [pixel("a"), {"kind": "group", "blend": "overlay", "opacity": 0.75, "children": [pixel("b", blend="multiply"), pixel("c", opacity=0.5, blend="difference")]}],
    _A + start("g0", "b1") + over("g1", "g0", "lb", mode="multiply") + over("g2", "g1", "lc", "0.5::DOUBLE", "difference") + over("b2", "b1", "g2", "0.75::DOUBLE", "overlay", "g2"), "b2",
)
_INVERTED = "SELECT *, 1 - {0}_r AS {1}_r, 1 - {0}_g AS {1}_g, 1 - {0}_b AS {1}_b, {0}_a AS {1}_a FROM {0}"
_query(
    "adjustment", [pixel("b"), {"kind": "adjustment", "adjust": "invert", "opacity": 0.5, "mask": "m"}, pixel("c", opacity=0.3)],
    start("b0") + over("b1", "b0", "lb") + f", i AS ({_INVERTED.format('b1', 'i')})" + lerp("b2", "b1", "i", "(CASE WHEN b1_a > 0 THEN 0.5::DOUBLE * m ELSE 0 END)", "i", "rgb") + over("b3", "b2", "lc", "0.3::DOUBLE"), "b3",
)
_CUT = f"CASE WHEN {luma('b1_')} >= 100 / 255.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_query(
    "adjustment_blended", [pixel("a"), {"kind": "adjustment", "adjust": "threshold", "settings": {"level": 100}, "blend": "multiply"}],
    _A + ", t AS (SELECT *, " + ", ".join(f"b1_{c} * {_CUT} AS t_{c}" for c in "rgb") + ", b1_a AS t_a FROM b1)", "t",
)
_query(
    "adjustment_confined", [pixel("a"), {"kind": "group", "pass_through": True, "fill_opacity": 0.8, "children": [pixel("b"), {"kind": "adjustment", "adjust": "invert"}]}],
    _A + over("b2", "b1", "lb") + f", i AS ({_INVERTED.format('b2', 'i')})" + lerp("b3", "b2", "i", "lb_a", "i", "rgb") + lerp("b4", "b1", "b3", "0.8::DOUBLE", "b3"), "b4",
)
_query(
    "knockout_shallow", [pixel("a"), {"kind": "group", "pass_through": True, "children": [pixel("b"), pixel("c", knockout="shallow", fill_opacity=0.3, mask="m")]}],
    _A + over("b2", "b1", "lb") + knocked("b3", "b2", "b1", "lc", "m", "(0.3::DOUBLE * m)", "b2"), "b3",
)
_query(
    "knockout_deep", [pixel("a", background=True), pixel("b"), {"kind": "group", "pass_through": True, "children": [pixel("c"), pixel("d", knockout="deep", fill_opacity=0.2)]}],
    _A + over("b2", "b1", "lb") + over("b3", "b2", "lc") + knocked("b4", "b3", "b1", "ld", "1", "0.2::DOUBLE", "b3"), "b4",
)
_query(
    "fill_solid", [pixel("a"), {"kind": "fill", "color": (250, 120, 10, 128), "blend": "lighten"}],
    _A + ", f AS (SELECT *, 250 / 255.0::DOUBLE AS f_r, 120 / 255.0::DOUBLE AS f_g, 10 / 255.0::DOUBLE AS f_b, 128 / 255.0::DOUBLE AS f_a FROM b1)" + over("b2", "b1", "f", mode="lighten", rows="f"), "b2",
)

_PX, _PY, _L = "(x + 0.5 - 5.0::DOUBLE)", "(y + 0.5 - 8.0::DOUBLE)", math.sqrt(50 * 50 + 40 * 40)
_ALONG, _BESIDE = f"(({_PX} * 50 + {_PY} * 40) / {d(_L)})", f"(({_PY} * 50 - {_PX} * 40) / {d(_L)})"
_PLACE = {
    "linear": f"{_ALONG} / {d(_L)}", "reflected": f"abs({_ALONG}) / {d(_L)}", "radial": f"sqrt({_PX} * {_PX} + {_PY} * {_PY}) / {d(_L)}",
    "diamond": f"greatest(abs({_ALONG}), abs({_BESIDE})) / {d(_L)}", "angle": f"((atan2({_PY}, {_PX}) - {d(math.atan2(40, 50))} + 2 * pi()) % (2 * pi())) / (2 * pi())",
}
for _kind, _t in _PLACE.items():
    _f = ", f AS (SELECT *, " + ", ".join(f"({a} + ({z} - {a}) * i / 511.0::DOUBLE) / 255 AS f_{c}" for c, a, z in zip(RGBA, (0, 40, 200, 255), (255, 200, 20, 0))) + " FROM i)"
    _query(
        f"fill_gradient_{_kind}", [pixel("a"), {"kind": "fill", "gradient": _kind, "from_": (5, 8), "to": (55, 48), "stops": [(0.0, (0, 40, 200, 255)), (1.0, (255, 200, 20, 0))]}],
        _A + f", i AS (SELECT *, floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_t})) * 511 + 0.5) AS i FROM b1)" + _f + over("b2", "b1", "f", rows="f"), "b2",
    )

# The 64-bit hash in hugeints, which hold products of a 64-bit number with 32 bits; the other half is shifted up.
_TOP = "18446744073709551616"


def _times(e: str, by: int) -> str:
    low, high = by & 0xFFFFFFFF, by >> 32
    return f"((({e}) * {low} + ((({e}) * {high}) % 4294967296) * 4294967296) % {_TOP})"


_query(
    "dissolve", [pixel("a"), pixel("b", blend="dissolve", opacity=0.8)],
    _A + f", h0 AS (SELECT *, xor({_times('x::HUGEINT', 0x9E3779B97F4A7C15)}, {_times('y::HUGEINT', 0xC2B2AE3D27D4EB4F)}) AS h FROM b1)"
    + ", h1 AS (SELECT * EXCLUDE (h), xor(h, h // 2147483648) AS h FROM h0)" + f", h2 AS (SELECT * EXCLUDE (h), {_times('h', 0x94D049BB133111EB)} AS h FROM h1)"
    + ", h3 AS (SELECT *, (xor(h, h // 536870912) // 1099511627776)::DOUBLE / 16777216 AS q FROM h2)"
    + ", b2 AS (SELECT *, " + ", ".join(f"CASE WHEN q < lb_a * 0.8::DOUBLE THEN lb_{c} ELSE b1_{c} END AS b2_{c}" for c in "rgb") + ", b1_a AS b2_a FROM h3)", "b2",
)
