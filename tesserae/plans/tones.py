"""Queries of the tone and colour adjustments."""

from __future__ import annotations

from ..functions import tone
from .common import RGB, UNIT_SQL, as_levels, clip, each, levels_of, pixel_query, unit

LUMA = "(0.299::DOUBLE * {0}r + 0.587::DOUBLE * {0}g + 0.114::DOUBLE * {0}b)"


def luma(prefix: str = "") -> str:
    return LUMA.format(prefix)


def _query(name: str, kind: str, sql: str, more: str = "", **settings) -> None:
    pixel_query(f"adjust_{name}", lambda px: as_levels(tone.apply(unit(px), kind, **settings)), sql, UNIT_SQL + more)


def _stage(expression: str, source: str, extra: str = "") -> str:
    return "(SELECT img, x, y" + extra + ", " + ", ".join(f"{expression.format(c=c)} AS {c}" for c in RGB) + f" FROM {source})"


#: As reals, so that DuckDB doesn't take them for decimals.
def d(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


_query("invert", "invert", each("1 - {c}"))
_query("posterize", "posterize", each("least(floor({c} * 4), 3) / 3.0::DOUBLE"), levels=4)
_cut = f"CASE WHEN {luma()} >= 128 / 255.0::DOUBLE THEN 255 ELSE 0 END"
_query("threshold", "threshold", f"SELECT img, x, y, {_cut} AS r, {_cut} AS g, {_cut} AS b FROM u", level=128)

_b, _k = 30 / 150, 1 + 3 * 0.2
_g = 1 / (1 + 1.5 * _b)
_query(
    "brightness_contrast", "brightness-contrast",
    each(f"CASE WHEN {{c}} < 0.5 THEN 0.5 * pow(2 * {{c}}, {d(_k)}) ELSE 1 - 0.5 * pow(2 * (1 - {{c}}), {d(_k)}) END", "s"),
    f", s AS {_stage(f'pow({{c}}, {d(_g)})', 'u')}", brightness=30, contrast=20,
)
_query(
    "brightness_contrast_legacy", "brightness-contrast", each(f"({{c}} - 25 / 255.0::DOUBLE - 0.5) * {d(1.4)} + 0.5"),
    brightness=-25, contrast=40, legacy=True,
)


def _levels(v: str, low, high, gamma, a, z) -> str:
    t = clip(f"({v} - {d(low)} / 255) / (greatest({d(high)} / 255, {d(low)} / 255 + 0.001::DOUBLE) - {d(low)} / 255)")
    return f"({d(a)} / 255 + ({d(z)} / 255 - {d(a)} / 255) * pow({t}, {d(1 / gamma)}))"


_query(
    "levels", "levels",
    "SELECT img, x, y, " + ", ".join(f"floor({clip(_levels(_levels(c, lo, 240, 1.2, 0, 250) if c == 'r' else _levels(c, lo, 255, 1, 0, 255), 10, 245, 0.8, 5, 255))} * 255 + 0.5000001::DOUBLE)::INT AS {c}" for c, lo in zip(RGB, (20, 0, 0))) + " FROM u",
    master={"in_black": 10, "in_white": 245, "gamma": 0.8, "out_black": 5}, red={"in_black": 20, "in_white": 240, "gamma": 1.2, "out_white": 250},
)
# White below black: the span is never less than a thousandth.
_query("levels_narrow", "levels", each(_levels("{c}", 128, 100, 1, 0, 255)), master={"in_black": 128, "in_white": 100})

# A curve through (0, 0), (64, 90), (128, 140), (192, 180), (255, 255); slopes by the averages of neighbours (all are monotone).
_POINTS = [(0, 0), (64, 90), (128, 140), (192, 180), (255, 255)]


def _hermite(v: str) -> str:
    p = [(x / 255, y / 255) for x, y in _POINTS]
    run = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(p, p[1:])]
    slope = [run[0], *((a + b) / 2 for a, b in zip(run, run[1:])), run[-1]]
    out = "CASE "
    for i, (a, b) in enumerate(zip(p, p[1:])):
        h = b[0] - a[0]
        t = f"(({v} - {d(a[0])}) / {d(h)})"
        y = (
            f"(2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) * {d(a[1])} + (pow({t}, 3) - 2 * pow({t}, 2) + {t}) * {d(h * slope[i])}"
            f" + (3 * pow({t}, 2) - 2 * pow({t}, 3)) * {d(b[1])} + (pow({t}, 3) - pow({t}, 2)) * {d(h * slope[i + 1])}"
        )
        out += f"WHEN {v} <= {d(b[0])} THEN {y} "
    return out + "ELSE 1 END"


_query("curves", "curves", each(_hermite("{c}")), master=_POINTS)

_LINEAR = "(CASE WHEN {c} <= 0.04045::DOUBLE THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
_BACK = "(CASE WHEN {c} <= 0.0031308::DOUBLE THEN {c} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({c}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END)"
_query(
    "exposure", "exposure", each(_BACK, "s"),
    f", s AS {_stage(f'pow(greatest(0.0::DOUBLE, {_LINEAR} * pow(2, 0.7::DOUBLE) - 0.02::DOUBLE), {d(1 / 1.1)})', 'u')}",
    exposure=0.7, offset=-0.02, gamma=1.1,
)

_query(
    "vibrance", "vibrance", each("l + ({c} - l) * k", "s"),
    f""", s AS (SELECT img, x, y, r, g, b, {luma()} AS l, greatest(0.0::DOUBLE, (1 - 0.1::DOUBLE)
      * (1 + 0.6::DOUBLE * (1 - (greatest(r, g, b) - least(r, g, b))) * CASE WHEN r >= g AND g >= b THEN 0.5::DOUBLE ELSE 1 END)) AS k FROM u)""",
    vibrance=60, saturation=-10,
)

_HSL = """, h0 AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM {0}),
{1} AS (SELECT *, (mx + mn) / 2 AS l, CASE WHEN mx = mn THEN 0 ELSE least(1.0::DOUBLE, (mx - mn) / greatest(1 - abs(mx + mn - 1), 0.000001::DOUBLE)) END AS s,
  60 * CASE WHEN mx = mn THEN 0 WHEN mx = r THEN ((g - b) / (mx - mn) + 6) % 6 WHEN mx = g THEN (b - r) / (mx - mn) + 2 ELSE (r - g) / (mx - mn) + 4 END AS h FROM h0)"""


def _from_hsl(h: str, s: str, l: str) -> list[str]:
    """Channels by distance on the circle: l - a * max(-1, min(k - 3, 9 - k, 1)) with k at 0, 8 and 4 twelfths and a = s * min(l, 1 - l)."""
    out = []
    for n in (0, 8, 4):
        k = f"(({n} + ({h}) / 30.0::DOUBLE) % 12)"
        out.append(f"(({l}) - ({s}) * least({l}, 1 - ({l})) * greatest(-1.0::DOUBLE, least({k} - 3, 9 - {k}, 1.0::DOUBLE)))")
    return out


_query(
    "hue_saturation_colorize", "hue-saturation",
    "SELECT img, x, y, " + ", ".join(f"floor({clip(e)} * 255 + 0.5000001::DOUBLE)::INT AS {c}" for e, c in zip(_from_hsl("210.0::DOUBLE", "0.4::DOUBLE", "m"), RGB)) + " FROM s",
    ", s AS (SELECT img, x, y, ((greatest(r, g, b) + least(r, g, b)) / 2) * 0.9::DOUBLE AS m FROM u)",
    colorize=True, hue=210, saturation=40, lightness=-10,
)
_turned = _from_hsl("(h + 40) % 360", "s", "l")
_query(
    "hue_saturation_master", "hue-saturation",
    "SELECT img, x, y, " + ", ".join(f"floor({clip(f'{c} + ({c} - m) * k')} * 255 + 0.5000001::DOUBLE)::INT AS {c}" for c in RGB) + " FROM w",
    _HSL.format("u", "hh") + ", t0 AS (SELECT img, x, y, " + ", ".join(f"{e} AS {c}" for e, c in zip(_turned, RGB)) + " FROM hh)"
    + f", t AS {_stage('({c} + (1 - {c}) * 0.1::DOUBLE)', 't0')}"
    + """, t1 AS (SELECT *, (greatest(r, g, b) + least(r, g, b)) / 2 AS m, greatest(r, g, b) - least(r, g, b) AS d FROM t),
    w AS (SELECT *, CASE WHEN d <= 0.000000000001 THEN 0 ELSE least(0.25::DOUBLE / 0.75, greatest(0.0::DOUBLE, greatest(1 - abs(2 * m - 1), 0.000001::DOUBLE) / d - 1)) END AS k FROM t1)""",
    hue=40, saturation=25, lightness=10,
)
# Greens (90 to 150, whole between 105 and 135 with shoulders of 30) turn by 60 degrees times their weight, blues lose chroma.
_wg = "CASE WHEN h BETWEEN 75 AND 105 THEN (h - 75) / 30 WHEN h BETWEEN 105 AND 135 THEN 1 WHEN h BETWEEN 135 AND 165 THEN (165 - h) / 30 ELSE 0 END"
_wb = "CASE WHEN h BETWEEN 195 AND 225 THEN (h - 195) / 30 WHEN h BETWEEN 225 AND 255 THEN 1 WHEN h BETWEEN 255 AND 285 THEN (285 - h) / 30 ELSE 0 END"
_part = _from_hsl("(h + 60 * wg) % 360", "s", "l")
_query(
    "hue_saturation_ranges", "hue-saturation",
    "SELECT img, x, y, " + ", ".join(f"floor({clip(f'{c} + ({c} - m) * (-0.5::DOUBLE * wb)')} * 255 + 0.5000001::DOUBLE)::INT AS {c}" for c in RGB) + " FROM w",
    _HSL.format("u", "hh") + f", n AS (SELECT img, x, y, h, s, l, CASE WHEN s > 0 THEN {_wg} ELSE 0 END AS wg, CASE WHEN s > 0 THEN {_wb} ELSE 0 END AS wb FROM hh)"
    + ", t AS (SELECT img, x, y, wb, " + ", ".join(f"{e} AS {c}" for e, c in zip(_part, RGB)) + " FROM n)"
    + ", w AS (SELECT *, (greatest(r, g, b) + least(r, g, b)) / 2 AS m FROM t)",
    ranges=[(0, 0, 0), (0, 0, 0), (60, 0, 0), (0, 0, 0), (0, -50, 0), (0, 0, 0)],
)


def _smooth(a: str, b: str, v: str) -> str:
    t = clip(f"({v} - {a}) / ({b} - {a})")
    return f"({t} * {t} * (3 - 2 * {t}))"


def _balance(c: str, s: float, m: float, h: float) -> str:
    dark = f"({clip(f'1 - {c} / 0.333::DOUBLE')} * 0.7::DOUBLE + (1 - {_smooth('0', '0.5::DOUBLE', c)}) * 0.3::DOUBLE)"
    light = f"({clip(f'({c} - 0.667::DOUBLE) / 0.333::DOUBLE')} * 0.7::DOUBLE + {_smooth('0.5::DOUBLE', '1', c)} * 0.3::DOUBLE)"
    mid = clip(f"1 - abs({c} - 0.5) * 2")
    return clip(f"{c} + ({d(s / 100)} * {dark} + {d(m / 100)} * {mid} + {d(h / 100)} * {light}) * 0.25::DOUBLE")


_S, _M, _H = (20, -10, 5), (10, 0, -15), (-5, 10, 25)
_query(
    "color_balance", "color-balance", each(f"{{c}} + l - {luma()}", "s"),
    f", s AS (SELECT img, x, y, {luma()} AS l, " + ", ".join(f"{_balance(c, *x)} AS {c}" for c, *x in zip(RGB, _S, _M, _H)) + " FROM u)",
    shadows=_S, midtones=_M, highlights=_H,
)

_GREY = """CASE WHEN r >= g AND g >= b THEN b + (r - g) * 0.4::DOUBLE + (g - b) * 0.6::DOUBLE WHEN r >= b AND b >= g THEN g + (r - b) * 0.4::DOUBLE + (b - g) * 0.8::DOUBLE
  WHEN g >= r AND r >= b THEN b + (g - r) * 0.4::DOUBLE + (r - b) * 0.6::DOUBLE WHEN g >= b AND b >= r THEN r + (g - b) * 0.4::DOUBLE + (b - r) * 0.6::DOUBLE
  WHEN b >= r AND r >= g THEN g + (b - r) * 0.2::DOUBLE + (r - g) * 0.8::DOUBLE ELSE r + (b - g) * 0.2::DOUBLE + (g - r) * 0.6::DOUBLE END"""
_query(
    "black_white", "black-white", "SELECT img, x, y, y0 AS r, y0 AS g, y0 AS b FROM s",
    f", s AS (SELECT img, x, y, floor({clip(_GREY)} * 255 + 0.5000001::DOUBLE)::INT AS y0 FROM u)",
)
_TINT = [225 / 255, 211 / 255, 179 / 255]
_TL = 0.299 * _TINT[0] + 0.587 * _TINT[1] + 0.114 * _TINT[2]
_query(
    "black_white_tint", "black-white", each(f"{{c}} + q - {luma()}", "t"),
    f", s AS (SELECT img, x, y, {clip(_GREY)} AS q FROM u), t AS (SELECT img, x, y, q, " + ", ".join(f"{clip(f'{d(v)} / {d(_TL)} * q')} AS {c}" for v, c in zip(_TINT, RGB)) + " FROM s)",
    tint=(225, 211, 179),
)
_query(
    "photo_filter", "photo-filter", each(f"{{c}} + l - {luma()}", "s"),
    f", s AS (SELECT img, x, y, {luma()} AS l, " + ", ".join(f"({c} + ({c} * ({k} / 255.0::DOUBLE) - {c}) * 0.25::DOUBLE) AS {c}" for c, k in zip(RGB, (236, 138, 0))) + " FROM u)",
)
_MIX = ((70, 20, 10, 0), (0, 100, 0, 5), (-20, 30, 90, 0))
_row = lambda m: clip(f"({m[0]} * r + {m[1]} * g + {m[2]} * b) / 100 + {m[3]} / 100.0::DOUBLE")
_query(
    "channel_mixer", "channel-mixer", levels_of("s"),
    ", s AS (SELECT img, x, y, " + ", ".join(f"{_row(m)} AS {c}" for m, c in zip(_MIX, RGB)) + " FROM u)", red=_MIX[0], green=_MIX[1], blue=_MIX[2],
)
_query(
    "channel_mixer_monochrome", "channel-mixer", levels_of("s"),
    ", s AS (SELECT img, x, y, " + ", ".join(f"{_row((40, 40, 20, 0))} AS {c}" for c in RGB) + " FROM u)", red=(40, 40, 20, 0), monochrome=True,
)

_STOPS = ((0.0, (20, 0, 60)), (0.4, (200, 60, 40)), (1.0, (255, 240, 180)))


def _gradient(k: int, i: str) -> str:
    t, (a, b, c) = f"(({i}) / 255.0::DOUBLE)", [s[1][k] / 255 for s in _STOPS]
    return f"(CASE WHEN {t} <= 0.4::DOUBLE THEN {d(a)} + ({d(b)} - {d(a)}) * {t} / 0.4::DOUBLE ELSE {d(b)} + ({d(c)} - {d(b)}) * ({t} - 0.4::DOUBLE) / 0.6::DOUBLE END)"


_query(
    "gradient_map", "gradient-map", levels_of("t"),
    f", s AS (SELECT img, x, y, {luma()} * 255 AS q, least(floor({luma()} * 255), 254) AS i FROM u), t AS (SELECT img, x, y, "
    + ", ".join(f"{_gradient(k, 'i')} + ({_gradient(k, 'i + 1')} - {_gradient(k, 'i')}) * (q - i) AS {c}" for k, c in enumerate(RGB)) + " FROM s)",
    stops=_STOPS,
)

_COLORS = {"reds": (10, -20, 30, 5), "cyans": (-40, 0, 20, 0), "neutrals": (5, 5, -10, 0), "blacks": (0, 0, 0, 20), "yellows": (0, 15, -25, 0)}
_W = {
    "reds": "CASE WHEN r = mx THEN mx - md ELSE 0 END", "cyans": "CASE WHEN b <> mn AND g <> mn THEN md - mn ELSE 0 END",
    "yellows": "CASE WHEN b = mn THEN md - mn ELSE 0 END", "blacks": clip("(0.5 - mx) * 2"), "neutrals": clip("1 - (abs(mx - 0.5) + abs(mn - 0.5))"),
}


def _inked(ch: int, c: str) -> str:
    out = c
    for name, four in _COLORS.items():
        ink = (four[ch] + four[3]) / 100
        if ink:
            out += f" - ({_W[name]}) * {d(ink)}" + (f" * (1 - {c})" if ink > 0 else "")
    return clip(out)


_query(
    "selective_color", "selective-color", levels_of("t"),
    ", s AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, r + g + b - greatest(r, g, b) - least(r, g, b) AS md FROM u), t AS (SELECT img, x, y, "
    + ", ".join(f"{_inked(k, c)} AS {c}" for k, c in enumerate(RGB)) + " FROM s)", colors=_COLORS,
)

#: A cube of 3: each channel squared and swapped a little with the next.
_CUBE = [(r * r / 4, (g + r) / 4, b / 4 + g * g / 8) for b in range(3) for g in range(3) for r in range(3)]


def _line(f, c: str) -> str:
    """A function known at 0, 1/2 and 1, by straight lines."""
    return f"(CASE WHEN {c} < 0.5 THEN {d(f(0))} + ({d(f(1))} - {d(f(0))}) * 2 * {c} ELSE {d(f(1))} + ({d(f(2))} - {d(f(1))}) * (2 * {c} - 1) END)"


_looked = (_line(lambda r: r * r / 4, "r"), "((g * 2 + r * 2) / 4)", f"(b * 2 / 4 + {_line(lambda g: g * g / 8, 'g')})")
_query(
    "color_lookup", "color-lookup", levels_of("s"),
    ", s AS (SELECT img, x, y, " + ", ".join(f"{c} + ({e} - {c}) * 0.8::DOUBLE AS {c}" for e, c in zip(_looked, RGB)) + " FROM u)",
    size=3, table=_CUBE, strength=0.8,
)


def _mix_stages(source: str, name: str, x: str, y: str, seed: int) -> str:
    """Common table expressions that add a lattice value ``name`` to ``source``'s rows."""
    m = lambda e, by: f"((({e})::HUGEINT * {by}) % 4294967296)::BIGINT"
    steps = [f"xor({m(f'(({y}) + 4294967296) % 4294967296', 0x85EBCA77)}, {seed})", "xor(q, q >> 16)", m("q", 0x7FEB352D), "xor(q, q >> 15)", m("q", 0x846CA68B), "xor(q, q >> 16)",
             f"xor(q, {m(f'(({x}) + 4294967296) % 4294967296', 0x9E3779B1)})", "xor(q, q >> 16)", m("q", 0x7FEB352D), "xor(q, q >> 15)", m("q", 0x846CA68B), "xor(q, q >> 16)"]
    out, at = "", source
    for k, s in enumerate(steps):
        out += f", {name}_{k} AS (SELECT * {'EXCLUDE (q)' if k else ''}, {s} AS q FROM {at})"
        at = f"{name}_{k}"
    return out + f", {name}_v AS (SELECT * EXCLUDE (q), (q % 65536) / 65535.0::DOUBLE + (q >> 16) / 65535.0::DOUBLE - 1 AS {name} FROM {at})"


_grain, _src = ", g0 AS (SELECT *, floor((x + 0.5) / 1.5::DOUBLE)::BIGINT AS cx, floor((y + 0.5) / 1.5::DOUBLE)::BIGINT AS cy FROM u)", "g0"
for _name, _x, _y, _seed in (("n00", "cx", "cy", 1), ("n10", "cx + 1", "cy", 1), ("n01", "cx", "cy + 1", 1), ("n11", "cx + 1", "cy + 1", 1), ("fine", "x", "y", tone.mixed(1 ^ 0xA511E9B3))):
    _grain += _mix_stages(_src, _name, _x, _y, _seed)
    _src = f"{_name}_v"
_ease = lambda a, c: f"(({a} + 0.5) / 1.5::DOUBLE - {c})"
_query(
    "grain", "grain", each("{c} + (s + (fine - s) * 0.5) * 0.35::DOUBLE * 0.25 * (0.4::DOUBLE + 2.4::DOUBLE * l * (1 - l))", "g3"),
    _grain + f", g1 AS (SELECT *, {_ease('x', 'cx')} AS tx, {_ease('y', 'cy')} AS ty FROM {_src}), g2 AS (SELECT * EXCLUDE (tx, ty), tx * tx * (3 - 2 * tx) AS tx, ty * ty * (3 - 2 * ty) AS ty FROM g1)"
    + ", g3 AS (SELECT *, ((n00 + (n10 - n00) * tx) + ((n01 + (n11 - n01) * tx) - (n00 + (n10 - n00) * tx)) * ty) * 1.6::DOUBLE AS s, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM g2)",
)
