"""Queries of the filters, with alpha where they weigh by it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import filters
from ..sources.adapters import PX_SQL, pixels, translucent
from .common import ORACLES, QUERIES, RGB, clip, pixel_query
from .tones import d

ENDS = ", ends AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img)"
ALPHA = ", pa AS (SELECT *, (r + 2 * g + x) % 256 AS a FROM px)"


def lv(e: str) -> str:
    """A level: halves up, within the tie that Spark takes for one."""
    return f"floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {e})) + 0.5000001::DOUBLE)::INT"


def near(reach: int, source: str = "px", columns=RGB) -> str:
    """Each pixel with those of the square around it, the canvas edge repeated."""
    moved = f"SELECT p.*, dx, dy, least(w - 1, greatest(0, x + dx)) AS nx, least(h - 1, greatest(0, y + dy)) AS ny FROM {source} p JOIN ends USING (img), (SELECT unnest(range(-{reach}, {reach + 1})) AS dx) i, (SELECT unnest(range(-{reach}, {reach + 1})) AS dy) j"
    return ENDS + f""", moved AS ({moved}),
    near AS (SELECT p.img, p.x, p.y, dx, dy, {', '.join(f'p.{c} AS {c}0, q.{c}' for c in columns)} FROM moved p JOIN {source} q ON q.img = p.img AND q.x = p.nx AND q.y = p.ny)"""


def grouped(expression: str) -> str:
    return "SELECT img, x, y, " + ", ".join(f"{expression.format(c=c)} AS {c}" for c in RGB) + " FROM near GROUP BY img, x, y"


def alpha_query(name: str, make, sql: str, more: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(translucent(pixels(spark, sf_dir)))
    ORACLES[name] = f"WITH {PX_SQL}{ALPHA}{more} {sql}"


def bell(sigma: float) -> str:
    """The sampled kernel at (dx, dy), over its sum."""
    reach = math.ceil(3 * sigma)
    total = sum(math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1))
    return f"(exp(-(dx * dx + dy * dy) / {d(2 * sigma * sigma)}) / {d(total * total)})"


pixel_query("filter_gaussian_blur", lambda px: filters.gaussian_blur(px, 1.2), grouped(lv(f"sum({{c}} * {bell(1.2)})")), near(4))
_WEIGHED = ", ".join(f"coalesce({lv(f'sum({c} * a / 255.0::DOUBLE * k) * 255 / nullif(sum(a * k), 0)')}, 0) AS {c}" for c in RGB)
alpha_query(
    "filter_gaussian_blur_alpha", lambda px: filters.gaussian_blur(px, 0.8),
    f"SELECT img, x, y, {_WEIGHED}, {lv('sum(a * k)')} AS a FROM (SELECT *, {bell(0.8)} AS k FROM near) GROUP BY img, x, y", near(3, "pa", (*RGB, "a")),
)


def _box(sigma: float):
    s2 = sigma * sigma / 4
    r = int((math.sqrt(1 + 12 * s2) - 1) / 2)
    return r, (2 * r + 1) * (r * (r + 1) - 3 * s2) / (6 * (s2 - (r + 1) ** 2))


def _passes(sigma: float) -> tuple[str, str]:
    """Four extended boxes along rows and columns, as sums over joined places."""
    r, part = _box(sigma)
    out, at = ENDS + f", s0 AS (SELECT img, x, y, {', '.join(f'{c}::DOUBLE AS {c}' for c in RGB)} FROM px)", "s0"
    for k in range(8):
        axis, last = ("x", "w") if k % 2 == 0 else ("y", "h")
        same = "y" if axis == "x" else "x"
        out += f""", s{k + 1} AS (SELECT p.img, p.x, p.y, {', '.join(f'sum(q.{c} * CASE WHEN abs(k) > {r} THEN {d(part)} ELSE 1 END) / {d(2 * r + 1 + 2 * part)} AS {c}' for c in RGB)}
          FROM {at} p JOIN ends USING (img), (SELECT unnest(range(-{r + 1}, {r + 2})) AS k) i, {at} q
          WHERE q.img = p.img AND q.{same} = p.{same} AND q.{axis} = least({last} - 1, greatest(0, p.{axis} + k)) GROUP BY p.img, p.x, p.y)"""
        at = f"s{k + 1}"
    return out, at


_more, _last = _passes(3.0)
pixel_query("filter_gaussian_blur_wide", lambda px: filters.gaussian_blur(px, 3.0), f"SELECT img, x, y, {', '.join(f'{lv(c)} AS {c}' for c in RGB)} FROM {_last}", _more)
_BELL = "(min({c}0) - sum({c} * " + bell(1.0) + "))"
pixel_query(
    "filter_unsharp_mask", lambda px: filters.unsharp_mask(px, 120, 1.0, 4),
    grouped(f"CASE WHEN abs({_BELL}) >= 4 THEN {lv(f'min({{c}}0) + 1.2::DOUBLE * {_BELL}')} ELSE min({{c}}0) END"), near(3),
)
pixel_query("filter_high_pass", lambda px: filters.high_pass(px, 1.0), grouped(lv(f"{_BELL} + 128")), near(3))
pixel_query("filter_median", lambda px: filters.median(px, 1), grouped("list_sort(list({c}))[5]::INT"), near(1))
pixel_query("filter_median_wide", lambda px: filters.median(px, 2), grouped("list_sort(list({c}))[13]::INT"), near(2))
pixel_query(
    "filter_dust_and_scratches", lambda px: filters.median(px, 1, 20),
    grouped("(CASE WHEN abs(min({c}0) - list_sort(list({c}))[5]) > 20 THEN list_sort(list({c}))[5] ELSE min({c}0) END)::INT"), near(1),
)
pixel_query(
    "filter_find_edges", filters.find_edges,
    grouped(lv("255 - sqrt(pow(sum({c} * dx * (2 - abs(dy))), 2) + pow(sum({c} * dy * (2 - abs(dx))), 2)) / 2")), near(1),
)
_KERNEL = (0, -1, 0, -1, 6, -1, 0, -1, 1)
_K = "[" + ", ".join(map(str, _KERNEL)) + "][(dy + 1) * 3 + dx + 2]"
pixel_query("filter_custom", lambda px: filters.custom(px, _KERNEL, 3, 10), grouped(lv(f"sum({{c}} * {_K}) / 3.0::DOUBLE + 10")), near(1))
_ACC = "least(255.0::DOUBLE, greatest(0.0::DOUBLE, sum(a * k) / 4.0::DOUBLE))"
alpha_query(
    "filter_custom_alpha", lambda px: filters.custom(px, (0, 1, 0, 1, 0, 1, 0, 1, 0), 4, 5),
    "SELECT img, x, y, " + ", ".join(f"coalesce({lv(f'least({_ACC}, greatest(0.0::DOUBLE, sum({c} * a / 255.0::DOUBLE * k) / 4.0::DOUBLE + 5 * {_ACC} / 255)) * 255 / nullif({_ACC}, 0)')}, 0) AS {c}" for c in RGB)
    + f", {lv(_ACC)} AS a FROM (SELECT *, (abs(dx) + abs(dy) = 1)::INT AS k FROM near) GROUP BY img, x, y", near(1, "pa", (*RGB, "a")),
)
# Light from 135 degrees, height 2: samples at (-s, -s) and (s, s) with s = sqrt(1/2), bilinear between the middle and the corner.
_s = math.sqrt(0.5)
_lean = lambda sign: f"(greatest(0.0::DOUBLE, 1 - abs(dx - {d(sign * _s)})) * greatest(0.0::DOUBLE, 1 - abs(dy - {d(sign * _s)})))"
pixel_query("filter_emboss", lambda px: filters.emboss(px, 135, 2, 150), grouped(lv(f"128 + (sum({{c}} * {_lean(-1)}) - sum({{c}} * {_lean(1)})) * 1.5")), near(1))
_W = "greatest(0.0::DOUBLE, 1 - abs({c} - {c}0) / 50.0::DOUBLE)"
pixel_query("filter_surface_blur", lambda px: filters.surface_blur(px, 2, 20), grouped(lv(f"min({{c}}0) + sum({_W} * ({{c}} - {{c}}0)) / sum({_W})")), near(2))
pixel_query("filter_solarize", filters.solarize, "SELECT img, x, y, " + ", ".join(f"CASE WHEN {c} < 128 THEN {c} ELSE 255 - {c} END AS {c}" for c in RGB) + " FROM px")
pixel_query("filter_invert", filters.invert, "SELECT img, x, y, " + ", ".join(f"255 - {c} AS {c}" for c in RGB) + " FROM px")
_GREY = "((greatest(r, g, b) + least(r, g, b) + 1) // 2)::INT"
pixel_query("filter_desaturate", filters.desaturate, f"SELECT img, x, y, {_GREY} AS r, {_GREY} AS g, {_GREY} AS b FROM px")
pixel_query(
    "filter_apply_adjustment", lambda px: filters.apply_adjustment(px, "posterize", levels=5),
    "SELECT img, x, y, " + ", ".join(f"{lv(f'least(floor({c} / 255.0::DOUBLE * 5), 4) / 4.0::DOUBLE * 255')} AS {c}" for c in RGB) + " FROM px",
)
pixel_query("filter_offset", lambda px: filters.offset(px, 10, -7), "SELECT img, ((x + 10) % w)::INT AS x, ((y - 7 + h) % h)::INT AS y, r, g, b FROM px JOIN ends USING (img)", ENDS)
pixel_query(
    "filter_offset_cleared", lambda px: filters.offset(px, 10, 7, wrap=False),
    "SELECT p.img, p.x, p.y, " + ", ".join(f"coalesce(q.{c}, 0) AS {c}" for c in RGB) + ", CASE WHEN q.img IS NULL THEN 0 ELSE 255 END AS a FROM px p LEFT JOIN px q ON q.img = p.img AND q.x = p.x - 10 AND q.y = p.y - 7",
)
_LIN = "(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
_DIM = f"({_LIN} * (1 - 0.6::DOUBLE * s))"
_VIGNETTE = ENDS + f""", t AS (SELECT px.*, {clip("(sqrt((pow((x + 0.5 - w / 2.0::DOUBLE) / (w / 2.0::DOUBLE), 2) + pow((y + 0.5 - h / 2.0::DOUBLE) / (h / 2.0::DOUBLE), 2)) / 2) - (0.15::DOUBLE + 0.75::DOUBLE * 0.4::DOUBLE)) / (0.05::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE)")} AS t
  FROM px JOIN ends USING (img)), s AS (SELECT *, t * t * (3 - 2 * t) AS s FROM t)"""
pixel_query(
    "filter_vignette", lambda px: filters.vignette(px, -60, 40, 50),
    "SELECT img, x, y, " + ", ".join(f"CASE WHEN s <= 0 THEN {c} ELSE {lv(f'(CASE WHEN {_DIM} <= 0.0031308::DOUBLE THEN {_DIM} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({_DIM}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) * 255'.format(c=c))} END AS {c}" for c in RGB) + " FROM s", _VIGNETTE,
)
pixel_query(
    "filter_vignette_light", lambda px: filters.vignette(px, 45, 40, 50),
    "SELECT img, x, y, " + ", ".join(f"CASE WHEN s <= 0 THEN {c} ELSE {lv(f'{c} + (255 - {c}) * 0.45::DOUBLE * s')} END AS {c}" for c in RGB) + " FROM s", _VIGNETTE,
)


def sampled(place: str, where: str = "true") -> str:
    """Common table expressions that sample px at u and v, which ``place`` selects from px and ends."""
    taps = " + ".join(f"{{c}}{i}{j} * {'fx' if i else '(1 - fx)'} * {'fy' if j else '(1 - fy)'}" for i in (0, 1) for j in (0, 1))
    joins = " ".join(f"JOIN px q{i}{j} ON q{i}{j}.img = t.img AND q{i}{j}.x = least(t.x0 + {i}, t.w - 1) AND q{i}{j}.y = least(t.y0 + {j}, t.h - 1)" for i in (0, 1) for j in (0, 1))
    columns = ", ".join(f"q{i}{j}.{c} AS {c}{i}{j}" for c in RGB for i in (0, 1) for j in (0, 1))
    return (
        ENDS + f", uv AS (SELECT img, x, y, w, h, {where} AS ok, {place} FROM (SELECT *, x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy, w / 2.0::DOUBLE AS mx, h / 2.0::DOUBLE AS my FROM px JOIN ends USING (img)) z)"
        ", spot AS (SELECT *, CASE WHEN ok THEN least(w - 1.0::DOUBLE, greatest(0.0::DOUBLE, u - 0.5)) ELSE x END AS uu, CASE WHEN ok THEN least(h - 1.0::DOUBLE, greatest(0.0::DOUBLE, v - 0.5)) ELSE y END AS vv FROM uv)"
        ", t AS (SELECT img, x, y, w, h, floor(uu)::INT AS x0, floor(vv)::INT AS y0, uu - floor(uu) AS fx, vv - floor(vv) AS fy FROM spot)"
        f", taps AS (SELECT t.*, {columns} FROM t {joins})", taps,
    )


def warped(name: str, make, place: str, where: str = "true") -> None:
    more, taps = sampled(place, where)
    pixel_query(name, make, "SELECT img, x, y, " + ", ".join(f"{lv(taps.format(c=c))} AS {c}" for c in RGB) + " FROM taps", more)


_D = "(sqrt(pow(cx - mx, 2) + pow(cy - my, 2)) / least(mx, my))"
_T = f"((1 - {_D}) * (1 - {_D}) * {d(math.radians(75))})"
warped("filter_twirl", lambda px: filters.twirl(px, 75), f"mx + (cx - mx) * cos({_T}) - (cy - my) * sin({_T}) AS u, my + (cx - mx) * sin({_T}) + (cy - my) * cos({_T}) AS v", f"{_D} < 1")
_circle = lambda f: f"mx + (cx - mx) * {f} AS u, my + (cy - my) * {f} AS v"
_in = f"{_D} < 1 AND {_D} > 0"
warped("filter_pinch", lambda px: filters.pinch(px, 50), _circle(f"pow(sin(CASE WHEN {_in} THEN {_D} ELSE 0.5 END * pi() / 2), -0.3::DOUBLE)"), _in)
warped("filter_spherize", lambda px: filters.spherize(px, 60), _circle(f"(CASE WHEN {_in} THEN ({_D} + (asin(CASE WHEN {_in} THEN {_D} ELSE 0 END) * 2 / pi() - {_D}) * 0.6::DOUBLE) / {_D} ELSE 1 END)"), _in)
warped("filter_ripple", lambda px: filters.ripple(px, 120, "small"), "cx + 0.96::DOUBLE * sin(cy * (2 * pi() / 10)) AS u, cy + 0.96::DOUBLE * sin(cx * (2 * pi() / 10)) AS v")
warped(
    "filter_polar_coordinates", filters.polar_coordinates,
    "(atan2((cx - mx) / mx, -(cy - my) / my) + CASE WHEN atan2((cx - mx) / mx, -(cy - my) / my) < 0 THEN 2 * pi() ELSE 0 END) / (2 * pi()) * w AS u, least(sqrt(pow((cx - mx) / mx, 2) + pow((cy - my) / my, 2)) * h, h - 0.5::DOUBLE) AS v",
)
warped("filter_polar_to_rectangular", lambda px: filters.polar_coordinates(px, False), "mx + sin(cx / w * 2 * pi()) * cy / h * mx AS u, my - cos(cx / w * 2 * pi()) * cy / h * my AS v")

_LOW = f", low AS ({grouped(lv(f'sum({{c}} * {bell(1.0)})'))})"
_odd = lambda c: f"(CASE WHEN (p.{c} - l.{c}) % 2 <> 0 THEN l.{c} WHEN l.{c} < 255 THEN l.{c} + 1 ELSE l.{c} - 1 END)"
pixel_query(
    "filter_frequency_separation", lambda px: filters.frequency_separation(px, 1.0).drop(*RGB),
    "SELECT p.img, p.x, p.y, " + ", ".join(f"{_odd(c)}::INT AS low_{c}, ((p.{c} - {_odd(c)} + 255) // 2)::INT AS high_{c}" for c in RGB) + " FROM px p JOIN low l USING (img, x, y)", near(3) + _LOW,
)

_REACH = {"nearest": 0.5, "bilinear": 1, "bicubic": 2, "lanczos": 3}
_AT = {
    "nearest": "CASE WHEN q <= 0.5 THEN 1 ELSE 0 END", "bilinear": "greatest(0.0::DOUBLE, 1 - q)",
    "bicubic": "CASE WHEN q < 1 THEN 1.5 * q * q * q - 2.5 * q * q + 1 WHEN q < 2 THEN -0.5 * q * q * q + 2.5 * q * q - 4 * q + 2 ELSE 0 END",
    "lanczos": "CASE WHEN q < 0.00000001 THEN 1 WHEN q < 3 THEN 3 * sin(pi() * q) * sin(pi() * q / 3) / pow(pi() * q, 2) ELSE 0 END",
}


def _axis(name: str, src: int, dst: int, method: str) -> str:
    ratio = f"({d(src)} / {d(dst)})"
    scale = f"greatest(1.0::DOUBLE, {ratio})"
    return f""", {name}w AS (SELECT i, j, {_AT[method]} AS k FROM (SELECT i, j, abs((j + 0.5 - (i + 0.5) * {ratio}) / {scale})::DOUBLE AS q FROM (SELECT unnest(range({dst})) AS i) a, (SELECT unnest(range({src})) AS j) b
      WHERE j >= floor((i + 0.5) * {ratio} - {_REACH[method]} * {scale}) AND j < ceil((i + 0.5) * {ratio} + {_REACH[method]} * {scale})) c),
    {name} AS (SELECT i, j, k / sum(k) OVER (PARTITION BY i) AS k FROM {name}w)"""


#: The first 16 rows of each image, so that all are 64 by 16.
_TOP = ", top AS (SELECT * FROM px WHERE y < 16)"
for _method, (_w, _h) in {"nearest": (40, 25), "bilinear": (96, 10), "bicubic": (30, 24), "lanczos": (80, 12)}.items():
    _sum = ", ".join(f"{lv(f'sum({c} * a.k * b.k)')} AS {c}" for c in RGB)
    pixel_query(
        f"image_resize_{_method}", lambda px, m=_method, w=_w, h=_h: filters.resize(px.where("y < 16"), 64, 16, w, h, m),
        f"SELECT img, a.i::INT AS x, b.i::INT AS y, {_sum} FROM top JOIN ax a ON a.j = x JOIN ay b ON b.j = y GROUP BY img, a.i, b.i", _TOP + _axis("ax", 64, _w, _method) + _axis("ay", 16, _h, _method),
    )
for _anchor, (_ox, _oy) in {"top-left": (0, 0), "center": (8, -3), "bottom-right": (16, -6)}.items():
    pixel_query(
        f"image_canvas_size_{_anchor.replace('-', '_')}", lambda px, a=_anchor: filters.canvas_size(px.where("y < 16"), 64, 16, 80, 10, a),
        f"SELECT img, x + {_ox} AS x, y + {_oy} AS y, r, g, b FROM px WHERE y < 16 AND y + {_oy} BETWEEN 0 AND 9",
    )
