"""Queries of the selections."""

from __future__ import annotations

from ..operators import selection
from .common import RGB, pixel_query
from .filters import alpha_query, near
from .tones import d

OLD = "CASE WHEN x BETWEEN 4 AND 33 AND y BETWEEN 4 AND 23 THEN 255 ELSE 0 END"
#: A selection with soft places: the rectangle, and beyond it a quarter of the red channel.
SOFT = f"CASE WHEN x BETWEEN 4 AND 33 AND y BETWEEN 4 AND 23 THEN 255 ELSE r // 2 END"


def old(px):
    return selection.rect(px, 4, 4, 30, 20)


def soft(px):
    from pyspark.sql import functions as F

    inside = F.col("x").between(4, 33) & F.col("y").between(4, 23)
    return px.select("img", "x", "y", F.when(inside, 255).otherwise(F.floor(F.col("r") / 2).cast("int")).alias("cover"))


def rnd(e: str) -> str:
    return f"least(255, greatest(0, floor({e} + 0.5000001::DOUBLE)))::INT"


pixel_query("select_all", selection.everything, "SELECT img, x, y, 255 AS cover FROM px")
pixel_query("select_none", lambda px: selection.cover_of(px, None).select("img", "x", "y", "cover"), "SELECT img, x, y, 255 AS cover FROM px")
pixel_query("select_invert", lambda px: selection.invert(px, soft(px)), f"SELECT img, x, y, (255 - ({SOFT}))::INT AS cover FROM px")
pixel_query("select_invert_none", lambda px: selection.invert(px, None), "SELECT img, x, y, 0 AS cover FROM px")
pixel_query("select_rect", lambda px: selection.rect(px, 3.6, 4.4, 29.5, 20.2), f"SELECT img, x, y, ({OLD})::INT AS cover FROM px")
pixel_query(
    "select_subtract_from_none", lambda px: selection.merge(px, None, soft(px), "subtract"), f"SELECT img, x, y, (255 * (255 - ({SOFT})) // 255)::INT AS cover FROM px",
)
_UV = "(SELECT u, v FROM (SELECT unnest([0.125::DOUBLE, 0.375, 0.625, 0.875]) AS u) a, (SELECT unnest([0.125::DOUBLE, 0.375, 0.625, 0.875]) AS v) b) s"
pixel_query(
    "select_ellipse", lambda px: selection.ellipse(px, 8, 5, 40, 24),
    f"SELECT img, x, y, {rnd('sum((pow((x + u - 28) / 20, 2) + pow((y + v - 17) / 12, 2) <= 1)::INT) * 255 / 16.0::DOUBLE')} AS cover FROM px, {_UV} GROUP BY img, x, y",
)
# Even-odd equals winding for a polygon that doesn't cross itself.
_POLY = [(5, 3), (58, 9), (40, 30), (12, 27)]
_ODD = " + ".join(f"(((y + v >= {a[1]}) <> (y + v >= {b[1]})) AND x + u < {a[0]} + (y + v - {a[1]}) * {d((b[0] - a[0]) / (b[1] - a[1]))})::INT" for a, b in zip(_POLY, [*_POLY[1:], _POLY[0]]))
pixel_query(
    "select_polygon", lambda px: selection.polygon(px, _POLY),
    f"SELECT img, x, y, {rnd(f'sum(({_ODD}) % 2) * 255 / 16.0::DOUBLE')} AS cover FROM px, {_UV} GROUP BY img, x, y",
)
alpha_query("select_layer_alpha", selection.layer_alpha, "SELECT img, x, y, a::INT AS cover FROM pa", "")


def _passes(source: str, reach: int, times: int) -> tuple[str, str]:
    """Box means along rows and columns as joins of places, edges repeated."""
    out, at = ", ends AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img)", source
    for k in range(2 * times):
        axis, last = ("x", "w") if k % 2 == 0 else ("y", "h")
        same = "y" if axis == "x" else "x"
        moved = f"SELECT p.img, p.x, p.y, least({last} - 1, greatest(0, p.{axis} + k)) AS n FROM {at} p JOIN ends USING (img), (SELECT unnest(range(-{reach}, {reach + 1})) AS k) i"
        out += f", f{k} AS (SELECT p.img, p.x, p.y, sum(q.cover) / {d(2 * reach + 1)} AS cover FROM ({moved}) p JOIN {at} q ON q.img = p.img AND q.{same} = p.{same} AND q.{axis} = p.n GROUP BY p.img, p.x, p.y)"
        at = f"f{k}"
    return out, at


_SOFT = f", sel AS (SELECT img, x, y, ({SOFT})::INT AS cover FROM px)"
_more, _last = _passes("sel", 2, 3)
pixel_query("select_feather", lambda px: selection.feather(soft(px), 3.0), f"SELECT img, x, y, {rnd('cover')} AS cover FROM {_last}", _SOFT + _more)


def _distance(name: str, feature: str, reach: int) -> str:
    """The squared distance of each place to the nearest with a feature, among those near enough."""
    return f""", {name} AS (SELECT s.img, s.x, s.y, min(s.cover) AS cover, min(q.dx * q.dx + q.dy * q.dy) AS d2 FROM sel s LEFT JOIN
      (SELECT img, x + dx AS x, y + dy AS y, dx, dy FROM sel, (SELECT unnest(range(-{reach}, {reach + 1})) AS dx) a, (SELECT unnest(range(-{reach}, {reach + 1})) AS dy) b WHERE {feature}) q
      ON q.img = s.img AND q.x = s.x AND q.y = s.y GROUP BY s.img, s.x, s.y)"""


def _grown(by: float) -> str:
    return f"greatest(cover, coalesce({rnd(f'least(1.0::DOUBLE, greatest(0.0::DOUBLE, {d(by + 1)} - sqrt(d2))) * 255')}, 0))"


def _shrunk(by: float) -> str:
    return f"least(cover, coalesce({rnd(f'least(1.0::DOUBLE, greatest(0.0::DOUBLE, sqrt(d2) - {d(by)})) * 255')}, 255))"


pixel_query("select_grow", lambda px: selection.grow(soft(px), 2.5), f"SELECT img, x, y, {_grown(2.5)}::INT AS cover FROM g", _SOFT + _distance("g", "cover >= 128", 4))
pixel_query("select_shrink", lambda px: selection.shrink(soft(px), 1.5), f"SELECT img, x, y, {_shrunk(1.5)}::INT AS cover FROM g", _SOFT + _distance("g", "cover < 128", 3))
_BAND = f", band AS (SELECT o.img, o.x, o.y, {_grown(1.5).replace('cover', 'o.cover').replace('d2', 'o.d2')} * (255 - {_shrunk(1.5).replace('cover', 'i.cover').replace('d2', 'i.d2')}) / 255.0::DOUBLE AS cover FROM go o JOIN si i USING (img, x, y))"
_more, _last = _passes("band", 1, 1)
pixel_query(
    "select_border", lambda px: selection.border(soft(px), 3.0), f"SELECT img, x, y, {rnd('cover')} AS cover FROM {_last}",
    _SOFT + _distance("go", "cover >= 128", 3) + _distance("si", "cover < 128", 3) + _BAND + _more,
)
pixel_query(
    "select_smooth", lambda px: selection.smooth(soft(px), 2),
    f"SELECT s.img, s.x, s.y, {rnd('least(1.0::DOUBLE, greatest(0.0::DOUBLE, (avg((q.cover >= 128)::INT) - 0.5) * 5 + 0.5)) * 255')} AS cover FROM"
    " (SELECT img, x + dx AS x, y + dy AS y, cover FROM sel, (SELECT unnest(range(-2, 3)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b) q JOIN sel s ON q.img = s.img AND q.x = s.x AND q.y = s.y GROUP BY s.img, s.x, s.y", _SOFT,
)
_SEED = ", hard AS (SELECT p.img, p.x, p.y, CASE WHEN greatest(abs(p.r - s.r), abs(p.g - s.g), abs(p.b - s.b)) <= {0} THEN 255 ELSE 0 END AS cover FROM px p JOIN px s ON s.img = p.img AND s.x = 20 AND s.y = 12)"
pixel_query("select_magic_wand", lambda px: selection.magic_wand(px, 20, 12, 40), "SELECT img, x, y, cover FROM hard", _SEED.format(40))
pixel_query(
    "select_magic_wand_smooth", lambda px: selection.magic_wand(px, 20, 12, 40, smooth=True),
    "SELECT img, x, y, (CASE WHEN bool_and(cover = cover0 OR abs(dx) + abs(dy) <> 1) THEN min(cover0) ELSE (sum(cover * (2 - abs(dx)) * (2 - abs(dy))) + 8) // 16 END)::INT AS cover FROM near GROUP BY img, x, y",
    _SEED.format(40) + near(1, "hard", ("cover",)),
)
pixel_query(
    "select_magic_wand_contiguous", lambda px: selection.magic_wand(px, 20, 12, 90, contiguous=True),
    """, flood AS (SELECT img, x, y FROM hard WHERE x = 20 AND y = 12 AND cover > 0
      UNION SELECT h.img, h.x, h.y FROM flood f JOIN steps ON true JOIN hard h ON h.img = f.img AND h.x = f.x + dx AND h.y = f.y + dy WHERE h.cover > 0)
    SELECT h.img, h.x, h.y, CASE WHEN f.img IS NULL THEN 0 ELSE 255 END AS cover FROM hard h LEFT JOIN flood f USING (img, x, y)""".lstrip(", "),
    _SEED.format(90) + ", steps AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)),",
)
pixel_query(
    "select_similar", lambda px: selection.similar(px, selection.rect(px, 10, 6, 2, 2), 20),
    """SELECT p.img, p.x, p.y, CASE WHEN p.x IN (10, 11) AND p.y IN (6, 7) OR max(s.img) IS NOT NULL THEN 255 ELSE 0 END AS cover FROM px p
       LEFT JOIN px s ON s.img = p.img AND s.x IN (10, 11) AND s.y IN (6, 7) AND abs(s.r // 4 - p.r // 4) <= 5 AND abs(s.g // 4 - p.g // 4) <= 5 AND abs(s.b // 4 - p.b // 4) <= 5 GROUP BY p.img, p.x, p.y""",
)
_lin = lambda c: f"(CASE WHEN {c} <= 0.04045 * 255 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
_f = lambda t: f"(CASE WHEN {t} > 0.008856::DOUBLE THEN cbrt({t}) ELSE 7.787::DOUBLE * {t} + 16 / 116.0::DOUBLE END)"
_LAB = ", lin AS (SELECT img, x, y, " + ", ".join(f"{_lin(c)} AS {c}" for c in RGB) + " FROM px)" + f""", xyz AS (SELECT img, x, y, {_f('((0.4124::DOUBLE * r + 0.3576::DOUBLE * g + 0.1805::DOUBLE * b) / 0.95047::DOUBLE)')} AS fx,
  {_f('(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)')} AS fy, {_f('((0.0193::DOUBLE * r + 0.1192::DOUBLE * g + 0.9505::DOUBLE * b) / 1.08883::DOUBLE)')} AS fz FROM lin),
lab AS (SELECT img, x, y, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM xyz)"""
_T = selection._lab_of((150, 120, 90))
pixel_query(
    "select_color_range", lambda px: selection.color_range(px, (150, 120, 90), fuzziness=80),
    f"SELECT img, x, y, {rnd('k * k * (3 - 2 * k) * 255')} AS cover FROM k",
    _LAB + f", k AS (SELECT img, x, y, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - sqrt(pow(l - {d(_T[0])}, 2) + pow(a - {d(_T[1])}, 2) + pow(b - {d(_T[2])}, 2)) / 48)) AS k FROM lab)",
)


def _ramp(a: float, b: float, v: str = "l") -> str:
    t = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({v} - {d(a)}) / {d(b - a)}))"
    return f"({t} * {t} * (3 - 2 * {t}))"


_LIGHT = ", li AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l, 128 - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5 * b AS cb, 128 + 0.5 * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b AS cr FROM px)"
_s = 24 + 30 * 0.24
_SKIN = f"(1 - {_ramp(1.0, 1.8, 'sqrt(pow((cb - 105) / 28.6::DOUBLE, 2) + pow((cr - 152) / 23.4::DOUBLE, 2))')}) * {_ramp(25, 60)} * (1 - {_ramp(235, 252)})"
for _preset, _sql in {
    "shadows": f"1 - {_ramp(64 - _s * 0.5, 64 + _s)}", "highlights": _ramp(192 - _s, 192 + _s * 0.5), "midtones": f"{_ramp(64, 64 + _s * 1.5)} * (1 - {_ramp(192 - _s * 1.5, 192)})", "skin": _SKIN,
}.items():
    pixel_query(f"select_color_range_{_preset}", lambda px, p=_preset: selection.color_range(px, preset=p, fuzziness=30), f"SELECT img, x, y, {rnd(f'({_sql}) * 255')} AS cover FROM li", _LIGHT)
pixel_query(
    "select_bounds", lambda px: selection.bounds(px, selection.color_range(px, preset="highlights", fuzziness=0)),
    f"SELECT img, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM li WHERE {rnd(f'({_ramp(168, 204)}) * 255')} > 0 GROUP BY img", _LIGHT,
)
