"""Registered queries of the raster and catalogue operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blend
from ..operators import library, raster
from ..sources.adapters import PX_SQL, SIDE, pixels, translucent
from . import culling, editing, filters, relational, selections, stacks, tones  # noqa: F401, they register their queries
from .common import ORACLES, QUERIES, RGB
from .common import item_query as _item_query
from .common import pixel_query as _pixel_query


def _two(px: DataFrame) -> DataFrame:
    """Each pixel with the one mirrored left to right as a second layer's."""
    over = raster.flip(px, SIDE).select("img", "x", "y", *[F.col(c).alias(f"s_{c}") for c in RGB])
    return px.join(over, ["img", "x", "y"])


TWO_SQL = """, two AS (
  SELECT a.*, s.r AS s_r, s.g AS s_g, s.b AS s_b FROM px a JOIN px s ON a.img = s.img AND a.y = s.y AND a.x = 63 - s.x)"""


def _quantised(px: DataFrame, channels) -> DataFrame:
    return px.select("img", "x", "y", *[blend.quantise(v).alias(c) for v, c in zip(channels, RGB)])


def _q(expression: str) -> str:
    return f"floor(least(1, greatest(0, {expression})) * 255 + 0.5000001::DOUBLE)::INT"


def _blend(mode: str):
    def run(px: DataFrame) -> DataFrame:
        both = _two(px)
        return _quantised(both, blend.blend(mode, raster.unit(both), raster.unit(both, "s_")))

    return run


for _mode, _sql in blend.SQL.items():
    _columns = ", ".join(f"{_q(_sql.format(b=f'({c} / 255.0::DOUBLE)', s=f'(s_{c} / 255.0::DOUBLE)'))} AS {c}" for c in RGB)
    _pixel_query(f"blend_{_mode.replace('-', '_')}", _blend(_mode), f"SELECT img, x, y, {_columns} FROM two", TWO_SQL)

_LUM = "(0.3::DOUBLE * ({0}r / 255.0::DOUBLE) + 0.59::DOUBLE * ({0}g / 255.0::DOUBLE) + 0.11::DOUBLE * ({0}b / 255.0::DOUBLE))"
for _mode, _sign in (("darker-color", "<"), ("lighter-color", ">")):
    _columns = ", ".join(f"CASE WHEN {_LUM.format('s_')} {_sign} {_LUM.format('')} THEN s_{c} ELSE {c} END AS {c}" for c in RGB)
    _pixel_query(f"blend_{_mode.replace('-', '_')}", _blend(_mode), f"SELECT img, x, y, {_columns} FROM two", TWO_SQL)


def _whole_sql(mode: str) -> str:
    """The four modes that exchange luminosity and saturation, step by step: the colour to take (c), the luminosity to give it, then back into 0..1."""
    b, t = [f"({c} / 255.0::DOUBLE)" for c in RGB], [f"(s_{c} / 255.0::DOUBLE)" for c in RGB]
    lum = lambda v: f"(0.3::DOUBLE * {v[0]} + 0.59::DOUBLE * {v[1]} + 0.11::DOUBLE * {v[2]})"
    span = lambda v: f"(greatest({', '.join(v)}) - least({', '.join(v)}))"
    given = lambda v, n: [f"CASE WHEN {span(v)} > 0 THEN ({x} - least({', '.join(v)})) * {n} / {span(v)} ELSE 0.0::DOUBLE END" for x in v]
    c, light = {"hue": (given(t, span(b)), lum(b)), "saturation": (given(b, span(t)), lum(b)), "color": (t, lum(b)), "luminosity": (b, lum(t))}[mode]
    steps = ", c0 AS (SELECT img, x, y, " + ", ".join(f"{e} AS {n}" for e, n in zip(c, RGB)) + f", {light} AS to_l FROM two)"
    steps += f", c1 AS (SELECT img, x, y, to_l, " + ", ".join(f"{n} + to_l - {lum(RGB)} AS {n}" for n in RGB) + " FROM c0)"
    steps += f", c2 AS (SELECT *, {lum(RGB)} AS g0, least(r, g, b) AS lo, greatest(r, g, b) AS hi FROM c1)"
    steps += ", c3 AS (SELECT img, x, y, g0, hi, " + ", ".join(f"CASE WHEN lo < 0 THEN g0 + ({n} - g0) * g0 / (g0 - lo) ELSE {n} END AS {n}" for n in RGB) + " FROM c2)"
    return TWO_SQL + steps + ", c4 AS (SELECT img, x, y, " + ", ".join(f"CASE WHEN hi > 1 THEN g0 + ({n} - g0) * (1 - g0) / (hi - g0) ELSE {n} END AS {n}" for n in RGB) + " FROM c3)"


for _mode in ("hue", "saturation", "color", "luminosity"):
    _pixel_query(f"blend_{_mode}", _blend(_mode), "SELECT img, x, y, " + ", ".join(f"{_q(c)} AS {c}" for c in RGB) + " FROM c4", _whole_sql(_mode))

_pixel_query("image_crop", lambda px: raster.crop(px, 8, 4, 40, 30), "SELECT img, x - 8 AS x, y - 4 AS y, r, g, b FROM px WHERE x >= 8 AND x < 48 AND y >= 4 AND y < 34")
_pixel_query("image_flip", lambda px: raster.flip(px, SIDE), "SELECT img, 63 - x AS x, y, r, g, b FROM px")
_pixel_query(
    "image_rotate", raster.rotate,
    "SELECT img, (SELECT max(y) FROM px q WHERE q.img = px.img) - y AS x, x AS y, r, g, b FROM px",
)
QUERIES["image_trim"] = lambda spark, sf_dir: raster.trim(translucent(pixels(spark, sf_dir)).withColumn("a", F.when(F.col("x").between(9, 50) & (F.col("y") > 4), F.col("a")).otherwise(0)))
ORACLES["image_trim"] = f"""WITH {PX_SQL}{filters.ALPHA}, pb AS (SELECT * EXCLUDE (a), CASE WHEN x BETWEEN 9 AND 50 AND y > 4 THEN a ELSE 0 END AS a FROM pa),
  bd AS (SELECT img, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pb WHERE a <> 0 GROUP BY img)
  SELECT img, x - x0 AS x, y - y0 AS y, r, g, b, a FROM pb JOIN bd USING (img) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"""
_pixel_query(
    "filter_pixelate", lambda px: raster.pixelate(px, 8),
    "SELECT img, x, y, " + ", ".join(f"floor(avg({c}) OVER w + 0.5)::INT AS {c}" for c in RGB) + " FROM px WINDOW w AS (PARTITION BY img, x // 8, y // 8)",
)
_NEAR = """, ends AS (SELECT img, max(y) AS yl FROM px GROUP BY img),
near AS (
  SELECT p.img, p.x, p.y, q.r, q.g, q.b FROM px p JOIN ends USING (img),
    (SELECT unnest(range(-2, 3)) AS dx) i, (SELECT unnest(range(-2, 3)) AS dy) j, px q
  WHERE q.img = p.img AND q.x = least(63, greatest(0, p.x + dx)) AND q.y = least(yl, greatest(0, p.y + dy)))"""
_pixel_query(
    "filter_box_blur", lambda px: raster.box_blur(px, 2),
    "SELECT img, x, y, " + ", ".join(f"floor(sum({c}) / 25.0::DOUBLE + 0.5)::INT AS {c}" for c in RGB) + " FROM near GROUP BY img, x, y", _NEAR,
)
for _name, _large in (("maximum", True), ("minimum", False)):
    _f = "max" if _large else "min"
    _pixel_query(
        f"filter_{_name}", lambda px, large=_large: raster.extreme(px, 2, large),
        "SELECT img, x, y, " + ", ".join(f"{_f}({c}) AS {c}" for c in RGB) + " FROM near GROUP BY img, x, y", _NEAR,
    )


def _old():
    return raster.rectangle(4, 4, 30, 20)


def _new():
    return raster.rectangle(20, 10, 30, 30)


_OLD_SQL = "CASE WHEN x BETWEEN 4 AND 33 AND y BETWEEN 4 AND 23 THEN 255 ELSE 0 END"
_NEW_SQL = "CASE WHEN x BETWEEN 20 AND 49 AND y BETWEEN 10 AND 39 THEN 255 ELSE 0 END"
for _mode, _sql in {
    "replace": _NEW_SQL, "add": f"greatest({_OLD_SQL}, {_NEW_SQL})", "intersect": f"least({_OLD_SQL}, {_NEW_SQL})",
    "subtract": f"({_OLD_SQL}) * (255 - ({_NEW_SQL})) // 255",
}.items():
    _pixel_query(
        f"select_{_mode}", lambda px, mode=_mode: px.select("img", "x", "y", raster.combine(mode, _old(), _new()).cast("int").alias("cover")),
        f"SELECT img, x, y, ({_sql})::INT AS cover FROM px",
    )
_pixel_query(
    "layer_fill_selection", lambda px: px.select("img", "x", "y", *[raster.masked(F.col(c), F.lit(v), _new()).alias(c) for c, v in zip(RGB, (250, 20, 90))]),
    "SELECT img, x, y, " + ", ".join(f"({c} * (255 - ({_NEW_SQL})) + {v} * ({_NEW_SQL}) + 127) // 255 AS {c}" for c, v in zip(RGB, (250, 20, 90))) + " FROM px",
)

_HIST = """, l AS (SELECT *, floor(0.3::DOUBLE * r + 0.59::DOUBLE * g + 0.11::DOUBLE * b + 0.5)::INT AS l FROM {0}),
h AS (SELECT img, channel, level, count(*) AS n FROM (
  SELECT img, 'r' AS channel, r AS level FROM l UNION ALL SELECT img, 'g', g FROM l UNION ALL SELECT img, 'b', b FROM l
  UNION ALL SELECT img, 'l', l FROM l) GROUP BY ALL)"""
_pixel_query("analyze_histogram", raster.histogram, "SELECT * FROM h", _HIST.format("px"))
_pixel_query(
    "analyze_pick", lambda px: raster.pick(px, 10, 12, 5),
    "SELECT img, " + ", ".join(f"floor(avg({c}) + 0.5)::INT AS {c}" for c in RGB) + " FROM px WHERE x BETWEEN 8 AND 12 AND y BETWEEN 10 AND 14 GROUP BY img",
)
_pixel_query(
    "analyze_auto_levels", lambda px: raster.clip_points(px, 0.01),
    """SELECT img, channel, min(level) FILTER (below > 0.01::DOUBLE * total) AS low,
         max(level) FILTER (below - n < (1 - 0.01::DOUBLE) * total) AS high
       FROM (SELECT *, sum(n) OVER (PARTITION BY img, channel ORDER BY level) AS below, sum(n) OVER (PARTITION BY img, channel) AS total
             FROM h WHERE channel <> 'l') GROUP BY img, channel""",
    _HIST.format("px"),
)
_pixel_query(
    "compare_images", lambda px: raster.compare(px, raster.flip(px, SIDE)),
    """SELECT img, round(sum(abs(r - s_r) + abs(g - s_g) + abs(b - s_b)) / (count(*) * 3.0::DOUBLE), 6) AS mae,
         count(*) FILTER (greatest(abs(r - s_r), abs(g - s_g), abs(b - s_b)) > 2) AS differ FROM two GROUP BY img""", TWO_SQL,
)


def composite(px: DataFrame) -> DataFrame:
    """A base with its levels stretched, multiplied by a second layer at half opacity inside a mask."""
    both = _two(px)
    base = [blend._unit((v - 0.1) / (0.9 - 0.1)) for v in raster.unit(both)]
    over = blend.blend("multiply", base, raster.unit(both, "s_"))
    k = F.when(_new() > 0, 0.5).otherwise(0.0)
    return _quantised(both, [b * (1 - k) + o * k for b, o in zip(base, over)])


def _layered(c: str) -> str:
    base = f"least(1, greatest(0, (({c} / 255.0::DOUBLE) - 0.1::DOUBLE) / (0.9::DOUBLE - 0.1::DOUBLE)))"
    k = f"(CASE WHEN ({_NEW_SQL}) > 0 THEN 0.5::DOUBLE ELSE 0 END)"
    return f"{_q(f'{base} * (1 - {k}) + {base} * (s_{c} / 255.0::DOUBLE) * {k}')} AS {c}"


_pixel_query(
    "composite_histogram", lambda px: raster.histogram(composite(px)), "SELECT * FROM h",
    TWO_SQL + f", c AS (SELECT img, x, y, {', '.join(map(_layered, RGB))} FROM two)" + _HIST.format("c"),
)

_item_query(
    "library_view", lambda i: library.view(i, 3, ["click", "view", "purchase"], "not-rejected").select("path", "kind", "rating", "flag"),
    "SELECT path, kind, rating, flag FROM items WHERE rating >= 3 AND kind IN ('click', 'view', 'purchase') AND flag <> -1",
)
_item_query(
    "library_bursts", lambda i: library.bursts(i, 3600),
    """SELECT path, camera, burst, count(*) OVER (PARTITION BY camera, burst) AS size,
         row_number() OVER (PARTITION BY camera, burst ORDER BY sharpness DESC, path) = 1 AS best FROM b""",
    """, g AS (SELECT *, coalesce(epoch_us(capture) - lag(epoch_us(capture)) OVER (PARTITION BY camera ORDER BY capture, path) > 3600000000, true) AS new FROM items),
    b AS (SELECT *, sum(new::INT) OVER (PARTITION BY camera ORDER BY capture, path ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM g)""",
)
_item_query(
    "library_names", library.named,
    "SELECT path, stem || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS name FROM (SELECT path, stem, row_number() OVER (PARTITION BY stem ORDER BY path) AS k FROM s)",
    ", s AS (SELECT path, lower(kind) || '_' || strftime(capture, '%Y%m%d') || '_' || rating AS stem FROM items)",
)
_item_query(
    "edit_undo_steps",
    lambda i: library.undo_steps(i.select(F.col("camera").alias("actor"), F.col("capture").alias("at"), F.col("path").alias("seq"), F.col("kind").alias("key")), 7200),
    'SELECT actor, step, min(path) AS "first", max(path) AS "last", count(*) AS n FROM b GROUP BY actor, step',
    """, g AS (SELECT camera AS actor, path, coalesce(lag(kind) OVER w <> kind OR epoch_us(capture) - lag(epoch_us(capture)) OVER w > 7200000000, true) AS new,
      capture FROM items WINDOW w AS (PARTITION BY camera ORDER BY capture, path)),
    b AS (SELECT *, sum(new::INT) OVER (PARTITION BY actor ORDER BY capture, path ROWS UNBOUNDED PRECEDING)::BIGINT AS step FROM g)""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["composite_histogram"](spark, sf_dir)
