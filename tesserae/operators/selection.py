"""Selections: rows (img, x, y, cover) with coverage 0..255; no selection at all means everything to tools.

Every operator keeps one row a place.  ``px`` are rasters (img, x, y, r, g, b[, a]), ``sel`` selections.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tone
from . import graph
from .filters import square
from .raster import combine, sized

RGB = ("r", "g", "b")


def _round(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + 0.5 + 1e-7))).cast("int")


def everything(px: DataFrame) -> DataFrame:
    return px.select("img", "x", "y", F.lit(255).alias("cover"))


def nothing(px: DataFrame) -> DataFrame:
    """An empty selection, which is not the same as none."""
    return px.select("img", "x", "y", F.lit(0).alias("cover"))


def cover_of(px: DataFrame, sel: DataFrame | None) -> DataFrame:
    """The raster's rows with their coverage, 255 where there is no selection."""
    if sel is None:
        return px.withColumn("cover", F.lit(255))
    return px.join(sel, ["img", "x", "y"], "left").withColumn("cover", F.coalesce("cover", F.lit(0)))


def invert(px: DataFrame, sel: DataFrame | None) -> DataFrame:
    return nothing(px) if sel is None else sel.withColumn("cover", 255 - F.col("cover"))


def merge(px: DataFrame, sel: DataFrame | None, new: DataFrame, mode: str = "replace") -> DataFrame:
    """``new`` put to a selection; without one, subtract begins with everything and the other modes give the new one."""
    if mode == "replace" or sel is None and mode != "subtract":
        return new
    old = (everything(px) if sel is None else sel).withColumnRenamed("cover", "_old")
    both = old.join(new, ["img", "x", "y"])
    return both.select("img", "x", "y", combine(mode, F.col("_old"), F.col("cover")).cast("int").alias("cover"))


def rect(px: DataFrame, x: float, y: float, width: float, height: float) -> DataFrame:
    """A rectangle whose edges are rounded to whole places, halves away from zero."""
    away = lambda v: math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)
    x0, y0 = away(x), away(y)
    inside = F.col("x").between(x0, x0 + away(width) - 1) & F.col("y").between(y0, y0 + away(height) - 1)
    return px.select("img", "x", "y", F.when(inside, 255).otherwise(0).alias("cover"))


#: Parts of a pixel's side at which the edge of a shape is sampled.
FINE = 4


def _sampled(px: DataFrame, inside, smooth: bool) -> DataFrame:
    """Coverage by FINE x FINE samples of a pixel, or by its middle alone."""
    at = [(k + 0.5) / FINE for k in range(FINE)] if smooth else [0.5]
    hits = sum((inside(F.col("x") + dx, F.col("y") + dy).cast("int") for dx in at for dy in at), F.lit(0))
    return px.select("img", "x", "y", _round(hits * 255.0 / len(at) ** 2).alias("cover"))


def ellipse(px: DataFrame, x: float, y: float, width: float, height: float, smooth: bool = True) -> DataFrame:
    """The ellipse in a rectangle; its edge is sampled, where the reference has exact area: within a sixteenth."""
    rx, ry = max(width, 0.5) / 2, max(height, 0.5) / 2
    return _sampled(px, lambda u, v: F.pow((u - x - rx) / rx, 2) + F.pow((v - y - ry) / ry, 2) <= 1, smooth)


def polygon(px: DataFrame, points, smooth: bool = True) -> DataFrame:
    """A closed polygon by winding number; fewer than three points select nothing."""
    if len(points) < 3:
        return nothing(px)

    def inside(u, v):
        turns = F.lit(0)
        for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]]):
            if y0 == y1:
                continue
            crossing = u < x0 + (v - y0) * ((x1 - x0) / (y1 - y0))
            up = F.when((v >= y0) & (v < y1) & crossing, 1) if y1 > y0 else F.when((v >= y1) & (v < y0) & crossing, -1)
            turns = turns + up.otherwise(0)
        return turns != 0

    return _sampled(px, inside, smooth)


def layer_alpha(px: DataFrame) -> DataFrame:
    return px.select("img", "x", "y", F.col("a").alias("cover"))


def _box(sel: DataFrame, reach: int) -> DataFrame:
    """Means over a square, edges repeated, as reals."""
    for line, along in (("y", "x"), ("x", "y")):
        place = Window.partitionBy("img", line).orderBy(along)
        whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.greatest(F.lit(0), reach - (F.row_number().over(place) - 1))
        after = F.greatest(F.lit(0), reach - (F.count("*").over(whole) - F.row_number().over(place)))
        total = F.sum("cover").over(place.rowsBetween(-reach, reach)) + F.first("cover").over(whole) * before + F.last("cover").over(whole) * after
        sel = sel.withColumn("cover", total / (2 * reach + 1))
    return sel


def feather(sel: DataFrame, radius: float) -> DataFrame:
    """Three box blurs whose reach is the radius over 1.7."""
    if radius <= 0:
        return sel
    reach = max(1, math.floor(radius / 1.7 + 0.5))
    for _ in range(3):
        sel = _box(sel, reach)
    return sel.withColumn("cover", _round(F.col("cover")))


def _nearest(sel: DataFrame, feature: Column, reach: int) -> DataFrame:
    """Adds _d2, the squared distance to the nearest place with the feature, null beyond ``reach``: least squares along columns, then rows."""
    rows = sel.withColumn("_d2", F.when(feature, 0))
    for line, along in (("x", "y"), ("y", "x")):
        place = Window.partitionBy("img", line).orderBy(along)
        at = [F.col("_d2")] + [f("_d2", k).over(place) + k * k for k in range(1, reach + 1) for f in (F.lag, F.lead)]
        rows = rows.withColumn("_d2", F.least(*at))
    return rows.withColumn("_d2", F.when(F.col("_d2") < (reach + 1) ** 2, F.col("_d2")))


def grow(sel: DataFrame, by: float) -> DataFrame:
    """Expanded by exact Euclidean distance from the places at least half selected, with a soft edge of a pixel."""
    rows = _nearest(sel, F.col("cover") >= 128, math.ceil(by) + 1)
    k = F.least(F.lit(1.0), F.greatest(F.lit(0.0), by + 1 - F.sqrt("_d2")))
    return rows.select("img", "x", "y", F.greatest("cover", F.coalesce(_round(k * 255), F.lit(0))).alias("cover"))


def shrink(sel: DataFrame, by: float) -> DataFrame:
    rows = _nearest(sel, F.col("cover") < 128, math.ceil(by) + 1)
    k = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sqrt("_d2") - by))
    return rows.select("img", "x", "y", F.least("cover", F.coalesce(_round(k * 255), F.lit(255))).alias("cover"))


def border(sel: DataFrame, width: float) -> DataFrame:
    """A band around the edge, softened by a blur of one pixel."""
    half = max(0.5, width / 2)
    inner = shrink(sel, half).withColumnRenamed("cover", "_in")
    band = grow(sel, half).join(inner, ["img", "x", "y"]).select("img", "x", "y", (F.col("cover") * (255 - F.col("_in")) / 255.0).alias("cover"))
    return _box(band, 1).withColumn("cover", _round(F.col("cover")))


def smooth(sel: DataFrame, radius: int) -> DataFrame:
    """Selected where more than half of the square around is, inside the canvas; the edge is a pixel soft."""
    rows = sel.withColumns({"_n": F.lit(1), "_s": (F.col("cover") >= 128).cast("int")})
    for line, along in (("y", "x"), ("x", "y")):
        near = Window.partitionBy("img", line).orderBy(along).rowsBetween(-radius, radius)
        rows = rows.withColumns({"_n": F.sum("_n").over(near), "_s": F.sum("_s").over(near)})
    v = (F.col("_s") / F.col("_n") - 0.5) * (2 * radius + 1) + 0.5
    return rows.select("img", "x", "y", _round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * 255).alias("cover"))


def _apart(seed) -> Column:
    """The largest difference of a channel from the seed's."""
    return F.greatest(*[F.abs(F.col(c) - F.col(s)) for c, s in zip(RGB, seed)])


def _soft(sel: DataFrame) -> DataFrame:
    """A hard selection whose boundary places take a tent average of the square around them."""
    rows, at = square(sel, ["cover"], 1)
    cross = [at[("cover", dx, dy)] for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    corners = [at[("cover", dx, dy)] for dx in (-1, 1) for dy in (-1, 1)]
    flat = (cross[0] == F.col("cover")) & (cross[1] == F.col("cover")) & (cross[2] == F.col("cover")) & (cross[3] == F.col("cover"))
    tent = F.floor((4 * F.col("cover") + 2 * sum(cross[1:], cross[0]) + sum(corners[1:], corners[0]) + 8) / 16)
    return rows.select("img", "x", "y", F.when(flat, F.col("cover")).otherwise(tent).cast("int").alias("cover"))


def magic_wand(px: DataFrame, x: int, y: int, tolerance: int, contiguous: bool = False, smooth: bool = False, keep=graph.kept) -> DataFrame:
    """Places whose colour is within the tolerance of the seed's; ``contiguous`` ones only if reached over their sides.

    The flood is done on runs: matching places of a row that touch are one
    node, and nodes of neighbouring rows that overlap are joined.  Nodes are
    numbered from the top, so the rounds of their components number about the
    logarithm of the height, more where the region winds.  ``keep`` stores a
    round's table and cuts its lineage.
    """
    seed = px.where((F.col("x") == x) & (F.col("y") == y)).select("img", *[F.col(c).alias(f"_{c}") for c in RGB])
    match = _apart([f"_{c}" for c in RGB]) <= tolerance
    # One row an image.
    rows = px.join(F.broadcast(seed), "img").select("img", "x", "y", F.when(match, 255).otherwise(0).alias("cover"))
    if contiguous:
        line = Window.partitionBy("img", "y").orderBy("x")
        hit = rows.where("cover > 0").withColumn("_run", F.col("x") - F.row_number().over(line))
        runs = hit.groupBy("img", "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        runs = runs.repartitionByRange("img", "y", "x0").sortWithinPartitions("img", "y", "x0")
        runs = keep(runs.withColumn("node", F.monotonically_increasing_id()))
        below = runs.select("img", (F.col("y") - 1).alias("y"), F.col("x0").alias("_l"), F.col("x1").alias("_r"), F.col("node").alias("v"))
        edges = runs.join(below, ["img", "y"]).where("x0 <= _r AND x1 >= _l").select(F.col("node").alias("u"), "v")
        runs = runs.join(graph.components(edges, keep), "node", "left").withColumn("part", F.coalesce("component", "node"))
        # One row an image.
        first = runs.where((F.col("y") == y) & F.lit(x).between(F.col("x0"), F.col("x1"))).select("part")
        reached = runs.join(F.broadcast(first), "part", "left_semi").select("img", "y", "_run")
        lit = hit.join(reached, ["img", "y", "_run"], "left_semi").select("img", "x", "y", F.lit(255).alias("_on"))
        rows = rows.drop("cover").join(lit, ["img", "x", "y"], "left").select("img", "x", "y", F.coalesce("_on", F.lit(0)).alias("cover"))
    return _soft(rows) if smooth else rows


def similar(px: DataFrame, sel: DataFrame, tolerance: int) -> DataFrame:
    """Every place whose colour cell (4 levels a side) is near one that is at least half selected, and the selection itself.

    Cells, not places, are joined: at most 64 cubed an image.
    """
    cells = [F.floor(F.col(c) / 4).cast("int").alias(f"c{c}") for c in RGB]
    both = px.join(sel, ["img", "x", "y"]).select("img", "x", "y", "cover", *cells)
    reach = -(-tolerance // 4)
    held = both.where("cover >= 128").select("img", "cr", "cg", "cb").distinct()
    for c in ("cr", "cg", "cb"):
        spread = F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))
        held = held.withColumn(c, spread).distinct()
    hit = both.join(held.withColumn("_hit", F.lit(255)), ["img", "cr", "cg", "cb"], "left")
    return hit.select("img", "x", "y", F.greatest("cover", F.coalesce("_hit", F.lit(0))).alias("cover"))


def lab(c) -> list[Column]:
    """CIE L*a*b* of linear channels, by the coefficients that colour ranges use."""
    r, g, b = c
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    fx, fy, fz = f((0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047), f(0.2126 * r + 0.7152 * g + 0.0722 * b), f((0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883)
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]


def _lab_of(color) -> list[float]:
    lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in color]
    f = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    r, g, b = lin
    fx, fy, fz = f((0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047), f(0.2126 * r + 0.7152 * g + 0.0722 * b), f((0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883)
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]


def color_range(px: DataFrame, color=None, preset: str | None = None, fuzziness: float = 40.0) -> DataFrame:
    """Coverage by distance from a colour in Lab, or by a preset of tones (highlights, midtones, shadows, skin)."""
    alpha = F.col("a") if "a" in px.columns else F.lit(255)
    fuzziness = min(200.0, max(0.0, fuzziness))
    r, g, b = [F.col(c) for c in RGB]
    light = 0.299 * r + 0.587 * g + 0.114 * b
    ramp, soft = tone.smoothstep, 24 + fuzziness * 0.24
    if preset is None:
        px = px.withColumns({f"_l{c}": tone.to_linear(F.col(c) / 255.0) for c in RGB})
        px = px.withColumns(dict(zip(("_L", "_A", "_B"), lab([F.col(f"_l{c}") for c in RGB]))))
        far = F.sqrt(sum((F.pow(F.col(c) - t, 2) for c, t in zip(("_L", "_A", "_B"), _lab_of(color))), F.lit(0.0)))
        px = px.withColumn("_k", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - far / max(0.5, fuzziness * 0.6))))
        score = F.col("_k") * F.col("_k") * (3 - 2 * F.col("_k"))
    elif preset == "shadows":
        score = 1 - ramp(64 - soft * 0.5, 64 + soft, light)
    elif preset == "highlights":
        score = ramp(192 - soft, 192 + soft * 0.5, light)
    elif preset == "midtones":
        score = ramp(64, 64 + soft * 1.5, light) * (1 - ramp(192 - soft * 1.5, 192, light))
    else:
        wide = 1 + fuzziness / 100
        cb, cr = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
        far = F.sqrt(F.pow((cb - 105) / (22 * wide), 2) + F.pow((cr - 152) / (18 * wide), 2))
        score = (1 - ramp(1.0, 1.8, far)) * ramp(25, 60, light) * (1 - ramp(235, 252, light))
    return px.select("img", "x", "y", _round(score * alpha).alias("cover"))


def bounds(px: DataFrame, sel: DataFrame | None) -> DataFrame:
    """(img, x0, y0, x1, y1) of what is selected; of the whole canvas where there is no selection."""
    if sel is None:
        return sized(px).select("img", F.lit(0).alias("x0"), F.lit(0).alias("y0"), (F.col("w") - 1).alias("x1"), (F.col("h") - 1).alias("y1"))
    return sel.where("cover > 0").groupBy("img").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
