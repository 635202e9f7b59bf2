"""Geometry, neighbourhood filters, selections and statistics on rows of pixels (img, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHANNELS = ("r", "g", "b")


def unit(px: DataFrame, prefix: str = "") -> list[Column]:
    return [px[prefix + c] / F.lit(255.0) for c in CHANNELS]


def crop(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = px.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def flip(px: DataFrame, width: int) -> DataFrame:
    return px.withColumn("x", width - 1 - F.col("x"))


def sized(px: DataFrame) -> DataFrame:
    """Images with their width and height."""
    return px.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def rotate(px: DataFrame) -> DataFrame:
    """A quarter turn clockwise."""
    rows = px.join(sized(px), "img")
    return rows.select("img", (F.col("h") - 1 - F.col("y")).alias("x"), F.col("x").alias("y"), *CHANNELS)


def trim(px: DataFrame) -> DataFrame:
    """Images cropped to the bounds of what is not transparent; one that is all transparent gives no rows."""
    box = px.where("a <> 0").groupBy("img").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    # One row an image.
    rows = px.join(F.broadcast(box), "img").where(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")))
    return rows.withColumns({"x": F.col("x") - F.col("_x0"), "y": F.col("y") - F.col("_y0")}).drop("_x0", "_y0", "_x1", "_y1")


def pixelate(px: DataFrame, cell: int) -> DataFrame:
    cells = px.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    means = cells.groupBy("img", "cx", "cy").agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in CHANNELS])
    return cells.drop(*CHANNELS).join(means, ["img", "cx", "cy"]).select("img", "x", "y", *CHANNELS)


def _pass(px: DataFrame, line: str, along: str, last: str, radius: int) -> DataFrame:
    """Sums over 2 * radius + 1 pixels of a line, its ends repeated beyond the edge."""
    place = Window.partitionBy("img", line).orderBy(along)
    near, whole = place.rowsBetween(-radius, radius), place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(0), radius - F.col(along))
    after = F.greatest(F.lit(0), radius - (F.col(last) - F.col(along)))
    total = lambda c: F.sum(c).over(near) + F.first(c).over(whole) * before + F.last(c).over(whole) * after
    return px.withColumns({c: total(c) for c in CHANNELS})


def box_blur(px: DataFrame, radius: int) -> DataFrame:
    """Mean over a square, rounded half up, edges repeated: two one-dimensional passes."""
    ends = sized(px).select("img", (F.col("w") - 1).alias("xl"), (F.col("h") - 1).alias("yl"))
    rows = _pass(_pass(px.join(ends, "img"), "y", "x", "xl", radius), "x", "y", "yl", radius)
    n = (2 * radius + 1) ** 2
    return rows.select("img", "x", "y", *[F.floor(F.col(c) / n + 0.5).cast("int").alias(c) for c in CHANNELS])


def extreme(px: DataFrame, radius: int, largest: bool) -> DataFrame:
    """Maximum or minimum over a square."""
    pick = F.max if largest else F.min
    for line, along in (("y", "x"), ("x", "y")):
        near = Window.partitionBy("img", line).orderBy(along).rowsBetween(-radius, radius)
        px = px.withColumns({c: pick(c).over(near) for c in CHANNELS})
    return px


def rectangle(x: int, y: int, width: int, height: int) -> Column:
    """Coverage 0 or 255 of a rectangle."""
    return F.when(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1), 255).otherwise(0)


def combine(mode: str, old: Column, new: Column) -> Column:
    """Coverage of two selections together."""
    if mode == "add":
        return F.greatest(old, new)
    if mode == "subtract":
        return F.floor(old * (255 - new) / 255).cast("int")
    if mode == "intersect":
        return F.least(old, new)
    return new


def masked(before: Column, after: Column, cover: Column) -> Column:
    """The destructive edit of an opaque pixel through coverage, in integers: nearest, halves up."""
    return F.floor((before * (255 - cover) + after * cover + 127) / 255).cast("int")


def histogram(px: DataFrame) -> DataFrame:
    """(img, channel, level, n) of r, g, b and the rounded luma l, in one pass."""
    luma = F.floor(0.3 * F.col("r") + 0.59 * F.col("g") + 0.11 * F.col("b") + 0.5).cast("int").alias("l")
    four = px.select("img", *CHANNELS, luma).unpivot("img", [*CHANNELS, "l"], "channel", "level")
    return four.groupBy("img", "channel", "level").agg(F.count("*").alias("n"))


def pick(px: DataFrame, x: int, y: int, size: int) -> DataFrame:
    """Mean colour of a square around a point."""
    r = size // 2
    near = px.where(F.col("x").between(x - r, x + r) & F.col("y").between(y - r, y + r)).groupBy("img")
    return near.agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in CHANNELS])


def clip_points(px: DataFrame, share: float) -> DataFrame:
    """For each image and channel the levels that cut ``share`` of the pixels off either end."""
    h = histogram(px).where("channel <> 'l'")
    up = Window.partitionBy("img", "channel").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img", "channel")
    h = h.withColumns({"below": F.sum("n").over(up), "all": F.sum("n").over(whole)})
    low = F.min(F.when(F.col("below") > share * F.col("all"), F.col("level")))
    high = F.max(F.when(F.col("below") - F.col("n") < (1 - share) * F.col("all"), F.col("level")))
    return h.groupBy("img", "channel").agg(low.alias("low"), high.alias("high"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute error of two images over their common pixels, and the number of pixels that differ by over 2 in a channel."""
    both = a.alias("a").join(b.alias("b"), ["img", "x", "y"])
    apart = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in CHANNELS]
    rows = both.select("img", sum(apart[1:], apart[0]).alias("d"), F.greatest(*apart).alias("m"))
    return rows.groupBy("img").agg(F.round(F.sum("d") / (F.count("*") * 3), 6).alias("mae"), F.count_if(F.col("m") > 2).alias("differ"))
