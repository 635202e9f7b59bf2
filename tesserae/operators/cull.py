"""Signals of images, near-duplicate groups and judgements for culling.

Images are rows of pixels (img, x, y, r, g, b); a catalogue's signals are rows
(path, camera, sharpness, mean, clip_low, clip_high, dhash, phash, faces,
eyes_closed, capture), hashes as 64-bit integers.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .raster import sized

#: Absolute and relative limits of sharpness, and the one inside a group of duplicates.
BLUR, BLUR_RELATIVE, BLUR_GROUP = 6.0, 0.3, 0.4


def luminance(px: DataFrame) -> DataFrame:
    """(img, x, y, lum): Rec. 709 luma as a level."""
    return px.select("img", "x", "y", F.floor(0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b") + (0.5 + 1e-9)).cast("int").alias("lum"))


def resample(lum: DataFrame, width: int, height: int) -> DataFrame:
    """(img, x, y, v): means of blocks; a block has one pixel at least, so small images repeat theirs."""
    ends = F.broadcast(sized(lum))
    rows = lum.join(ends, "img")

    def cells(at, size, n):
        # Blocks [floor(k * size / n), max(that + 1, floor((k + 1) * size / n))) that hold the place.
        every = F.sequence((F.floor(at * n / size) - 1).cast("int"), F.ceil((at + 1) * n / size).cast("int"))
        first = lambda k: F.floor(k * size / n)
        return F.filter(every, lambda k: (k >= 0) & (k < n) & (first(k) <= at) & (at < F.greatest(first(k) + 1, F.least(size, first(k + 1)))))

    rows = rows.withColumn("cx", F.explode(cells(F.col("x"), F.col("w"), width))).withColumn("cy", F.explode(cells(F.col("y"), F.col("h"), height)))
    return rows.groupBy("img", F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.avg("lum").alias("v"))


def sharpness(lum: DataFrame, grid: int = 4) -> DataFrame:
    """(img, sharpness): Laplacian variance of the three sharpest of a grid's tiles, over the image's own variance, in percent."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    near = lum.withColumns({"_l": F.lag("lum").over(row), "_r": F.lead("lum").over(row)})
    near = near.withColumns({"_u": F.lag("lum").over(column), "_d": F.lead("lum").over(column)}).join(F.broadcast(sized(lum)), "img")
    inner = near.where("_l IS NOT NULL AND _r IS NOT NULL AND _u IS NOT NULL AND _d IS NOT NULL AND w >= 8 AND h >= 8")
    tile = lambda at, size: F.least(F.lit(grid - 1), F.floor((F.col(at) - 1) / ((F.col(size) - 2) / grid)))
    inner = inner.select("img", (tile("y", "h") * grid + tile("x", "w")).alias("tile"), (F.col("_l") + F.col("_r") + F.col("_u") + F.col("_d") - 4 * F.col("lum")).alias("q"))
    tiles = inner.groupBy("img", "tile").agg((F.avg(F.col("q") * F.col("q")) - F.avg("q") * F.avg("q")).alias("v"))
    # At most grid squared rows an image.
    best = tiles.withColumn("k", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("v"), "tile"))).where("k <= 3").groupBy("img").agg(F.avg("v").alias("v"))
    own = lum.groupBy("img").agg(F.greatest(F.lit(25.0), F.avg(F.col("lum") * F.col("lum")) - F.avg("lum") * F.avg("lum")).alias("contrast"))
    return own.join(best, "img", "left").select("img", F.coalesce(F.col("v") / F.col("contrast") * 100, F.lit(0.0)).alias("sharpness"))


def exposure(lum: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return lum.groupBy("img").agg((F.avg("lum") / 255).alias("mean"), share(F.col("lum") <= 4).alias("clip_low"), share(F.col("lum") >= 251).alias("clip_high"))


def exposure_badge(mean: Column, low: Column, high: Column) -> Column:
    over = (mean > 0.86) | ((high > 0.12) & (mean > 0.5))
    return F.when(over, "over").when((mean < 0.09) | ((low > 0.25) & (mean < 0.25)), "under")


def _packed(bit: Column, place: Column) -> Column:
    """64 bits, the first one the highest, as a long."""
    return F.bit_or(F.when(bit, F.expr("shiftleft(1L, 63 - CAST(_at AS INT))")).otherwise(F.lit(0).cast("long")))


def d_hash(lum: DataFrame) -> DataFrame:
    """(img, dhash): of 9 by 8 block means, whether each is brighter than the next in its row."""
    small = resample(lum, 9, 8).withColumn("_next", F.lead("v").over(Window.partitionBy("img", "y").orderBy("x")))
    small = small.where("x < 8").withColumn("_at", F.col("y") * 8 + F.col("x"))
    return small.groupBy("img").agg(_packed(F.col("v") > F.col("_next"), F.col("_at")).alias("dhash"))


def p_hash(lum: DataFrame) -> DataFrame:
    """(img, phash): of the low 8 by 8 cosine coefficients of 32 by 32 block means, which lie above the median of all but the first."""
    small = resample(lum, 32, 32)
    wave = lambda at, u: F.cos((2 * F.col(at) + 1) * F.col(u) * math.pi / 64)
    # Eight numbers.
    eight = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = small.withColumn("u", eight).groupBy("img", "y", "u").agg(F.sum(F.col("v") * wave("x", "u")).alias("v"))
    coef = rows.withColumn("t", eight).groupBy("img", "t", "u").agg(F.sum(F.col("v") * wave("y", "t")).alias("v"))
    rank = coef.where("t > 0 OR u > 0").withColumn("k", F.row_number().over(Window.partitionBy("img").orderBy("v")))
    middle = rank.where("k IN (32, 33)").groupBy("img").agg(F.avg("v").alias("_mid"))
    coef = coef.join(middle, "img").withColumn("_at", F.col("t") * 8 + F.col("u"))
    return coef.groupBy("img").agg(_packed(F.col("v") > F.col("_mid"), F.col("_at")).alias("phash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def measure(px: DataFrame) -> DataFrame:
    """All signals of each image."""
    lum = luminance(px)
    out = sharpness(lum)
    for part in (exposure(lum), d_hash(lum), p_hash(lum)):
        out = out.join(part, "img")
    return out


def _flips(reach: int) -> list[int]:
    """Masks of 16 bits with at most ``reach`` set."""
    return [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(16), n)]


def duplicates(items: DataFrame, d_max: int = 12, p_max: int = 14, window: int = 300_000, keep=graph.kept) -> DataFrame:
    """(path, group): near-duplicates by hash distance and capture time (milliseconds); those without a partner are left out.

    Items further apart in time than ``window`` must be twice as alike; a
    missing time counts as near.  Groups are named by their least path.

    Equal hashes are one node.  Of two 64-bit hashes within ``d_max`` bits one
    of four 16-bit quarters differs in d_max / 4 bits at most: one side lists
    its quarters with so many bits flipped, the other its quarters, and an
    equi-join finds the candidates.
    """
    nodes = items.groupBy("dhash", "phash").agg(F.min("path").alias("node"), F.max(F.col("capture").isNull()).alias("untimed"))
    quarters = F.array(*[F.struct(F.lit(k).alias("q"), F.shiftrightunsigned("dhash", 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("v")) for k in range(4)])
    probe = nodes.select("*", F.explode(quarters).alias("_k")).select("node", "dhash", "phash", "untimed", "_k.q", "_k.v")
    flips = F.array(*[F.lit(m).cast("long") for m in _flips(d_max // 4)])
    a = probe.select(F.col("node").alias("a"), F.col("dhash").alias("ad"), F.col("phash").alias("ap"), F.col("untimed").alias("au"), "q", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("v")))).alias("v"))
    b = probe.select(F.col("node").alias("b"), F.col("dhash").alias("bd"), F.col("phash").alias("bp"), F.col("untimed").alias("bu"), "q", "v")
    pairs = a.join(b, ["q", "v"]).where("a < b").withColumns({"d": hamming(F.col("ad"), F.col("bd")), "p": hamming(F.col("ap"), F.col("bp"))})
    pairs = keep(pairs.where((F.col("d") <= d_max) & (F.col("p") <= p_max)).select("a", "b", "ad", "ap", "bd", "bp", "d", "p", (F.col("au") | F.col("bu")).alias("free")).distinct())
    alike = pairs.where(F.col("free") | ((F.col("d") * 2 <= d_max) & (F.col("p") * 2 <= p_max)))
    # The others need two captures near each other: those of the same or a neighbouring slot of the window's length.
    rest = pairs.join(alike.select("a", "b"), ["a", "b"], "left_anti")
    times = items.where("capture IS NOT NULL").select("dhash", "phash", "capture", F.floor(F.col("capture") / max(1, window)).alias("slot")).distinct()
    left = rest.join(times.toDF("ad", "ap", "at", "slot"), ["ad", "ap"]).withColumn("slot", F.explode(F.sequence(F.col("slot") - 1, F.col("slot") + 1)))
    right = times.toDF("bd", "bp", "bt", "slot")
    near = left.join(right, ["bd", "bp", "slot"]).where(F.abs(F.col("at") - F.col("bt")) <= window).select("a", "b").distinct()
    edges = alike.select("a", "b").unionByName(near).toDF("u", "v")
    part = graph.components(edges, keep)
    named = items.join(nodes.select("dhash", "phash", "node"), ["dhash", "phash"]).join(part, "node", "left").withColumn("group", F.coalesce("component", "node"))
    many = named.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return named.join(many, "group").select("path", "group")


def judge(items: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Score, badges and the best of each group of duplicates (path, group).

    Sharpness is compared with the median of the camera where it has three
    items, else with that of all; items without a camera are one camera.
    """
    items = items.withColumn("camera", F.coalesce(F.col("camera").cast("string"), F.lit("")))
    cameras = items.groupBy("camera").agg(F.median("sharpness").alias("_own"), F.count("*").alias("_n"))
    rows = items.join(cameras, "camera").crossJoin(F.broadcast(items.agg(F.median("sharpness").alias("_all"))))  # one row
    rows = rows.withColumn("_ref", F.when(F.col("_n") >= 3, F.col("_own")).otherwise(F.col("_all")))
    rows = rows.withColumn("relative", F.when(F.col("_ref") > 0, F.col("sharpness") / F.col("_ref")).otherwise(1.0))
    sharp = F.col("sharpness")
    rows = rows.withColumn("_blurry", (sharp < BLUR) | ((F.col("relative") < BLUR_RELATIVE) & (sharp < 4 * BLUR)))
    closed = F.coalesce(F.col("eyes_closed"), F.lit(0))
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    term = unit(F.log1p(sharp) / F.log1p(F.greatest(F.col("_ref"), F.lit(BLUR)) * 2))
    light = F.least(F.lit(0.5), F.col("clip_high") * 2 + F.col("clip_low") * 1.5 + F.greatest(F.lit(0.0), F.abs(F.col("mean") - 0.46) - 0.2))
    eyes = F.when((closed > 0) & (F.col("faces") > 0), 0.35 * closed / F.col("faces")).otherwise(0.0)
    score = unit(0.75 * term + 0.25 - light - eyes - F.when(F.col("_blurry"), 0.2).otherwise(0.0))
    badges = [F.when(F.col("_blurry"), "blurry"), F.when(closed > 0, "eyes-closed"), exposure_badge(F.col("mean"), F.col("clip_low"), F.col("clip_high"))]
    rows = rows.withColumns({"score": score, "badges": F.array_compact(F.array(*badges))})
    rows = rows.drop("_own", "_n", "_all", "_ref", "_blurry")
    if groups is None:
        return rows.withColumns({"group": F.lit(None).cast("long"), "best": F.lit(False)})
    rows = rows.join(groups, "path", "left")
    fair = ~(F.array_contains("badges", "over") | F.array_contains("badges", "under"))
    tops = rows.where("group IS NOT NULL").groupBy("group").agg(
        F.max(F.when(fair, sharp)).alias("_fair"), F.max(sharp).alias("_any"), F.max(F.struct("score", (-F.col("path")).alias("p")))["p"].alias("_best"), F.count("*").alias("_size"))
    rows = rows.join(tops, "group", "left")
    missed = sharp < BLUR_GROUP * F.coalesce("_fair", "_any")
    more = F.array_compact(F.array(F.when(F.col("group").isNotNull(), "duplicate"), F.when(missed & ~F.array_contains("badges", "blurry"), "blurry")))
    rows = rows.withColumns({"badges": F.concat("badges", more), "best": F.coalesce(F.col("_best") == -F.col("path"), F.lit(False))})
    return rows.drop("_fair", "_any", "_best", "_size")


def rejects(judged: DataFrame, marks: DataFrame, duplicates_too: bool = False) -> DataFrame:
    """Paths that nobody flagged and that are blurry, badly exposed or have closed eyes, or, if asked, are not the best of their group."""
    bad = F.arrays_overlap("badges", F.array(*[F.lit(b) for b in ("blurry", "eyes-closed", "over", "under")]))
    if duplicates_too:
        bad = bad | (F.col("group").isNotNull() & ~F.col("best"))
    flagged = marks.where("flag <> 0").select("path")
    return judged.where(bad).join(flagged, "path", "left_anti").select("path")
