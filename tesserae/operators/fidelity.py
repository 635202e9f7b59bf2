"""Comparison of rendered images with their references: metrics, verdicts, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RGB = ("r", "g", "b")
#: Bins of the percentile, buckets of the error histogram and their width.
BINS, BUCKETS, BUCKET = 4096, 32, 0.5


def over_white(px: DataFrame, prefix: str = "") -> list[Column]:
    """Levels over white."""
    alpha = px[f"{prefix}a"] / 255.0
    return [px[prefix + c] * alpha + 255.0 * (1 - alpha) for c in RGB]


def aligned(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The common part of two rasters, pixel by pixel: (img, x, y, d), the mean difference of the channels over white."""
    a = ours.select("img", "x", "y", *[v.alias(f"_o{c}") for v, c in zip(over_white(ours), RGB)])
    b = theirs.select("img", "x", "y", *[v.alias(f"_t{c}") for v, c in zip(over_white(theirs), RGB)])
    apart = [F.abs(F.col(f"_o{c}") - F.col(f"_t{c}")) for c in RGB]
    return a.join(b, ["img", "x", "y"]).select("img", "x", "y", ((apart[0] + apart[1] + apart[2]) / 3).alias("d"))


def metrics(pixels: DataFrame) -> DataFrame:
    """(img, mae, p95): the percentile is the lower edge of a histogram's bin, so one pass counts and no values are sorted."""
    bin_ = F.least(F.floor(F.col("d") / 255.0 * BINS + 1e-9), F.lit(BINS)).cast("int")
    bins = pixels.groupBy("img", bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    whole, up = Window.partitionBy("img"), Window.partitionBy("img").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumns({"below": F.sum("n").over(up), "all": F.sum("n").over(whole)})
    at = F.min(F.when(F.col("below") >= F.ceil(F.col("all") * 0.95), F.col("bin")))
    return bins.groupBy("img").agg((F.sum("s") / F.max("all")).alias("mae"), (at * 255.0 / BINS).alias("p95"))


def classify(mae: Column) -> Column:
    over = F.isnan(mae) | (mae > 10)
    return F.when(over, "over").when(mae <= 0, "exact").when(mae <= 1, "within1").when(mae <= 3, "within3").otherwise("within10")


def bucket_of(mae: Column) -> Column:
    return F.when(F.isnan(mae) | (mae <= 0), 0).otherwise(F.least(F.floor(mae / BUCKET), F.lit(BUCKETS - 1))).cast("int")


def error_histogram(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(bucket_of(F.col("mae")).alias("bucket")).agg(F.count("*").alias("n"))


def tally(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(classify(F.col("mae")).alias("verdict")).agg(F.count("*").alias("n"))


def worst(outcomes: DataFrame, n: int = 5) -> DataFrame:
    """The n outcomes with the largest error: the report's top list."""
    return outcomes.orderBy(F.desc("mae"), "img").limit(n)


def grid(px: DataFrame, side: int = 16) -> DataFrame:
    """(img, gx, gy, r, g, b): means over white of a grid's cells."""
    size = F.broadcast(px.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")))
    white = px.select("img", "x", "y", *[v.alias(c) for v, c in zip(over_white(px), RGB)]).join(size, "img")
    cell = lambda at, n: F.floor(F.col(at) * side / F.col(n)).cast("int")
    return white.groupBy("img", cell("x", "w").alias("gx"), cell("y", "h").alias("gy")).agg(*[F.avg(c).alias(c) for c in RGB])
