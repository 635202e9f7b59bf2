"""Joins and groupings that Spark has no operator for, kept to equi-joins and windows so that none compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, columns: list[str]) -> DataFrame:
    """Each left row with ``columns`` of the right row of its key that is latest at or before it, null where there is none.

    Both sides are one table in order of time, and the last right row is
    carried on: one shuffle, however many right rows precede a left one.  Of
    right rows with one time the one with the greatest columns counts.
    """
    value = F.struct(*columns)
    rows = left.select(F.struct("*").alias("_left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"))
    other = right.select(F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), value.alias("_v"), F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0).alias("_side"))
    order = Window.partitionBy("_by").orderBy("_at", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(other).withColumn("_v", F.last("_v", ignorenulls=True).over(order))
    return both.where("_left IS NOT NULL").select("_left.*", *[F.col(f"_v.{c}").alias(c) for c in columns])


def interval_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float, by: str | None = None) -> DataFrame:
    """Points with the spans [low, high) that hold them: an equi-join on slots of ``width``, which a span lists, then the exact test."""
    slot = lambda c: F.floor(F.col(c) / width).cast("long")
    listed = spans.where(F.col(low) < F.col(high)).withColumn("_slot", F.explode(F.sequence(slot(low), slot(high))))
    keys = ["_slot"] if by is None else ["_slot", by]
    return points.withColumn("_slot", slot(at)).join(listed, keys).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_slot")


def top_by(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group on the map side."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def histogram_quantile(rows: DataFrame, by: list[str], value: str, q: float, low: float, high: float, bins: int = 4096) -> DataFrame:
    """The middle of the bin in which the q-th part of the values is reached: one pass, no value is sorted."""
    step = (high - low) / bins
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / step))).cast("int")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, at.alias("_bin")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumns({"_below": F.sum("_n").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(whole)})
    reached = F.min(F.when(F.col("_below") >= F.ceil(F.col("_all") * q), F.col("_bin")))
    return counts.groupBy(*by).agg((low + (reached + 0.5) * step).alias("quantile"))
