"""Catalogue queries over items (path, kind, camera, capture, sharpness, rating, flag)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def view(items: DataFrame, min_rating: int = 0, kinds: list[str] | None = None, flag: str = "all") -> DataFrame:
    """Items of a rating at least, of given kinds, by flag: all, picked, rejected, unflagged or not-rejected."""
    marked = items.withColumns({"rating": F.coalesce("rating", F.lit(0)), "flag": F.coalesce("flag", F.lit(0))})
    marked = marked.where(F.col("rating") >= min_rating)
    if kinds:
        marked = marked.where(F.col("kind").isin(kinds))
    wanted = {"picked": "flag = 1", "rejected": "flag = -1", "unflagged": "flag = 0", "not-rejected": "flag <> -1"}
    return marked.where(wanted[flag]) if flag != "all" else marked


def bursts(items: DataFrame, seconds: int) -> DataFrame:
    """Runs of a camera's items no more than ``seconds`` apart, numbered by camera, and the sharpest of each."""
    order = Window.partitionBy("camera").orderBy("capture", "path")
    gap = F.unix_micros(F.col("capture").cast("timestamp")) - F.lag(F.unix_micros(F.col("capture").cast("timestamp"))).over(order) > seconds * 1_000_000
    runs = items.withColumn("burst", F.sum(F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(order))
    best = Window.partitionBy("camera", "burst").orderBy(F.desc("sharpness"), "path")
    size = F.count("*").over(Window.partitionBy("camera", "burst"))
    return runs.select("path", "camera", "burst", size.alias("size"), (F.row_number().over(best) == 1).alias("best"))


def named(items: DataFrame) -> DataFrame:
    """Export names from kind, date and rating, made unique without regard to case by -2, -3 and so on."""
    stem = F.concat_ws("_", F.lower("kind"), F.date_format("capture", "yyyyMMdd"), F.col("rating").cast("string"))
    same = Window.partitionBy("stem").orderBy("path")
    rows = items.withColumn("stem", stem).withColumn("k", F.row_number().over(same))
    return rows.select("path", F.concat("stem", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("name"))


def undo_steps(commands: DataFrame, seconds: int) -> DataFrame:
    """Commands (actor, at, seq, key) merged into steps: a run of one key without a pause, as undo sees it."""
    order = Window.partitionBy("actor").orderBy("at", "seq")
    pause = F.unix_micros(F.col("at").cast("timestamp")) - F.lag(F.unix_micros(F.col("at").cast("timestamp"))).over(order) > seconds * 1_000_000
    new = F.coalesce((F.lag("key").over(order) != F.col("key")) | pause, F.lit(True))
    steps = commands.withColumn("step", F.sum(F.when(new, 1).otherwise(0)).over(order))
    return steps.groupBy("actor", "step").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))
