"""Incremental strokes: segments that arrive out of order become finished strokes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strokes(segments: DataFrame, pause: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Rows (actor, at, x, y) -> one row a stroke: a session of an actor's segments without a longer pause.

    Works on a stream, where ``late`` bounds the state, and on a table alike.
    """
    session = F.session_window("at", pause)
    return (
        segments.withWatermark("at", late)
        .groupBy("actor", session.alias("s"))
        .agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
        .select("actor", F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "n", "x0", "y0", "x1", "y1")
    )
