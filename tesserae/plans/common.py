"""What the registered queries share: registries, rasters in 0..1 and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blend import quantise
from ..sources.adapters import ITEMS_SQL, PX_SQL, catalogue, pixels

QUERIES: dict = {}
ORACLES: dict = {}
RGB = ("r", "g", "b")

#: Channels of px in 0..1, as a common table expression to go after PX_SQL.
UNIT_SQL = ", u AS (SELECT img, x, y, " + ", ".join(f"{c} / 255.0::DOUBLE AS {c}" for c in RGB) + " FROM px)"


def clip(e: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {e}))"


def level(e: str) -> str:
    return f"floor({clip(e)} * 255 + 0.5000001::DOUBLE)::INT"


def each(expression: str, source: str = "u") -> str:
    """The same expression of {c} for each channel, as levels."""
    return "SELECT img, x, y, " + ", ".join(f"{level(expression.format(c=c))} AS {c}" for c in RGB) + f" FROM {source}"


def levels_of(source: str) -> str:
    return "SELECT img, x, y, " + ", ".join(f"{level(c)} AS {c}" for c in RGB) + f" FROM {source}"


def unit(px: DataFrame) -> DataFrame:
    return px.withColumns({c: px[c] / 255.0 for c in RGB})


def as_levels(px: DataFrame) -> DataFrame:
    return px.select("img", "x", "y", *[quantise(F.col(c)).alias(c) for c in RGB])


def pixel_query(name: str, make, sql: str, more: str = "") -> None:
    """A query on rasters; ``sql`` selects from px."""
    QUERIES[name] = lambda spark, sf_dir: make(pixels(spark, sf_dir))
    ORACLES[name] = f"WITH {PX_SQL}{more} {sql}"


def item_query(name: str, make, sql: str, more: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: make(catalogue(spark, sf_dir))
    ORACLES[name] = f"WITH {ITEMS_SQL}{more} {sql}"


def table_query(name: str, make, sql: str) -> None:
    """A query on the driver's tables: ``make`` gets a function that reads one by name."""
    QUERIES[name] = lambda spark, sf_dir: make(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLES[name] = sql
