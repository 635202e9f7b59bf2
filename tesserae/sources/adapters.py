"""The driver's tables as rasters and as an image catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIDE = 64

#: The same rasters in SQL, as a common table expression.
PX_SQL = """e AS (
  SELECT label AS img, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
v AS (
  SELECT img, y, unnest(generate_series(0, 63)) AS x,
         list_transform(embedding, lambda f: least(255, greatest(0, floor((f::DOUBLE + 0.6) / 1.2 * 255 + 0.5)))) AS l FROM e),
px AS (
  SELECT img, x::INT AS x, y::INT AS y, l[x + 1]::INT AS r, l[(x + 1) % 64 + 1]::INT AS g, l[(x + 2) % 64 + 1]::INT AS b FROM v)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of 64 levels a vector: (img, y, l)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    order = Window.partitionBy("label").orderBy("vec_id")
    level = lambda f: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((f.cast("double") + 0.6) / 1.2 * 255 + 0.5))).cast("int")
    return rows.select(
        F.col("label").alias("img"), (F.row_number().over(order) - 1).alias("y"), F.transform("embedding", level).alias("l")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opaque image a label: a row of 64 pixels a vector, (img, x, y, r, g, b) with channels 0..255."""
    rows = lines(spark, sf_dir).select("img", "y", "l", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("x"))
    at = lambda k: F.col("l")[(F.col("x") + k) % SIDE]
    return rows.select("img", "x", "y", at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


#: Layers of a document in SQL: la (opaque), lb, lc and ld with alpha, and a mask m, all in 0..1.
LAYERED_SQL = PX_SQL + """, doc AS (SELECT img, x::INT AS x, y::INT AS y, """ + ", ".join(
    f"l[(x + {3 * k + j}) % 64 + 1] / 255.0::DOUBLE AS l{n}_{c}" if n != "a" or c != "a" else "1.0::DOUBLE AS la_a"
    for k, n in enumerate("abcd") for j, c in enumerate("rgba")
) + ", l[(x * 7 + 5) % 64 + 1] / 255.0::DOUBLE AS m FROM v)"


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one document a label, with the channels of four layers la, lb, lc, ld and a mask m in 0..1; la is opaque."""
    rows = lines(spark, sf_dir).select("img", "y", "l", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("x"))
    at = lambda k: F.col("l")[k % SIDE] / 255.0
    made = {f"l{n}_{c}": at(F.col("x") + 3 * k + j) for k, n in enumerate("abcd") for j, c in enumerate("rgba")}
    made["la_a"] = F.lit(1.0)
    return rows.select("img", "x", "y", *[v.alias(c) for c, v in made.items()], at(F.col("x") * 7 + 5).alias("m"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as catalogue items: path, kind, camera, capture time, sharpness, rating and flag."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("path"), F.col("event_type").alias("kind"), F.col("user_id").alias("camera"), F.col("ts").alias("capture"),
        F.col("value").alias("sharpness"), (F.col("event_id") % 6).cast("int").alias("rating"), (F.col("event_id") % 3 - 1).cast("int").alias("flag"),
    )


ITEMS_SQL = """items AS (
  SELECT event_id AS path, event_type AS kind, user_id AS camera, ts AS capture, value AS sharpness,
         (event_id % 6)::INT AS rating, (event_id % 3 - 1)::INT AS flag FROM events)"""


def translucent(px: DataFrame) -> DataFrame:
    """The rasters with an alpha made from place and colour."""
    return px.withColumn("a", ((F.col("r") + 2 * F.col("g") + F.col("x")) % 256).cast("int"))


#: Signals of events taken for images, in SQL.
SIGNALS_SQL = """s0 AS (SELECT event_id AS path, nullif(user_id % 7, 6) AS camera, value AS sharpness, (event_id % 101) / 100.0::DOUBLE AS mean, (event_id % 13) / 40.0::DOUBLE AS clip_low,
  (event_id % 17) / 60.0::DOUBLE AS clip_high, (event_id % 3)::INT AS faces, (event_id % 11 = 0)::INT AS eyes_closed, CASE WHEN event_id % 19 <> 0 THEN epoch_ms(ts) END AS capture,
  user_id % 97 AS u, event_id % 4 AS k FROM events),
s AS (SELECT path, camera, sharpness, mean, clip_low, clip_high, faces, eyes_closed, capture, xor(((u * u * u * 7919 + u * 104729 + 12345) % 1000003) * 4611686018, CASE k WHEN 0 THEN 0 WHEN 1 THEN 32512 WHEN 2 THEN 8323072 ELSE 2130706432 END) AS dhash,
  ((u * u * 15485863 + 7) % 1000003) * 3611686019 + k % 2 AS phash FROM s0)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measured images; hashes of one user's are seven or fourteen bits apart."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, u, k = F.col("event_id"), F.col("user_id") % 97, F.col("event_id") % 4
    flip = F.when(k == 0, 0).when(k == 1, 32512).when(k == 2, 8323072).otherwise(2130706432).cast("long")
    return e.select(
        i.alias("path"), F.nullif(F.col("user_id") % 7, F.lit(6)).alias("camera"), F.col("value").alias("sharpness"), (i % 101 / 100.0).alias("mean"), (i % 13 / 40.0).alias("clip_low"),
        (i % 17 / 60.0).alias("clip_high"), (i % 3).cast("int").alias("faces"), (i % 11 == 0).cast("int").alias("eyes_closed"), F.when(i % 19 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("capture"),
        (((u * u * u * 7919 + u * 104729 + 12345) % 1000003) * 4611686018).bitwiseXOR(flip).alias("dhash"), (((u * u * 15485863 + 7) % 1000003) * 3611686019 + k % 2).alias("phash"),
    )
