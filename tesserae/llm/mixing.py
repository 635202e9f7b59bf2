"""Mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, 0-based by code point with null last, without a global window.

    A range sort orders the partitions; the rank is a row's place in its
    partition plus the rows of the partitions before it, of which the driver
    sees one count a partition.
    """
    placed = scratch.table(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()),
        "sources",
    )
    part = F.shiftright("place", 33)
    counts = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))
    before, at = {}, 0
    for k, n in counts:
        before[k], at = at, at + n
    offset = F.lit(0).cast("long")
    if before:
        pairs = [F.lit(x).cast("long") for kv in before.items() for x in kv]
        offset = F.create_map(*pairs)[part]
    return placed.withColumn("rank", offset + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))


def _level(sources: DataFrame, share: float, most: float) -> float:
    """Words a unit of weight gets: shares out again until no target is above its bound."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not weight:
        return 0.0
    level, held = share * total / weight, 0
    while True:
        full = F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size")
        capped, left = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if capped == held and left == weight or not left:
            return level
        level, held, weight = (share * total - most * capped) / left, capped, left


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) rows -> (source, source_size, target, rate)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(sources)
    weight = F.array(*[F.lit(w) for w in weights])[F.pmod("rank", F.lit(len(weights))).cast("int")]
    ranked = ranked.withColumn("weight", weight.cast("long"))
    level = _level(ranked, share, most)
    bound = F.lit(most) * F.col("source_size")
    target = F.when(F.lit(level) * F.col("weight") > bound, bound).otherwise(F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return ranked.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Each document with the number of copies that the mix takes of it.

    Tokens are summed by source (map-side first), each source's repetition
    rate is its target over its size, and a document gets ``floor(rate)``
    copies plus one more if a hash of seed and doc_id, read as a number in
    [0, 1), is below the fraction.

    Returns doc_id, text, source, size, source_size, target, rate, copies and
    taken.  Null or empty texts have size 0; a null source is a source of its
    own, ordered last; a null doc_id hashes as the word null; repeated rows
    are each counted and share their hash; an empty table gives no rows;
    columns other than doc_id, text and source are left out.
    """
    sized = scratch.columns(docs, "doc_id", "text", "source").withColumn("size", n_words(F.col("text")))
    by_source = scratch.table(targets(sized.select("source", "size"), weights, share, most), "targets")
    # The optimiser broadcasts the sources only below its size threshold; else it splits the skewed join.
    joined = sized.alias("d").join(by_source.alias("s"), F.expr("d.source <=> s.source"))
    joined = joined.select("d.*", "s.source_size", "s.target", "s.rate")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    whole = F.floor("rate")
    copies = whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row a copy, numbered from 1 in ``copy``; documents without a copy go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (
  SELECT *, row_number() OVER o AS k,
         coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
         sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY source_size / weight, source)),
v AS (
  SELECT (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * capped::DOUBLE) / left_w::DOUBLE AS lev
  FROM r
  WHERE (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * capped::DOUBLE) / left_w::DOUBLE * weight <= 2.0::DOUBLE * source_size
  ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least((SELECT lev FROM v) * weight, 2.0::DOUBLE * source_size)::DOUBLE AS target FROM w),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM x
"""
