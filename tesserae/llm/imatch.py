"""I-Match document fingerprints (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

#: Share of documents that a term of the lexicon is in, at least and at most: the inverse-document-frequency band.
BAND = (0.01, 0.2)
#: Randomised lexicon subsets besides the whole: (subsets, a term is in each with probability 1 over this), disjoint within a level.
LEVELS = ((3, 4), (12, 16), (24, 64), (24, 256))
#: Documents dealt to one range of ids.
RANGE_ROWS = 2000


def terms(text: Column) -> Column:
    """Hashes of a text's distinct words, lower-cased, in ascending order."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))))


def constants(numbers: list[int]) -> Column:
    """An array of longs that the optimiser folds to one literal."""
    if not numbers:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def lexicon(docs: DataFrame, band=BAND) -> list[int]:
    """Hashes of the terms whose document frequency lies in the band.

    Counts cover all documents.  A term in at least a share ``band[0]`` of N
    documents accounts for that many of the N * t distinct terms, so there are
    at most t / band[0] terms, t being the mean of distinct terms a document:
    a bound that does not grow with N.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    kept = df.where(F.col("count").between(band[0] * n, band[1] * n)).where("count > 1").select("term")
    return sorted(r[0] for r in kept.toLocalIterator())


def _in(shift: int, one_in: int, low: int, high: int):
    """Terms whose draw at this level, bits of the term's hash, is from low to below high."""
    draw = lambda h: F.shiftright(h, shift).bitwiseAND(F.lit(one_in - 1))
    return (lambda h: draw(h) == low) if high == low + 1 else (lambda h: draw(h) < high)


def with_marks(df: DataFrame, text: str, out: str, words: list[int]) -> DataFrame:
    """Adds one 16-bit hash for each lexicon subset, null where the text has no term of it.

    A text without a lexicon term counts with all its terms.
    """
    df = df.withColumn("_all", terms(F.col(text)))
    df = df.withColumn("_own", F.array_intersect("_all", constants(words)))
    df = df.withColumn("_own", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_all")))
    subsets, shift = [F.col("_own")], 0
    for k, (count, one_in) in enumerate(LEVELS):
        df = df.withColumn(f"_level{k}", F.filter("_own", _in(shift, one_in, 0, count)))
        subsets += [F.filter(f"_level{k}", _in(shift, one_in, j, j + 1)) for j in range(count)]
        shift += one_in.bit_length() - 1
    one = lambda own: F.when(F.size(own) > 0, F.xxhash64(own).bitwiseAND(F.lit(0xFFFF)))
    df = df.withColumn(out, F.transform(F.array(*subsets), one))
    return df.drop("_all", "_own", *[f"_level{k}" for k in range(len(LEVELS))])


def as_string(marks: Column) -> Column:
    one = lambda x: F.when(x.isNull(), F.lit("----")).otherwise(F.lower(F.lpad(F.hex(x), 4, "0")))
    return F.array_join(F.transform(marks, one), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with a term in either text on whose hash both agree; 1 if there is none."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    same = total(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)))
    some = total(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), 1).otherwise(0)))
    return F.when(some > 0, same / some).otherwise(F.lit(1.0)).cast("double")


def fingerprint(docs: DataFrame, words: list[int] | None = None) -> DataFrame:
    """doc_id, text and ``marks`` of every whole text.

    Null texts count as empty; equal texts have equal fingerprints, empty
    ones included (no subset has a term); repeated rows are each
    fingerprinted; an empty table gives no rows; columns other than doc_id and
    text are left out.
    """
    docs = scratch.columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return with_marks(docs, "text", "marks", lexicon(docs) if words is None else words)


def followed(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Adds struct ``next`` of the carried columns of the next row by descending doc_id, the last being followed by the first.

    Rows are dealt by ranges of doc_id that quantiles cut, so no task holds
    all; a range's last row is followed by the next range's first, of which
    there is one a range.  Ties of doc_id are in the order of text; a null
    doc_id is last.
    """
    n = rows.count()
    parts = max(1, min(4096, n // RANGE_ROWS))
    cuts = []
    if parts > 1:
        cuts = sorted({x for x in rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (parts * 4))})
    cuts = [int(x) for x in cuts]
    known = constants(cuts)
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(known, lambda x: x < F.col("doc_id"))))
    rows = rows.withColumn("_part", part)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    firsts = sorted((tuple(x) for x in rows.groupBy("_part").agg(F.max("doc_id")).collect()), reverse=True)
    step = Window.partitionBy("_part").orderBy(*order)
    rows = rows.withColumn("next", F.lead(F.struct(*carry)).over(step))
    if not firsts:
        return rows.drop("_part")
    follows = {a[0]: b for a, b in zip(firsts, firsts[1:] + firsts[:1])}
    heads = [x for _, x in firsts if x is not None]
    wanted = F.col("doc_id").isin(heads) if heads else F.lit(False)
    if any(x is None for _, x in firsts):
        wanted = wanted | F.col("doc_id").isNull()
    head = rows.where(wanted).groupBy("_part").agg(F.min(F.struct("text", *[c for c in carry if c != "text"])).alias("_h"))
    head = head.select(F.col("_part").alias("_of"), F.struct(*[F.col("_h")[c].alias(c) for c in carry]).alias("_head"))
    chain = rows.sparkSession.createDataFrame([(a, b[0]) for a, b in follows.items()], "_at int, _of int")
    # One row a range, 4096 at most.
    head = head.join(F.broadcast(chain), "_of").select("_at", "_head")
    rows = rows.join(F.broadcast(head), rows["_part"] == head["_at"], "left")
    return rows.withColumn("next", F.coalesce("next", "_head")).drop("_part", "_at", "_head")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    words = lexicon(docs)
    rows = followed(fingerprint(docs, words), ["text", "marks"])
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", n.alias("n_chars"), "marks", F.col("next.marks").alias("next_marks"),
        F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"),
    )
    rows = with_marks(rows, "edited", "edited_marks", words)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("marks")).alias("fingerprint"),
        as_string(F.col("edited_marks")).alias("edited_fingerprint"), likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
