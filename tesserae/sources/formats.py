"""Small text formats: marks in XMP sidecars, colour cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of colour labels, from 1.
LABELS = ("red", "yellow", "green", "blue", "purple")


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rating, flag, label) of the sidecars of a folder, one file a row; files without marks are left out."""
    files = spark.read.text(f"{folder}/*.xmp", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.withColumn("marks", marks_of(F.col("value"))).where("marks IS NOT NULL").select("path", "marks.*")


def sidecar_name(name: Column) -> Column:
    """A file's name with .xmp in place of its extension; a leading dot begins no extension."""
    return F.concat(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"), F.lit(".xmp"))


def _value(xml: Column, name: str) -> Column:
    """An attribute or, failing that, an element; null where there is neither."""
    attribute = F.regexp_extract(xml, rf'{name}\s*=\s*"([^"]*)"', 1)
    element = F.regexp_extract(xml, rf"<{name}>([^<]*)</{name}>", 1)
    return F.when(F.regexp_like(xml, F.lit(rf'{name}\s*=\s*"[^"]*"')), attribute).when(F.regexp_like(xml, F.lit(rf"<{name}>[^<]*</{name}>")), element)


def marks_of(xml: Column) -> Column:
    """Struct (rating 0..5, flag -1..1, label 0..5), null where the text is no packet or holds no mark.

    A negative rating is a reject, whose stars are kept beside it; numbers that
    can't be read count as 0.
    """
    rating, label, pick, stars = (_value(xml, n) for n in ("xmp:Rating", "xmp:Label", "ops:Pick", "ops:Stars"))
    number = lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0))
    # Halves up, as for positive and negative numbers alike.
    whole = F.floor(number(rating) + 0.5)
    flag = F.when(whole < 0, -1).otherwise(F.signum(F.floor(number(pick) + 0.5)).cast("int"))
    given = F.when(whole < 0, number(stars)).otherwise(whole)
    place = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.lower(F.trim(F.coalesce(label, F.lit("")))))
    marks = F.struct(F.least(F.lit(5), F.greatest(F.lit(0), given)).cast("int").alias("rating"), flag.cast("int").alias("flag"), place.cast("int").alias("label"))
    packet = F.regexp_like(xml, F.lit("xmpmeta|rdf:RDF")) & (rating.isNotNull() | label.isNotNull() | pick.isNotNull())
    return F.when(packet, marks)


def parse_cube(text: str) -> tuple[int, list]:
    """(size, colours) of a 3D table of colours, brought from its domain into 0..1; red varies fastest.

    Raises ValueError for one-dimensional tables and for wrong numbers of entries.
    """
    size, rows, domain = 0, [], {"DOMAIN_MIN": (0.0, 0.0, 0.0), "DOMAIN_MAX": (1.0, 1.0, 1.0)}

    def numbers(words):
        out = []
        for w in words:
            try:
                out.append(float(w))
            except ValueError:
                continue
        return out

    for line in map(str.split, text.splitlines()):
        if not line or line[0].startswith("#"):
            continue
        if line[0] == "LUT_1D_SIZE":
            raise ValueError("only 3D tables are supported")
        if line[0] == "LUT_3D_SIZE":
            size = int(line[1])
        elif line[0] in domain:
            domain[line[0]] = tuple(numbers(line[1:])) if len(numbers(line[1:])) == 3 else domain[line[0]]
        elif numbers(line[:1]) and len(numbers(line)) >= 3:
            # The domain that was named so far holds.
            low, high = domain["DOMAIN_MIN"], domain["DOMAIN_MAX"]
            rows.append(tuple((v - a) / (z - a) for v, a, z in zip(numbers(line), low, high)))
    if size < 2 or len(rows) != size**3:
        raise ValueError(f"expected {size**3} entries, found {len(rows)}")
    return size, rows
