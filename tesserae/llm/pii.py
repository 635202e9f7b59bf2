r"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is column expressions.  A pattern's matches are bracketed in the
text by two control characters that no pattern can match (they are first
replaced in the input by a third, so lengths stay), and the offsets are sums
of the lengths between the brackets.

The patterns are the base ones rewritten so that matching takes linear time
and no recursion: repeats are possessive where nothing after them could need
the characters back, and a lookbehind skips starts inside a run whose first
character has already failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"

#: Kinds in their order, the pattern that proposes spans, and a cheap necessary condition.
KINDS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")),
    ),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ),
    "card": (
        # A run starts where no digit, with or without one separator, stands before; short runs can't pass.
        r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){11}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
        lambda t: t.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"),
    ),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: F.contains(t, F.lit("+")),
    ),
    # Added by the method, with a mod-97 checksum.
    "iban": (
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    ),
}
BASE = ("email", "ip", "card", "phone")

#: Score without context, and words nearby that raise it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|courriel|correo)\b",
    "ip": r"(?i)\b(ip|host|server|address|adresse|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|telefon|tél|teléfono)\b",
    "iban": r"(?i)\b(iban|bank|account|konto|compte|cuenta)\b",
}
#: Characters on either side in which context words count, and what one adds.
NEAR, RAISE = 40, 0.2


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's checksum."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number (letters and digits, spaces between) leaves 1 modulo 97."""
    plain = F.regexp_replace(match, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    marks = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    return F.aggregate(marks, F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{small}(?:\.{small}){{3}}$")
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        n = F.length(F.regexp_replace(match, r"\x20", ""))
        return F.when(n.between(15, 34), mod97(match)).otherwise(F.lit(False))
    return F.lit(True)


SPAN = "array<struct<start:bigint,place:int,end:bigint,kind:string,match:string>>"


def _spans(kind: str, parts: Column) -> Column:
    """Bracketed pieces of the text -> spans; the first piece stands before the first match."""
    place = list(KINDS).index(kind)
    empty = F.array().cast(SPAN)

    def step(acc: Column, piece: Column) -> Column:
        match = F.substring_index(piece, CLOSE, 1)
        end = acc["at"] + F.length(match)
        span = F.struct(
            acc["at"].alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind).alias("kind"), match.alias("match")
        )
        return F.struct(
            (acc["at"] + F.length(piece) - 1).alias("at"),
            F.concat(acc["found"], F.when(_valid(kind, match), F.array(span)).otherwise(empty)).alias("found"),
        )

    first = F.struct(F.length(parts[0]).cast("bigint").alias("at"), empty.alias("found"))
    return F.aggregate(F.slice(parts, 2, F.size(parts)), first, step)["found"]


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id, text, and ``spans``: array of (start, place, end, kind,
    match, score) by start and then kind, offsets in code points, end
    exclusive.  Base kinds are leftmost and non-overlapping within a kind;
    spans of different kinds may overlap.  A span's score is its kind's prior,
    raised if a context word stands within ``NEAR`` characters.

    A null or empty text has no spans; repeated rows are each searched; an
    empty table gives no rows; columns other than doc_id and text are left out.
    """
    found = scratch.columns(docs, "doc_id", "text")
    found = found.withColumn("clean", F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, OTHER + OTHER))
    for kind, (pattern, likely) in KINDS.items():
        marked = F.regexp_replace("clean", F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))
        parts = F.when(likely(F.col("clean")), F.split(marked, OPEN, -1))
        found = found.withColumn(f"_{kind}", parts)
    for kind in KINDS:
        some = F.size(f"_{kind}") > 1
        found = found.withColumn(f"_{kind}", F.when(some, _spans(kind, F.col(f"_{kind}"))).otherwise(F.array().cast(SPAN)))
    spans = F.array_sort(F.concat(*[F.col(f"_{kind}") for kind in KINDS]))

    def scored(s: Column) -> Column:
        before = F.substring(F.col("clean"), F.greatest(s["start"] - NEAR, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(NEAR)).cast("int"))
        after = F.substring(F.col("clean"), s["end"].cast("int") + 1, F.lit(NEAR))
        near, prior = F.concat(before, F.lit(" "), after), F.lit(0.0)
        raised = F.lit(False)
        for kind in KINDS:
            prior = F.when(s["kind"] == kind, F.lit(PRIOR[kind])).otherwise(prior)
            raised = F.when(s["kind"] == kind, near.rlike(CONTEXT[kind])).otherwise(raised)
        return s.withField("score", prior + F.when(raised, RAISE).otherwise(0.0))

    return found.withColumn("all", spans).select("doc_id", "text", F.transform("all", scored).alias("spans"))


def _digest(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _is(kind: str):
    return lambda s: s["kind"] == kind


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "iban")
    top = F.array_max(F.transform("spans", lambda s: s["score"]))
    return found.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), top.alias("top_score"))
