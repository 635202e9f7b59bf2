"""Fuzzy line deduplication by MinHash (DataFrame functions only).

A line's shingles are its substrings of SHINGLE bytes.  ORDERS multipliers give
as many orders of their hashes, and a line's signature is the least value in
each.  Each of BANDS names ROWS places of the signature: lines that agree in
all of them share a key.  Lines that share a key, and with it AGREE places of
their signatures at least, are candidates; those whose bit sets of shingles
don't rule it out are verified by their exact Jaccard similarity and joined by
union-find.  Of each component's lines the first stays.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import components, scratch

#: Bytes of a shingle: a line of 60 bytes or more may differ in an inner byte.
SHINGLE = 6
#: A pair of similarity 0.8 shares a key with probability 0.978, one of 0.85 with 0.994.
ORDERS, BANDS, ROWS = 16, 12, 4
#: Places of the signature that a verified pair agrees in: one of similarity 0.8 does with probability 0.993.
AGREE = 9
#: Similarity in hundredths.
LIKE = 80
#: Words of 64 bits in a line's bit set, a power of two: each shingle sets one bit.
WORDS = 16
#: The same for lines that are compared pair by pair, where many are only a little less alike than LIKE: each distinct shingle turns one bit over.
SHARP_WORDS = 32
#: Bands whose keys are shuffled at once (32 bytes a line and band).
AT_ONCE = 2
#: Nodes of a key at most among which those without a partner are looked for; a key of more keeps all.
SMALL_KEY = 64
#: Hashes of candidate lines that are broadcast at most (8 bytes each); beyond it, the join is shuffled.
BROADCAST_ROWS = 1_000_000

_rng = random.Random(7)
#: Odd multipliers of 30 bits: products with hashes of 31 bits don't overflow.
_FACTORS = [_rng.randrange(1 << 29, 1 << 30) * 2 + 1 for _ in range(ORDERS)]
_MIDDLE = (1 << 48) - 1


def _bands() -> list[list[int]]:
    """Places of each band: every place in as many bands, and no two bands with more places in common than need be."""
    used, out = [0] * ORDERS, []
    for _ in range(BANDS):
        tries = [_rng.sample(range(ORDERS), ROWS) for _ in range(200)]
        shared = lambda c: max([len({*c} & {*d}) for d in out], default=0)
        best = min(tries, key=lambda c: (sum(used[i] for i in c) + 4 * shared(c), sorted(c)))
        for i in best:
            used[i] += 1
        out.append(sorted(best))
    return out


PLACES = _bands()


def _starts(line: Column) -> Column:
    """Where a line's shingles start; a line shorter than one is its own."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(line) - (SHINGLE - 1), F.lit(1)))


def shingles(line: Column) -> Column:
    """A line's shingle hashes, with repeats."""
    # The lambda's variable holds the bytes: a column's would be copied for each shingle.
    each = lambda raw: F.transform(_starts(raw), lambda i: F.xxhash64(F.substring(raw, i, F.lit(SHINGLE))))
    return F.transform(F.array(line.cast("binary")), each)[0]


def similar(a: Column, b: Column) -> Column:
    """Whether two lines' sets of shingles have a Jaccard similarity of LIKE hundredths at least."""
    # A one-element array holds both lists, so each is made once.
    lists = F.array(F.struct(shingles(a).alias("a"), shingles(b).alias("b")))
    return F.exists(lists, lambda s: 100 * F.size(F.array_intersect(s["a"], s["b"])) >= LIKE * F.size(F.array_union(s["a"], s["b"])))


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (id, text_key, place, line, line_key) of all lines that are not blank."""
    out = docs.select("id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return out.where(F.col("line").rlike(r"[^\x09-\x0D\x20]")).withColumn("line_key", F.xxhash64("line"))


def _hashes(lines: DataFrame) -> DataFrame:
    """(node, hash): the lines' shingles, one row each."""
    # Cast in a step of its own, or the whole line is cast, and so copied, for each of its shingles.
    raw = lines.select("line_key", F.col("line").cast("binary").alias("raw"))
    each = raw.select("line_key", "raw", F.explode(_starts(F.col("raw"))).alias("i"))
    return each.select(F.col("line_key").alias("node"), F.xxhash64(F.substring("raw", F.col("i"), F.lit(SHINGLE))).alias("hash"))


def signatures(lines: DataFrame) -> DataFrame:
    """(node, m0, m1, ...) of every distinct line, named by its line_key.

    A line's shingles are rows of one task only, which the partial aggregate
    reduces to the signature; equal lines of other tasks give the same.
    """
    each = _hashes(lines).select("node", F.shiftrightunsigned("hash", 33).alias("h"))
    least = [F.min((F.col("h") * f).bitwiseAND(F.lit(_MIDDLE))).alias(f"m{k}") for k, f in enumerate(_FACTORS)]
    sig = each.groupBy("node").agg(*least)
    return sig.select("node", *[F.shiftright(f"m{k}", 17).cast("int").alias(f"m{k}") for k in range(ORDERS)])


def bit_sets(lines: DataFrame) -> DataFrame:
    """(node, b0, b1, ..., n) of distinct lines: a bit for each shingle's hash, and the number of shingles with repeats."""
    # A line is in one task, so what is left of it after the partial aggregate is one row.
    return _words(_hashes(lines), F.bit_or, WORDS)


def sharp_sets(lines: DataFrame) -> DataFrame:
    """As ``bit_sets``, with SHARP_WORDS words, a bit set where an odd number of distinct shingles has it, and n their number.

    Where two such sets differ, one of the shingles that only one line has is
    behind it, however many they share: a quarter of the words tells as much.
    """
    return _words(lines.select(F.col("line_key").alias("node"), F.explode(F.array_distinct(shingles(F.col("line")))).alias("hash")), F.bit_xor, SHARP_WORDS)


def _words(hashes: DataFrame, fold, words: int) -> DataFrame:
    """(node, b0, b1, ..., n): the bits of each node's hashes, folded, and their number."""
    # The signature takes a hash's upper bits, the bit set its lower ones.
    each = hashes.select("node", F.expr("shiftleft(1L, CAST(hash & 63 AS INT))").alias("bit"), F.expr(f"shiftright(hash, 6) & {words - 1}").alias("word"))
    bits = [fold(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(words)]
    return each.groupBy("node").agg(*bits, F.count("*").cast("int").alias("n"))


def possible(a: str, b: str) -> Column:
    """Whether two lines can be similar by their bit sets, which tell that some shingles are in one only: it never denies a similar pair."""
    alone = lambda x, y: sum((F.bit_count(F.col(f"{x}b{k}").bitwiseAND(F.bitwise_not(f"{y}b{k}"))) for k in range(WORDS)), F.lit(0))
    # A one-element array holds both counts, so each is made once.
    counts = F.array(F.struct(alone(a, b).alias("a"), alone(b, a).alias("b")))
    common = lambda s: F.least(F.col(f"{a}n") - s["a"], F.col(f"{b}n") - s["b"])
    return F.exists(counts, lambda s: (100 - LIKE) * common(s) >= LIKE * (s["a"] + s["b"]))


def packed(marks: DataFrame) -> DataFrame:
    """The marks with s0 and s1: the lowest byte of each place of the signature, eight to a word."""
    word = lambda ks: reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"m{k}").cast("long").bitwiseAND(F.lit(255)), 8 * (k % 8)) for k in ks])
    return marks.withColumns({f"s{i}": word(range(8 * i, 8 * i + 8)) for i in range(ORDERS // 8)})


def quick(a: str, b: str) -> Column:
    """Whether the signatures' lowest bytes agree in AGREE places at least, as those of candidates do."""
    differ = F.lit(0).cast("long")
    for i in range(ORDERS // 8):
        bits = F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))
        for n in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
        differ = differ.bitwiseOR(F.shiftleft(bits.bitwiseAND(F.lit(0x0101010101010101)), i))
    return F.bit_count(differ) <= ORDERS - AGREE


def agreement(a: str, b: str) -> Column:
    """Places in which two signatures agree, beyond those that they must; -1 where the lines can't be similar."""
    same = [(F.col(f"{a}m{k}") == F.col(f"{b}m{k}")).cast("int") for k in range(ORDERS)]
    left = sum(same[1:], same[0]) - AGREE
    return F.when((left >= 0) & possible(a, b), left).otherwise(-1)


def sharp_agreement(a: str, b: str) -> Column:
    """As ``agreement``, by ``sharp_sets``: as many shingles at least are in one line only as their bit sets differ in."""
    # No lambda, whose arguments would not be compiled; bits and doubles, as sums of integers are checked for overflow.
    same = [F.shiftleft((F.col(f"{a}m{k}") == F.col(f"{b}m{k}")).cast("int"), k) for k in range(ORDERS)]
    left = F.bit_count(reduce(Column.bitwiseOR, same)) - AGREE
    apart = [F.bit_count(F.col(f"{a}b{k}").bitwiseXOR(F.col(f"{b}b{k}"))).cast("double") for k in range(SHARP_WORDS)]
    like = F.lit(100.0 - LIKE) * (F.col(f"{a}n") + F.col(f"{b}n")) >= F.lit(100.0 + LIKE) * sum(apart[1:], apart[0])
    return F.when((left >= 0) & like, left).otherwise(-1)


def _verifier(texts: DataFrame):
    """Checks pairs of candidate lines by their exact similarity."""

    def verify(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("line_key").alias("u"), F.col("line").alias("a"))
        b = texts.select(F.col("line_key").alias("v"), F.col("line").alias("b"))
        both = pairs.join(a, "u").join(b, "v")
        return scratch.table(both.where(similar(F.col("a"), F.col("b"))).select("u", "v"), "links")

    return verify


def shared_keys(marks: DataFrame, bands: list[int]) -> DataFrame:
    """(key, node, centre) of the bands' keys, for nodes that agree with another one of the key in AGREE places; centre is the key's least.

    Most nodes that share a key agree in little more than its own places, the
    more so the larger the table is.  Of a key of more than SMALL_KEY nodes all stay.
    """
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in PLACES[b]]) for b in bands]
    # All sides of the joins read one exchange.
    keyed = packed(marks).select("node", *[f"s{i}" for i in range(ORDERS // 8)], F.explode(F.array(*keys)).alias("key")).repartition("key")
    groups = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
    # The few shared keys are hashed, so the memberships of all lines need no sort.
    meet = keyed.join(groups.where("low < high").select("key", "size").hint("shuffle_hash"), "key")
    a, b = (meet.select(*[F.col(c).alias(f"{s}_{c}") for c in meet.columns]) for s in "ab")
    partner = F.expr("a_key = b_key") & (F.expr(f"a_size > {SMALL_KEY}") | (F.expr("a_node <> b_node") & quick("a_", "b_")))
    held = a.join(b.hint("merge"), partner, "left_semi").select(F.col("a_key").alias("key"), F.col("a_node").alias("node"))
    return held.withColumn("centre", F.min("node").over(Window.partitionBy("key")))


def parts(lines: DataFrame) -> DataFrame:
    """(node, component) of the lines, by line_key, that have a similar other one."""
    with scratch.scope() as own:
        signed = own.table(signatures(lines), "signatures")
        # A few bands after the other, or the keys of all lines are the most that is on disk.
        meets = [own.table(shared_keys(signed, list(range(b, min(b + AT_ONCE, BANDS)))), "meet") for b in range(0, BANDS, AT_ONCE)]
        meet = reduce(DataFrame.unionByName, meets)
        # Candidates are stored once, for all rounds.
        wanted = own.table(meet.select(F.col("node").alias("line_key")).distinct(), "candidates")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        texts = own.table(lines.select("line_key", "line").join(side, "line_key", "left_semi").dropDuplicates(["line_key"]), "lines")
        held = signed.join(side.withColumnRenamed("line_key", "node"), "node", "left_semi")
        marks = own.table(held.join(bit_sets(texts), "node"), "marks")
        own.drop(signed)

        def sharper(nodes):
            compared = texts.join(nodes.withColumnRenamed("node", "line_key"), "line_key", "left_semi")
            signs = marks.select("node", *[f"m{k}" for k in range(ORDERS)])
            return packed(signs.join(sharp_sets(compared), "node")), sharp_agreement, quick

        return own.keep(components.cluster(meet, marks, agreement, _verifier(texts), few_keys=True, sharper=sharper))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines: adds ``n_lines`` and ``n_removed``; n_chars, where there is one, is the new length.

    Lines are parts between newlines.  Of equal and similar lines the first
    stays, by doc_id (those without one last), the text's hash and place; blank
    lines always stay.  Null texts stay null and have no lines; an empty text
    is one blank line; repeated rows of one doc_id and text count as one
    document, so all of them keep the same; an empty table gives no rows.  A
    text of any length is read whole; a line's shingles are made row by row.
    All other columns pass through, whatever their names; n_lines and n_removed
    are replaced.
    """
    with scratch.scope() as own:
        keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("text_key"))
        lines = lines_of(keyed)
        part = parts(lines)
        doc = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
        counts = lines.groupBy("line_key").agg(F.count("*").alias("n"), F.min(doc).alias("first"))
        counts = counts.join(part.withColumnRenamed("node", "line_key"), "line_key", "left")
        counts = counts.where("n > 1 OR component IS NOT NULL").withColumn("part", F.coalesce("component", "line_key"))
        counts = own.table(counts.select("line_key", "part", "first"), "repeated")
        whole = counts.groupBy("part").agg(F.min("first").alias("first"))
        repeats = counts.select("line_key", "part").join(whole, "part")
        found = lines.select("id", "text_key", "place", "line_key").join(repeats, "line_key")
        # Of each document the places of a part: all go but the first one in the part's first document.
        held = found.groupBy("id", "text_key", "part").agg(F.collect_set("place").alias("places"), F.min("place").alias("least"), F.first("first").alias("first"))
        first = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.text_key") == F.col("text_key"))
        going = F.when(first, F.array_remove("places", F.col("least"))).otherwise(F.col("places"))
        gone = held.groupBy("id", "text_key").agg(F.flatten(F.collect_list(going)).alias("gone")).where(F.size("gone") > 0)
        gone = own.keep(own.table(gone.select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key"), "gone"), "gone"))
    out = keyed.join(gone, (F.col("text_key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    split = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    # A one-element array holds the lines, so they are split once.
    kept = F.transform(F.array(split), lambda s: F.array_join(F.transform(left, lambda i: s[i]), "\n"))[0]
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    out = out.select("row", new.alias("text"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    passed = [made[c] if c in made else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[v.alias(c) for v, c in zip(passed, names)], "n_lines", "n_removed")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chars", F.sha2("text", 256).alias("kept_sha256"))
