"""N-gram Jaccard join by token-combination prefixes.

Texts with equal shingle sets are one node.  A shingle's frequency is counted
over all nodes and sent back to the nodes that hold it, so each can order its
shingles by (frequency, hash).  With ``m = n - ceil(t * n)`` the shingles that
a similar set may lack:

* A node with more than m shingles of its own alone has no similar one.
* A node whose first m + 1 shingles are all rare indexes those that others
  have too as single tokens.
* Any other node extends its prefix to all shingles: it indexes its rare ones
  as single tokens and combines those that others have too into bins of about
  two, each bin's combination being one key.  Two similar sets of at most U
  shingles differ in at most ``d = 2 * U * (1 - t) / (1 + t)`` shingles.  Of
  twice as many bins and two more, the first d + 1 filled ones are indexed;
  some bin is equal in both as long as either set fills so many.  Bins are
  made for a node's size class and the next, so similar sizes meet.
* Of those, a node of up to ``SMALL`` shingles, or one that fills too few bins,
  also indexes its first m + 1 in the order, whatever their frequency.

Shingles that a fiftieth of all nodes have come last in the order and are told
to every task instead of being counted in one.

Nodes that share a key are candidates, clustered as ``components.cluster``
says: no link between components is missed, and the pairs inside a group of
copies are never all made.  A node's mark tells how many shingles it alone has
and, of the others, the parity of those in each of 64 * MARK cells: two sets
differ in as many shingles at least as their marks do.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, scratch
from . import textkit as tk

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
#: Similarity in hundredths.
LIKE = 80
#: Nodes that a shingle is in at most to count as rare.
RARE = 24
#: Sizes up to which single frequent shingles are indexed, and from which combinations are.
SMALL, LARGE = 30, 24
#: Shingles that one task sorts at once, about, and that a map task gathers before it sends them.
TASK_ROWS = 2_000_000
GATHER = 1_000_000
#: One in so many nodes of a gathering, and of all, that have a shingle which every task is told of; nodes of a gathering at least.
LOCAL_HOT, HOT, HOT_LEAST = 100, 50, 16
#: Ids of candidates that are broadcast at most (8 bytes each); beyond it, the join is shuffled.
BROADCAST_ROWS = 500_000
#: Texts verified against one copy of a centre's text, and texts in one task's batch.
PER_CENTRE, BATCH = 500, 2000
#: Longs of a mark.
MARK = 16


def _misses(n):
    """Shingles of a set of n that a similar set may lack."""
    return n - -(-LIKE * n // 100)


def _classes(most: int) -> list[int]:
    """Upper sizes of the size classes: a similar set is in the same class or the one beside it."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 100 // LIKE))
    return out


_BOUNDS = np.array(_classes(1 << 40), np.int64)


def _bins(size_class: int) -> int:
    return 2 * (2 * int(_BOUNDS[size_class]) * (100 - LIKE) // (100 + LIKE) + 1)


def node_of(found) -> int:
    """The identity of a set of shingles."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(tk.mix(found ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)
        return tk.mix(np.array([total + np.uint64(len(found)) * np.uint64(tk.STEP)], np.uint64))[0]


def _signatures(batches):
    """Rows (id, text_key, n, node); a row of negative n tells that a gathering has -n nodes with the shingle in place of the id."""
    names = ["id", "text_key", "n", "node"]
    seen, values, held = set(), [], 0

    def common():
        shingle, count = np.unique(np.concatenate(values), return_counts=True)
        shingle = shingle[(many := count >= max(HOT_LEAST, len(seen) // LOCAL_HOT))]
        none = np.zeros(len(shingle), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (tk.signed(shingle), none, -count[many], none)], names)

    for batch in batches:
        n, node = [], []
        for found in tk.shingle_sets(batch.column(1)):
            n.append(len(found))
            node.append(node_of(found))
            if len(found) and node[-1] not in seen:
                seen.add(node[-1])
                values.append(found)
                held += len(found)
                if held >= GATHER:
                    yield common()
                    seen, values, held = set(), [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(tk.signed(np.array(node, np.uint64)))], names)
    if held:
        yield common()


def _blobs(rows):
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])


def _home(gathering: int, cut: int) -> int:
    """The bucket that a gathering's frequencies come back to."""
    return int(tk.mix(np.array([gathering], np.uint64))[0] & np.uint64((1 << cut) - 1))


def _runs(values):
    """First places of the runs of equal values, and their ends."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    return first, np.append(first[1:], len(values))


def _shingled(bits: int, cut: int, hot):
    """Sends each bucket of shingles those of each gathering with their places in it, and a list of the gathering's nodes.

    Shingles are cut to their first ``bits`` bits.  Equal nodes in one
    gathering send theirs once; those in ``hot`` are listed with the nodes.
    """
    width = -(-(bits - cut) // 8)

    def flush(gathering, nodes, sizes, values):
        lens = np.array([len(v) for v in values])
        flat = np.concatenate(values)
        place = np.arange(len(flat))
        name = np.array([gathering], "<u8").tobytes()
        told = np.isin(flat, hot)
        rank = np.searchsorted(hot, flat[told])
        out = [(_home(gathering, cut), tk.pack(b"N", name, np.array(nodes, "<u8").tobytes(), tk.planes(np.array(sizes), 5), tk.planes(lens, 5), tk.planes(place[told], 5), tk.planes(rank, 4)))]
        order = np.argsort(flat, kind="stable")
        order = order[~told[order]]
        flat, place = flat[order], place[order]
        bucket = (flat >> np.uint64(bits - cut)).astype(np.int64)
        low = flat & np.uint64((1 << (bits - cut)) - 1)
        for i, j in zip(*_runs(bucket)):
            steps = np.diff(low[i:j], prepend=np.uint64(0))
            out.append((int(bucket[i]), tk.pack(b"S", name, tk.planes(steps, width), tk.planes(place[i:j], 5))))
        return _blobs(out)

    def run(batches):
        part, turn = TaskContext.get().partitionId(), 0
        seen, nodes, sizes, values, held = set(), [], [], [], 0
        for batch in batches:
            for found in tk.shingle_sets(batch.column(1)):
                if not len(found) or (node := node_of(found)) in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                sizes.append(len(found))
                values.append(tk.distinct(found >> np.uint64(64 - bits)))
                held += len(found)
                if held >= GATHER:
                    yield flush((part << 24) + turn, nodes, sizes, values)
                    turn += 1
                    seen, nodes, sizes, values, held = set(), [], [], [], 0
        if held:
            yield flush((part << 24) + turn, nodes, sizes, values)

    return run


def _counted(bits: int, cut: int):
    """A bucket's shingles that occur several times, with their count, sent back to each gathering's bucket."""
    width, full = -(-(bits - cut) // 8), -(-bits // 8)

    def run(key, table):
        names, values, places, out = [], [], [], []
        for blob in table.column("blob"):
            kind, name, *parts = tk.unpack(blob.as_py())
            if kind == b"N":
                out.append((key[0].as_py(), blob.as_py()))
                continue
            n = len(parts[0]) // width
            names.append(int(np.frombuffer(name, "<u8")[0]))
            values.append(np.cumsum(tk.from_planes(parts[0], n, width), dtype=np.uint64))
            places.append(tk.from_planes(parts[1], n, 5).astype(np.int64))
        if values:
            of = np.repeat(np.arange(len(names), dtype=np.int32), [len(v) for v in values])
            t, p = np.concatenate(values), np.concatenate(places)
            del values, places
            order = np.argsort(t, kind="stable")
            t = t[order]
            first, end = _runs(t)
            df = np.repeat(end - first, end - first)
            order, t, df = order[df > 1], t[df > 1], df[df > 1]
            of, p = of[order], p[order]
            t += np.uint64(key[0].as_py()) << np.uint64(bits - cut)
            order = np.lexsort((p, of))
            of, p, t, df = of[order], p[order], t[order], df[order]
            for i, j in zip(*_runs(of)) if len(of) else ():
                name = names[of[i]]
                steps = np.diff(p[i:j], prepend=0)
                out.append((_home(name, cut), tk.pack(b"F", np.array([name], "<u8").tobytes(), tk.planes(steps, 5), tk.planes(t[i:j], full), tk.planes(df[i:j], 5))))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    return run


def keys_of(n: int, tokens, df, need: int):
    """A node's index keys from the shingles that others have too, by (frequency, hash), and their frequencies.

    ``n`` is the set's size and ``need`` how many of these tokens its prefix of
    m + 1 holds.
    """
    if need <= 0:
        return tokens[:0]
    rare = int(np.searchsorted(df, RARE, "right"))
    if rare >= need:
        return tk.mix(tokens[:need])
    single, keys = need if n <= SMALL else rare, []
    if n > LARGE:
        own = int(np.searchsorted(_BOUNDS, n))
        mixed = tk.mix(tokens ^ np.uint64(0xE7037ED1A0B428DB))
        for size_class in (own, own + 1):
            which = (mixed % np.uint64(_bins(size_class))).astype(np.int64)
            order = np.argsort(which, kind="stable")
            first = _runs(which[order])[0]
            # As many filled bins as may differ, and one: a similar set's first ones hold an equal bin among them.
            sums = np.add.reduceat(mixed[order], first)[: _bins(size_class) // 2]
            first = first[: len(sums)]
            label = which[order][first].astype(np.uint64) + (np.uint64(size_class) << np.uint64(40))
            keys.append(tk.mix(sums ^ tk.mix(label)))
            if len(first) < _bins(size_class) // 2:
                single = need
    return np.concatenate([tk.mix(tokens[:single]), *keys])


def mark_of(tokens):
    """The parities of the tokens in 64 * MARK cells."""
    cell = tk.mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * MARK)
    odd = np.bincount(cell.astype(np.int64), minlength=64 * MARK) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _indexed(bits: int, hot, counts):
    """A bucket of gatherings' nodes with their shared shingles -> (node, n, alone, mark, keys) of those that may have a similar one."""
    full = -(-bits // 8)

    def run(key, table):
        bases, nodes, sizes, lens, total = {}, [], [], [], 0
        where, tokens, freqs, found = [], [], [], []
        blobs = [tk.unpack(blob.as_py()) for blob in table.column("blob")]
        for kind, name, *parts in blobs:
            if kind == b"N":
                k = len(parts[0]) // 8
                bases[name] = total
                nodes.append(np.frombuffer(parts[0], "<u8"))
                sizes.append(tk.from_planes(parts[1], k, 5).astype(np.int64))
                lens.append(tk.from_planes(parts[2], k, 5).astype(np.int64))
                rank = tk.from_planes(parts[4], len(parts[4]) // 4, 4).astype(np.int64)
                where.append(total + tk.from_planes(parts[3], len(rank), 5).astype(np.int64))
                tokens.append(hot[rank])
                freqs.append(counts[rank])
                total += int(lens[-1].sum())
        for kind, name, *parts in blobs:
            if kind == b"F":
                k = len(parts[0]) // 5
                where.append(bases[name] + np.cumsum(tk.from_planes(parts[0], k, 5)).astype(np.int64))
                tokens.append(tk.from_planes(parts[1], k, full))
                freqs.append(tk.from_planes(parts[2], k, 5).astype(np.int64))
        del blobs
        nodes, sizes, lens = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(lens)
        t, df = np.concatenate(tokens), np.concatenate(freqs)
        v = np.searchsorted(np.cumsum(lens), np.concatenate(where), "right")
        order = np.lexsort((t, df, v))
        t, df, v = t[order], df[order], v[order]
        alone = lens - np.bincount(v, minlength=len(lens))
        need = sizes - -(-LIKE * sizes // 100) + 1 - alone
        for i, j in zip(*_runs(v)) if len(v) else ():
            k = v[i]
            if need[k] > 0:
                keys = keys_of(int(sizes[k]), t[i:j], df[i:j], int(need[k]))
                found.append((nodes[k].view(np.int64), sizes[k], alone[k], mark_of(t[i:j]), tk.signed(np.unique(keys))))
        longs = pa.list_(pa.int64())
        kinds = {"node": pa.int64(), "n": pa.int64(), "alone": pa.int64(), "mark": longs, "keys": longs}
        return pa.table({c: pa.array([x[i] for x in found], kind) for i, (c, kind) in enumerate(kinds.items())})

    return run


def similar(a, b) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of LIKE hundredths at least."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b) or 100 * len(b) < LIKE * len(a):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int(np.count_nonzero(a[at] == b))
    return 100 * both >= LIKE * (len(a) + len(b) - both)


def _verify(table):
    """Rows (u, salt, node, text): texts of each (u, salt) against that of u itself."""
    sets, out = list(tk.shingle_sets(table.column("text"))), []
    u, salt, node = (np.array(table.column(c)) for c in ("u", "salt", "node"))
    order = np.lexsort((node != u, salt, u))
    centre, of = None, None
    for i in order:
        if int(np.int64(node_of(sets[i]).view(np.int64))) != node[i]:
            continue  # another text of the same id and hash
        if node[i] == u[i]:
            centre, of = sets[i], (u[i], salt[i])
        elif of == (u[i], salt[i]) and similar(centre, sets[i]):
            out.append((u[i], node[i]))
    return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([x for _, x in out], pa.int64())})


def _power(n: float) -> int:
    return max(0, math.ceil(math.log2(max(1, n))))


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that are similar.  A centre with many partners is dealt out in parts, each with a copy of its text."""
    with scratch.scope() as own:
        salted = pairs.join(pairs.groupBy("u").agg(F.count("*").alias("all")), "u")
        salted = salted.select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("all") / PER_CENTRE)).alias("salt"))
        want = salted.select("u", "salt", F.col("v").alias("node")).unionByName(
            salted.select("u", "salt", F.col("u").alias("node")).distinct()
        )
        want = own.table(want.join(nodes.select("node", "rep"), "node").select("u", "salt", "node", F.col("rep.id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")), "wanted")
        rows = want.count()
        side = F.broadcast(want) if rows <= BROADCAST_ROWS else want
        texts = docs.join(side, (F.col("text_key") == F.col("rep_key")) & F.col("id").eqNullSafe(F.col("rep_id"))).select("u", "salt", "node", "text")
        batch = F.pmod(F.xxhash64("u", "salt"), F.lit(max(1, rows // BATCH)))
        done = texts.groupBy(batch.alias("batch")).applyInArrow(_verify, "u long, v long")
        return own.keep(own.table(done.distinct(), "links"))


def slack(a: str, b: str) -> F.Column:
    """How many shingles two nodes could still differ in, at most, beyond those that their marks tell; negative where they can't be similar."""
    apart = [F.bit_count(F.col(f"{a}m{k}").bitwiseXOR(F.col(f"{b}m{k}"))) for k in range(MARK)]
    told = sum(apart, F.col(f"{a}alone") + F.col(f"{b}alone"))
    return (100 - LIKE) * (F.col(f"{a}n") + F.col(f"{b}n")) - (100 + LIKE) * told


def _parts(docs: DataFrame) -> DataFrame:
    """(id, text_key, n, node, part) of every document: part names its component, null where no other text is in it."""
    with scratch.scope() as own:
        docs = scratch.columns(docs, "doc_id", "text")
        docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("text_key"))
        rows = own.table(docs.mapInArrow(_signatures, "id long, text_key long, n long, node long"), "signatures")
        sig = rows.where("n >= 0")
        nodes = sig.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("id").alias("id"), F.min(F.struct("id", "text_key")).alias("rep"), F.count("*").alias("copies"))
        nodes = own.table(nodes, "nodes")
        total, most = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

        bits, cut = min(64, _power(total) + 12), _power(total / TASK_ROWS)
        # A fiftieth of the nodes each: at most 50 times the mean size of a set.
        common = rows.where("n < 0").groupBy("id").agg(F.sum(-F.col("n")).alias("n")).where(F.col("n") * HOT >= most).toArrow()
        hot = np.array(common["id"], np.int64).view(np.uint64) >> np.uint64(64 - bits)
        hot, first = np.unique(hot, return_index=True)
        counts = np.array(common["n"], np.int64)[first] + (1 << 39)  # after all that are counted in full

        parcel = "bucket int, blob binary"
        sent = docs.mapInArrow(_shingled(bits, cut, hot), parcel)
        back = sent.groupBy("bucket").applyInArrow(_counted(bits, cut), parcel)
        found = back.groupBy("bucket").applyInArrow(_indexed(bits, hot, counts), "node long, n long, alone long, mark array<long>, keys array<long>")
        found = own.table(found, "indexed")
        marks = found.select("node", "n", "alone", *[F.col("mark")[k].alias(f"m{k}") for k in range(MARK)])
        marks = own.table(marks.groupBy("node").agg(*[F.min(c).alias(c) for c in marks.columns[1:]]), "marks")
        keyed = found.select("node", F.explode("keys").alias("key")).distinct()
        groups = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("high")).where("centre < high")
        meet = own.table(keyed.join(groups.select("key", "centre"), "key").select("key", "node", "centre"), "meet")
        own.drop(found)
        part = components.cluster(meet, marks, slack, lambda pairs: verify(pairs, nodes, docs))

        out = sig.join(part, "node", "left").select("id", "text_key", "n", "node", F.col("component").alias("part"))
        return own.keep(own.table(out, "parts"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents with one of each component, the least by doc_id (those without one last) and the text's hash.

    Decided for each text by itself: a document without a doc_id, or one whose
    doc_id another text has too, goes only if its own text is not the one that
    stays.  Of rows that agree in doc_id and text one stays.  Documents without
    words are components of their own and all stay.
    """
    part = _parts(docs).where("n > 0").withColumn("part", F.coalesce("part", "node"))
    doc = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    many = part.groupBy("part").agg(F.min(doc).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = part.join(many, "part").select("id", "text_key", "first").distinct()
    stays = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.text_key") == F.col("text_key"))
    with scratch.scope() as own:
        gone = own.keep(own.table(gone.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), stays.alias("_stays")), "copies"))
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    rows = keyed.join(gone, (F.col("_text") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")), "left")
    kept = rows.where("_stays IS NULL").unionByName(rows.where("_stays").dropDuplicates(["_doc", "_text"]))
    return kept.select("_row.*")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Words are runs of bytes other than space and 09-0D, A-Z lower-cased.  A
    null or empty text, or one without words, has an empty set and is a
    component of its own; repeated rows are linked as equal texts, and the
    least id names a component whatever the ties; a null doc_id is a document
    whose component is named by the least id of the others, or null; texts of
    any length are read whole; an empty table gives no rows; columns other
    than doc_id and text are left out.
    """
    part = _parts(docs).withColumn("part", F.coalesce("part", "node"))
    # Names: the least id of a component.  Texts without words are in none.
    names = part.where("n > 0").groupBy("part").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    out = part.join(names.select("part", "least"), "part", "left")
    whole = F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), whole.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
      ELSE list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')) END AS l
    FROM w), unnest(l) AS u(sh)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * common >= 80 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""
