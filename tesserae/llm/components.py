"""Clustering of candidates, and distributed union-find by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Nodes of one key that meet in one cell at most, about; a larger key is dealt out to pairs of its blocks.
CELL = 2000
#: Rounds of new centres at most; of the nodes that share a key across components, one in so many must gain a link for another one.
ROUNDS, LEAST = 16, 100
#: Pairs that share keys across components, counted for each key, that are compared without further rounds.
FEW_PAIRS = 200_000
#: Edges whose components the driver finds by itself at most (16 bytes each); more of them take rounds of stars.
DRIVER_EDGES = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v).

    Minima are pre-aggregated map-side and joined back, so a hub's neighbours
    never meet in one task: the join's skewed partitions can be split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
    )


def _once(meet: DataFrame) -> DataFrame:
    """Of keys that the same nodes share, one: the others, as those of a passage's further words, pair nobody else."""
    node = [F.xxhash64("node", F.lit(k)) for k in range(2)]
    sets = meet.groupBy("key").agg(F.bit_xor(node[0]).alias("x"), F.bit_xor(node[1]).alias("y"), F.count("*").alias("n"))
    sets = sets.groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key")
    return meet.join(sets, "key").select("key", "node", "centre")


def _apart(meet: DataFrame, part: DataFrame) -> DataFrame:
    """Memberships (key, node, part) of the keys that nodes of several parts share."""
    placed = meet.select("key", "node").join(part, "node", "left")
    placed = placed.select("key", "node", F.coalesce("component", "node").alias("part"))
    split = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    return _once(placed.withColumn("centre", F.col("part")).join(split.select("key"), "key")).withColumnRenamed("centre", "part")


def _few(meet: DataFrame) -> bool:
    """Whether the nodes of all keys are FEW_PAIRS pairs at most."""
    if meet.count() > FEW_PAIRS:
        return False
    n = F.col("count").cast("double")
    return (meet.groupBy("key").count().agg(F.sum(n * n)).first()[0] or 0) <= 2 * FEW_PAIRS


def _cells(meet: DataFrame) -> DataFrame:
    """Memberships dealt out to cells: a key's blocks i and j meet in one cell, so a cell holds about two blocks of CELL nodes."""
    sizes = meet.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    rows = meet.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return rows.select(cell.alias("cell"), "key", "node", "part", "block", (F.col("block") == F.col("other")).alias("same"))


def _named(marks: DataFrame, prefix: str) -> DataFrame:
    return marks.select(*[F.col(c).alias(f"{prefix}{c}") for c in marks.columns])


def _crossing(meet: DataFrame, marks: DataFrame, slack, every: bool, few_keys: bool, quick=None) -> DataFrame:
    """Pairs (u, v) of nodes of different parts that share a key and may be linked.

    Unless ``every``, of the nodes of a part that a node may be linked to only
    the likeliest: one link joins the two.
    """
    if few_keys:
        marks = marks.join(meet.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")
    rows = _cells(meet).join(marks, "node")
    a, b = _named(rows, "a_"), _named(rows, "b_")
    left = slack("a_", "b_")
    meeting = F.expr("a_cell = b_cell AND a_part < b_part AND (a_same OR a_block <> b_block)")
    if quick is not None:
        # The first two always hold: with them both sides need the same columns, and so read one exchange.
        meeting &= F.expr("a_key = b_key AND a_same = b_same") & quick("a_", "b_")
    if few_keys:
        # Nodes that share several keys are a pair in the first one only, before all their marks are compared.
        meeting &= F.expr("a_key = array_min(array_intersect(a_keys, b_keys))")
    meeting &= left >= 0
    pairs = a.join(b, meeting)
    pairs = pairs.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"), F.col("b_part").alias("part"), left.alias("left"))
    if not every:
        # Aggregates of numbers: hashed, so the joined pairs are never sorted or stored.
        return pairs.groupBy("u", "part").agg(F.max_by("v", "left").alias("v"), (F.min("v") < F.max("v")).alias("more")).select("u", "v", "more")
    return pairs.select("u", "v").distinct()


def cluster(meet: DataFrame, marks: DataFrame, slack, verify, few_keys: bool = False, sharper=None) -> DataFrame:
    """Memberships (key, node, centre) -> (node, component) of verified links.

    ``marks`` (node, ...) are small summaries of the nodes; ``slack(a, b)``
    gives, from the marks under two prefixes, a number that is negative only
    where two nodes can't be linked.  ``verify`` keeps the links of pairs
    (u, v).  ``few_keys`` says that no node has more than a few dozen keys, so
    that it can carry them along.  ``sharper(nodes)`` gives marks and a slack that
    tell more, for the nodes that are compared pair by pair, and a condition that
    is quick to tell and holds wherever that slack is not negative.

    Every node is verified against one centre, the likeliest by the marks of
    those that its keys have.  While that finds links, each key draws a new
    centre, and every node outside its component is verified against one
    again; so a group of copies grows together in a few rounds, each as large
    as the memberships; few pairs need no rounds.  For
    what then still shares a key across components, the marks of each pair are
    compared, in cells of bounded size, and those that may be linked verified:
    first the likeliest of each node and component, then all that are left.
    So two nodes that share a key and are linked always end up together.
    """
    with scratch.scope() as own:
        meet = own.table(_once(meet), "meet")

        def nearest(found):
            """Of the centres of a node's keys the likeliest, as pairs (u, v) of centre and node."""
            pairs = found.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
            both = pairs.join(_named(marks, "a_"), F.col("u") == F.col("a_node")).join(_named(marks, "b_"), F.col("v") == F.col("b_node"))
            both = both.withColumn("left", slack("a_", "b_")).where("left >= 0")
            return both.groupBy("v").agg(F.max_by("u", "left").alias("u")).select("u", "v")

        known = own.table(nearest(meet), "pairs")
        links = verify(known)
        for turn in range(ROUNDS + 1):
            part = own.table(components(links), "parts")
            apart = own.table(_apart(meet, part), "meet")
            own.drop(meet)
            meet = apart
            if _few(meet):
                break
            nodes = meet.agg(F.approx_count_distinct("node")).first()[0]
            if turn == ROUNDS or turn and fresh.count() * LEAST < nodes:
                break
            drawn = meet.withColumn("draw", F.xxhash64("node", F.lit(turn)))
            least = drawn.groupBy("key").agg(F.min("draw").alias("draw"))
            centre = drawn.join(least, ["key", "draw"]).select("key", F.col("node").alias("centre"), F.col("part").alias("own"))
            pairs = nearest(meet.join(centre, "key").where("part <> own"))
            pairs = own.table(pairs.join(known, ["u", "v"], "left_anti"), "pairs")
            known = known.unionByName(pairs)
            fresh = verify(pairs)
            links = links.unionByName(fresh)
        known = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        quick = None
        if sharper is not None:
            marks, slack, quick = sharper(meet.select("node").distinct())
            marks = own.table(marks, "sharp")
        pairs = own.table(_crossing(meet, marks, slack, False, few_keys, quick), "pairs")
        links = links.unionByName(verify(pairs.select("u", "v")))
        part = own.table(components(links), "parts")
        # Where the likeliest of several was none, the others are tried too.
        u, v = part.toDF("u", "cu"), part.toDF("v", "cv")
        rest = pairs.where("more").join(u, "u", "left").join(v, "v", "left").where("coalesce(cu, u) <> coalesce(cv, v)")
        rest = own.table(rest.select("u").distinct(), "rest")
        if not rest.count():
            return own.keep(part)
        meet = own.table(_apart(meet, part), "meet")
        held = meet.join(rest.select(F.col("u").alias("node")), "node", "left_semi").select("key").distinct()
        pairs = _crossing(meet.join(held, "key"), marks, slack, True, few_keys, quick).join(known, ["u", "v"], "left_anti")
        links = links.unionByName(verify(own.table(pairs, "pairs")))
        return own.keep(own.table(components(links), "parts"))


def least_members(u, v):
    """The nodes of edges (u[i], v[i]), ascending, and the least node that each reaches."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(node))
    while len(a):
        # The root of the greater end takes the lesser one's; then each node points to its root again.
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (up := least[least]).tobytes() != least.tobytes():
            least = up
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    return node, node[least]


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> (node, component); component is the least node.

    Nodes without an edge are absent.  Null ends are ignored, self-loops and
    repeated edges change nothing.
    """
    edges = edges.select("u", "v").where("u <> v")
    edges = scratch.table(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(edges)
    if mark[0] <= DRIVER_EDGES:
        found = edges.toArrow()
        node, least = least_members(np.array(found["u"], np.int64), np.array(found["v"], np.int64))
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "component": least}))
    while mark[0]:
        grown = scratch.table(_star(_star(edges, True), False), "stars")
        scratch.drop(edges)
        edges, last, mark = grown, mark, _mark(grown)
        if mark == last:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
