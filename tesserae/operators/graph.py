"""Connected components of an edge list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Where tables of rounds go on one machine whose session names no shared folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints/tesserae-rounds"


def kept(rows: DataFrame) -> DataFrame:
    """The rows written to the cluster's shared folder (spark.checkpoint.dir) and read again, so that rounds don't repeat each other.

    A checkpoint would hand on the guessed size of the plan that made it; over
    the joins of many rounds these multiply beyond what numbers hold.
    """
    session, context = rows.sparkSession, rows.sparkSession.sparkContext
    shared = context.getCheckpointDir() or session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(shared or LOCAL_DIR).rstrip('/')}/round-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return session.read.schema(rows.schema).parquet(path)


def components(edges: DataFrame, keep=kept) -> DataFrame:
    """Edges (u, v) -> (node, component), the least node of each; ``keep`` stores a round's table and cuts its lineage.

    Each round gives every node the least label around it and then its label's
    own label, so a path of n nodes needs about log n rounds.  Minima are
    pre-aggregated before the shuffle: a hub's neighbours never meet in a task.
    """
    both = edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = keep(both.distinct())
    labels = keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    before = None
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("_near"))
        grown = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "_near").alias("label"))
        jump = grown.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        grown = keep(grown.join(jump, F.col("label") == F.col("_n")).select("node", F.least("label", "_l").alias("label")))
        now = grown.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.countDistinct("label")).first()
        if now == before:
            return grown.select("node", F.col("label").alias("component"))
        labels, before = grown, now
