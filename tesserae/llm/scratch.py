"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine where the session names no shared folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints/tesserae"

#: Has the session delete a statement's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scopes: list[scope] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a local one where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_DIR


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; the innermost open scope owns the files.

    The write's shuffle files go with it: those of many rounds would stay until
    the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].paths.add(path)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`table` that no later plan reads."""
    _delete(df.sparkSession, df._scratch_path)
    for s in _scopes:
        s.paths.discard(df._scratch_path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class scope:
    """Tables made inside are deleted at the end, but for those kept, which pass to the scope around it, if any."""

    def __init__(self):
        self.paths = set()

    def __enter__(self) -> scope:
        _scopes.append(self)
        return self

    def __exit__(self, *error) -> None:
        _scopes.remove(self)
        spark = SparkSession.getActiveSession()
        for path in self.paths if spark is not None else ():
            _delete(spark, path)

    table, drop = staticmethod(table), staticmethod(drop)

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.discard(df._scratch_path)
        if len(_scopes) > 1:
            _scopes[_scopes.index(self) - 1].paths.add(df._scratch_path)
        return df


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; other columns, whatever their names, play no part."""
    return df.select(*[df[n] for n in names])
