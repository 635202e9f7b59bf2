"""Runs a registered query in Spark and its SQL in DuckDB and compares rows."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def database(sf: str):
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return db


def plain(x):
    """A missing value as None, whole numbers as ints."""
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else float(x) if isinstance(x, float) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(repr, ([plain(x) for x in r] for r in frame.itertuples(index=False))))


def same(spark, db, query, sql: str, sf: str) -> tuple[bool, str]:
    names, got = rows(query(spark, f"{DATA}/{sf}").toPandas())
    expected_names, expected = rows(db.sql(sql).df())
    if names != expected_names:
        return False, f"columns {names} against {expected_names}"
    if got != expected:
        from collections import Counter

        more, less = Counter(got) - Counter(expected), Counter(expected) - Counter(got)
        return False, f"{len(got)} rows against {len(expected)}, {more.total()} apart: {sorted(more)[:2]} against {sorted(less)[:2]}"
    return True, ""
