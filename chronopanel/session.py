"""What the operators need from a session: a shared folder for intermediate tables, and a check before broadcasting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast when its size is not bounded by construction.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables (``spark.checkpoint.dir``). Only a local session without one gets a temporary folder."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if have:
        return have
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="chronopanel-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`discard` deletes."""
    path = f"{shared_dir(spark)}/chronopanel/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def discard(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables that this process has written (from number ``since`` on) and say how many. Results that read them must have been written before."""
    gone = _written[since:]
    del _written[since:]
    for path in gone:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Operators used inside may write intermediate tables; they are deleted at the end."""
    before = len(_written)
    try:
        yield
    finally:
        discard(spark, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the plan is cut, nothing is computed twice, a lost executor loses nothing.

    The table stays until :func:`discard`, as results that are still to be read may need it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` is seen to have at most ``rows`` rows; else the plan keeps its shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
