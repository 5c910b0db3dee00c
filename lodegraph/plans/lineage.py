"""Lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The folder is ``spark.checkpoint.dir``; only where no folder is set (single-machine
    tests) an own temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lodegraph-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def parts_for(spark, rows: int, most: int) -> int:
    """Partitions so that none holds more than about ``most`` rows, and no fewer than the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def broadcast_below(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted ``rows`` are within ``limit``; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def too_few_splits(df: DataFrame) -> int | None:
    """The session's parallelism where a table is read in fewer splits than that (a small table in one file), else None.

    Work in Python on such a table is worth a shuffle; a table of many splits is not moved.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return want if df._jdf.queryExecution().toRdd().getNumPartitions() < want else None
