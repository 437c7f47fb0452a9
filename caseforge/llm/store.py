"""Intermediate results that outlive a lost executor."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType


def use_shared_folder(spark: SparkSession) -> None:
    """Keep the checkpoint folder the cluster names; set one only where none is named and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="caseforge-checkpoint-"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle and checkpoint files of plans that nothing refers to any more.

    It learns of them by the driver's garbage collection, which may be far off on a driver that only plans. Checkpoint
    files go only where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    for pause in (1.0, 0.5):  # threads and events of the tasks just ended hold on to a plan for a moment
        gc.collect()
        for _ in range(2):  # what the first finds unused still refers to what the second then drops
            spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def saved(df: DataFrame, let_go: bool = True) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut there and, at once if ``let_go``, what it was made from let go."""
    spark = df.sparkSession
    use_shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df  # else its shuffle files are still referred to
    if let_go:
        release(spark)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have: the given ones, with ``_`` added as often as need be."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def row_number(df: DataFrame) -> Column:
    """A 64-bit hash of a row's plain columns: the same for rows that are alike, whatever the partitioning."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, AtomicType)))
