"""Places, ranks, running sums and last values in the order of a whole table, with no task that sees all rows.

A prefix scan in two passes. Rows are range-partitioned by the order and sorted within each range, where each row gets
its place or the sum so far; the ranges are kept in the shared checkpoint folder, for a second run would cut them elsewhere.
Then one number per range comes to the driver, the ranges before are added up there, and a broadcast of as
many rows as there are ranges brings each row's offset. Rows that tie in the order are told apart by a hash of the
row, rows alike in all columns by where they were read, so a value that a third of all rows hold spans ranges.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART, AT, SO_FAR, BEFORE, FIRST = "__scan_range", "__scan_at", "__scan_so_far", "__scan_before", "__scan_first"


def use_shared_folder(spark: SparkSession) -> None:
    """The checkpoint folder that the cluster names; one of its own only where all runs on this machine."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="caseforge-checkpoint-"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut there."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def n_ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _sorted_ranges(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    tied = df.withColumns({"__scan_tie": F.xxhash64(*_columns(plain)), "__scan_read": F.monotonically_increasing_id()})
    by = [*order, F.col("__scan_tie"), F.col("__scan_read")]
    return tied.repartitionByRange(ranges or n_ranges(df.sparkSession), *by).sortWithinPartitions(*by).drop("__scan_tie", "__scan_read")


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with their range and their place within it."""
    return df.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})


def _offsets(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def placed(df: DataFrame, *order: Column, keys: tuple[str, ...] = (), name: str = "place", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place from 0, among the rows that share its ``keys``."""
    spark = df.sparkSession
    r = kept(_numbered(_sorted_ranges(df, [*_columns(list(keys)), *order], ranges)))
    before, rows = 0, []
    for size in sorted(r.groupBy(PART).agg(F.count("*").alias("n")).collect()):
        rows.append((size[PART], before))
        before += size["n"]
    whole = r.join(_offsets(spark, rows, f"{PART} int, {BEFORE} long"), PART).withColumn(name, F.col(BEFORE) + F.col(AT))
    if keys:
        first = whole.groupBy(*_columns(list(keys))).agg(F.min(name).alias(FIRST))
        whole = _joined(whole, first, list(keys)).withColumn(name, F.col(name) - F.col(FIRST))
    return whole.select(*_columns(df.columns), name)


def _joined(df: DataFrame, of_key: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns that ``of_key`` has for each key; null keys are keys."""
    right = of_key.select(*(F.col(f"`{k}`").alias(f"__scan_key_{i}") for i, k in enumerate(keys)), *(F.col(c) for c in of_key.columns if c not in keys))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__scan_key_{i}")) for i, k in enumerate(keys)]
    return df.join(right, same).drop(*(f"__scan_key_{i}" for i in range(len(keys))))


def running(df: DataFrame, value: str, *order: Column, keys: tuple[str, ...] = (), name: str = "before", ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row, among those that share its ``keys``.

    Whole numbers add up exactly; doubles carry the rounding of the sum over all keys. A null counts as 0.
    """
    spark = df.sparkSession
    whole_numbers = isinstance(df.schema[value].dataType, T.IntegralType)
    kind, arrow = (T.LongType(), pa.int64()) if whole_numbers else (T.DoubleType(), pa.float64())
    schema = T.StructType([*df.schema.fields, T.StructField(SO_FAR, kind)])
    at = df.columns.index(value)

    def summed(batches):
        total = 0
        for b in batches:
            x = b.column(at).cast(arrow).fill_null(0).to_numpy(zero_copy_only=False)
            run = np.concatenate([[total], total + np.cumsum(x)])
            total = run[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run[:-1], arrow)], names=[*b.schema.names, SO_FAR])

    r = kept(_numbered(_sorted_ranges(df, [*_columns(list(keys)), *order], ranges).mapInArrow(summed, schema)))
    before, rows = 0, []
    for part in sorted(r.groupBy(PART).agg(F.sum(F.coalesce(F.col(f"`{value}`").cast(kind), F.lit(0).cast(kind))).alias("n")).collect()):
        rows.append((part[PART], before))
        before += part["n"]
    whole = r.join(_offsets(spark, [(p, int(b) if whole_numbers else float(b)) for p, b in rows], f"{PART} int, {BEFORE} {kind.simpleString()}"), PART).withColumn(name, F.col(BEFORE) + F.col(SO_FAR))
    if keys:
        first = whole.groupBy(*_columns(list(keys))).agg(F.min_by(name, F.struct(PART, AT)).alias(FIRST))
        whole = _joined(whole, first, list(keys)).withColumn(name, F.col(name) - F.col(FIRST))
    return whole.select(*_columns(df.columns), name)


def filled(df: DataFrame, value: str, *order: Column, name: str = "last", ranges: int | None = None) -> DataFrame:
    """``df`` with the last ``value`` that isn't null up to each row, null before the first."""
    spark = df.sparkSession
    kind = df.schema[value].dataType
    schema = T.StructType([*df.schema.fields, T.StructField(SO_FAR, kind)])
    at = df.columns.index(value)

    def fill(batches):
        last = None
        for b in batches:
            x = b.column(at)
            place = np.maximum.accumulate(np.where(x.is_valid().to_numpy(zero_copy_only=False), np.arange(1, len(x) + 1), 0))
            seen = pa.concat_arrays([pa.array([last], x.type), x]).take(pa.array(place))
            last = seen[-1].as_py() if len(seen) else last
            yield pa.RecordBatch.from_arrays([*b.columns, seen], names=[*b.schema.names, SO_FAR])

    r = kept(_numbered(_sorted_ranges(df, list(order), ranges).mapInArrow(fill, schema)))
    last, rows = None, []
    for part in sorted(r.groupBy(PART).agg(F.max_by(SO_FAR, AT).alias("x")).collect(), key=lambda p: p[PART]):
        rows.append((part[PART], last))
        last = part["x"] if part["x"] is not None else last
    offsets = _offsets(spark, rows, f"{PART} int, {BEFORE} {kind.simpleString()}")
    return r.join(offsets, PART).withColumn(name, F.coalesce(SO_FAR, BEFORE)).select(*_columns(df.columns), name)


def average_ranks(df: DataFrame, value: Column, keys: tuple[str, ...] = (), name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` with the average rank of ``value`` from 1 among the rows that share its ``keys``; ties share theirs.

    Counts per distinct value are what is ordered: rows that tie are one row there.
    """
    valued = df.withColumn("__scan_value", value)
    counts = valued.groupBy(*_columns(list(keys)), "__scan_value").agg(F.count("*").alias("__scan_n"))
    before = running(counts, "__scan_n", F.col("__scan_value"), keys=keys, name="__scan_less", ranges=ranges)
    ranks = before.withColumn(name, F.col("__scan_less") + (F.col("__scan_n") + 1) / 2).drop("__scan_less", "__scan_n")
    return _joined(valued, ranks, [*keys, "__scan_value"]).select(*_columns(df.columns), name)
