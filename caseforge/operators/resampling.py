"""Folds as rows: every split is a column value, so one plan serves all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .order import placed


def hash_order(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def stratified_splits(df: DataFrame, key: str, label: str, n_splits: int = 50, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split, key, label, role`` (0 train, 1 validation): of each class in each split the share with the least hashes."""
    s = df.select(key, label).crossJoin(df.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("split")).hint("broadcast"))
    by = Window.partitionBy("split", label)
    at = F.row_number().over(by.orderBy(hash_order(seed, "split", key), key))
    quota = F.round(F.count("*").over(by) * share)
    return s.withColumn("_at", at).withColumn("role", (F.col("_at") <= quota).cast("int")).select("split", key, label, "role")


def fold_index(df: DataFrame, key: str, usable: Column) -> DataFrame:
    """Place of each usable key in their order from 0, -1 for the rest; ``order.placed``, so no task sees all keys."""
    at = placed(df.withColumn("_u", usable), F.col(key), keys=("_u",), name="_place")
    return at.withColumn("fold", F.when(F.col("_u"), F.col("_place")).otherwise(-1)).drop("_u", "_place")


def leave_one_out(df: DataFrame, fold: str) -> DataFrame:
    """``held_out`` fold with every row that trains for it."""
    folds = df.select(F.col(fold).alias("held_out")).distinct()
    return df.join(folds, F.col(fold) != F.col("held_out"))


def left_out_sums(df: DataFrame, fold: str, values: list[str]) -> DataFrame:
    """``held_out, n`` and the sum of each of ``values`` over the rows that train for it, those of all other folds: the whole less the fold, so no pair of rows is made. A fold without others has nulls."""
    whole = df.agg(F.count("*").alias("_n"), *(F.sum(v).alias(f"_all_{v}") for v in values))
    own = df.groupBy(F.col(fold).alias("held_out")).agg(F.count("*").alias("_own"), *(F.sum(v).alias(f"_own_{v}") for v in values))
    n = F.col("_n") - F.col("_own")
    less = lambda v: F.when(n > 0, F.coalesce(f"_all_{v}", F.lit(0)) - F.coalesce(f"_own_{v}", F.lit(0)))
    return own.crossJoin(F.broadcast(whole)).select("held_out", n.alias("n"), *(less(v).alias(v) for v in values))


def contiguous_folds(df: DataFrame, order: str, n_folds: int = 3) -> DataFrame:
    """Blocks in order; the last takes the remainder (all rows, if they are fewer than the folds). Sizes come from one count, places from ranges of the rows."""
    each = max(1, df.count() // n_folds)
    at = placed(df, F.col(order), name="_place")
    return at.withColumn("fold", F.least(F.floor(F.col("_place") / each), F.lit(n_folds - 1)).cast("int")).drop("_place")


def stratified_folds(df: DataFrame, key: str, label: str, n_folds: int = 3, seed: int = 42) -> DataFrame:
    """Rows of each class dealt in hash order, so folds differ by one row a class at most."""
    at = placed(df, hash_order(seed, key), F.col(key), keys=(label,), name="_place")
    return at.withColumn("fold", (F.col("_place") % n_folds).cast("int")).drop("_place")


def fold_roles(splits: DataFrame, key: str) -> DataFrame:
    """``key, roles`` for ``vectors.knn_folds``: of each split 0 where the row trains, 1 where it is held out."""
    return splits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("split", "role"))), lambda x: x["role"]).alias("roles"))


def nested_roles(splits: DataFrame, key: str, label: str, inner: int = 3, seed: int = 7) -> DataFrame:
    """``key, roles`` with ``inner + 1`` folds for each split (numbered from 0): the outer one, then the inner ones over its training rows.

    An inner fold holds its share of each class of the training rows out, by hash order, and leaves the outer held-out rows out (2).
    """
    by = Window.partitionBy("split", "role", label).orderBy(hash_order(seed, "split", key), key)
    s = splits.withColumn("_inner", (F.row_number().over(by) - 1) % inner)
    folds = F.array(F.col("role"), *(F.when(F.col("role") == 1, 2).otherwise((F.col("_inner") == j).cast("int")) for j in range(inner)))
    return s.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("split", folds.alias("folds")))), lambda x: x["folds"])).alias("roles"))


def subsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the least hashes: the same ones whatever the partitioning."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def class_balance(splits: DataFrame, label: str) -> DataFrame:
    return splits.groupBy("split", "role", label).agg(F.count("*").alias("n"))


def digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``rows, low, high`` that two runs share if they gave the same rows, in any order and partitioning.

    Each row is hashed twice with its columns in the order of their names; hashes are added up as whole numbers of 32 bits, which no order of addition changes,
    so rows that repeat count as often as they are. Doubles count by their digits: minus zero as zero, NaN as NaN. Two tables that differ agree by chance in about 2^-64 of the cases.
    """
    names = sorted(columns or df.columns)
    row = [F.to_json(F.struct(F.col(f"`{n}`")), {"ignoreNullFields": "false"}) if not isinstance(df.schema[n].dataType, AtomicType) else F.col(f"`{n}`") for n in names]
    # A hash of nulls is its seed: which columns are null goes into the hash, too.
    nulls = F.concat(*(F.col(f"`{n}`").isNull().cast("string") for n in names)) if names else F.lit("")
    a, b = F.xxhash64(nulls, *row), F.xxhash64(F.lit("again"), nulls, *row)
    half = lambda h: (F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32)))
    (al, ah), (bl, bh) = half(a), half(b)
    return df.agg(F.count("*").alias("rows"), F.xxhash64(F.coalesce(al, F.lit(0)), F.coalesce(ah, F.lit(0))).alias("low"), F.xxhash64(F.coalesce(bl, F.lit(0)), F.coalesce(bh, F.lit(0))).alias("high"))


def run_twice(make: Callable[[int], DataFrame], partitions: tuple[int, ...] = (3, 7)) -> DataFrame:
    """``run, rows, low, high, same``: the digests of what ``make`` gives under different numbers of partitions, and whether they agree with the first."""
    out = None
    for k, n in enumerate(partitions):
        one = digest(make(n)).withColumn("run", F.lit(k))
        out = one if out is None else out.unionByName(one)
    first = out.filter("run = 0").select(*(F.col(c).alias(f"_{c}") for c in ("rows", "low", "high")))
    same = (F.col("rows") == F.col("_rows")) & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
    return out.crossJoin(F.broadcast(first)).select("run", "rows", "low", "high", same.alias("same"))
