"""Aggregates of series, columns, folds and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_stats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Count, ends, range, mean, change and slope per step of each series' non-null values in its order.

    First and last come from ``min_by`` and ``max_by``, so a long series is summed where it lies.
    """
    at = F.struct(*order)
    v = df.filter(F.col(value).isNotNull())
    s = v.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean")
    )
    return s.withColumn("delta", F.col("last") - F.col("first")).withColumn("slope", F.col("delta") / F.greatest(F.col("n") - 1, F.lit(1)))


def last_match(df: DataFrame, keys: list[str], order: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """Per name the value of the last row that its condition holds for."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(value, F.when(c, at)).alias(n) for n, c in wanted.items()))


def missing_rates(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """One row per column (and key): share of nulls; one pass over the rows."""
    one = df.groupBy(*keys).agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return one.unpivot(list(keys), columns, "column", "missing_rate")


def kept_columns(df: DataFrame, columns: list[str], most: float = 0.5) -> list[str]:
    rates = missing_rates(df, columns).collect()
    return [c for c in columns if next(r["missing_rate"] for r in rates if r["column"] == c) <= most]


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def all_null(*columns: str) -> Column:
    return F.coalesce(*(F.col(c).cast("string") for c in columns)).isNull()


def summarised(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population deviation, range and number of valid values of each metric over folds; NaN counts as missing."""
    long = df.unpivot(keys, metrics, "metric", "value").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count("value").alias("n_valid")
    )


def confusion(df: DataFrame, truth: str, predicted: str, labels: list, keys: list[str] = ()) -> DataFrame:
    """Long confusion matrix on fixed labels: counts and shares of the true row (0 for an empty row)."""
    spark = df.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in labels for b in labels], f"truth {df.schema[truth].dataType.simpleString()}, predicted {df.schema[predicted].dataType.simpleString()}")
    grid = F.broadcast(pairs) if not keys else df.select(*keys).distinct().crossJoin(F.broadcast(pairs))
    n = df.groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    m = grid.join(n, [*keys, "truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy(*keys, "truth"))
    return m.withColumn("share", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label, the smallest among equals."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias(label), F.max("_n").alias("votes"))


def pearson(x: str, y: str) -> Column:
    """Correlation of the rows that have both; null if either doesn't vary (``corr`` would divide by zero).

    Whether it varies is told by its ends: merged in parts, the deviation of equal values needn't be 0.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    varies = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    return F.when(varies, F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys)))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal bins between the least and the largest value; the last bin is closed. The range is one row."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.crossJoin(F.broadcast(ends)).filter(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
