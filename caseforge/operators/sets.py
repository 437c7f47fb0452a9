"""Set comparison of string arrays and of tables' columns and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_f1(truth: Column | str, predicted: Column | str) -> Column:
    """F1 of two arrays as sets: 1 if both are empty, 0 if one is."""
    t, p = F.array_distinct(truth), F.array_distinct(predicted)
    both = F.size(F.array_intersect(t, p))
    return F.when((F.size(t) == 0) & (F.size(p) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(t) + F.size(p)))


def in_every(df: DataFrame, item: str, fold: str) -> DataFrame:
    """Items that every fold has."""
    folds = df.agg(F.countDistinct(fold).alias("_folds"))
    return df.groupBy(item).agg(F.countDistinct(fold).alias("_n")).crossJoin(F.broadcast(folds)).filter("_n = _folds").select(item)


def compared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key with whether it is in a, in b or both."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full").select(key, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left_only").otherwise("right_only").alias("side"))


def compared_columns(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    return {"left_only": [c for c in a.columns if c not in b.columns], "right_only": [c for c in b.columns if c not in a.columns]}


def assert_disjoint(**views: list[str]) -> None:
    """Raises if a column stands in two views or a target in any."""
    seen: dict[str, str] = {}
    for view, cols in views.items():
        for c in cols:
            if c.startswith("target_"):
                raise ValueError(f"{view} holds the target {c}")
            if c in seen:
                raise ValueError(f"{c} is in {seen[c]} and {view}")
            seen[c] = view


def equal_columns(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """``a, b, differ, duplicate, leak`` of each pair of columns: in how many rows they differ, whether in none, and whether one of two alike is the target. One pass; nulls are equal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    differ = lambda a, b: F.sum((~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).cast("long"))
    one = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(differ(a, b), F.lit(0)).alias("differ")) for a, b in pairs)).alias("x"))
    out = one.select(F.explode("x").alias("x")).select("x.*").withColumn("duplicate", F.col("differ") == 0)
    return out.withColumn("leak", F.col("duplicate") & (F.col("a").eqNullSafe(F.lit(target)) | F.col("b").eqNullSafe(F.lit(target))))
