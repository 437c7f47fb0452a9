"""Attribution of neighbour models, empirical p-values and kernel density signals."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import by_thresholds, reveal_list


def distance_attribution(nearest: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, column, value``: absolute difference of a row from its nearest row ``(q, n)``; one-hot and indicator columns average in their family."""
    left = rows.select(F.col(key).alias("q"), *(F.col(c).cast("double").alias(f"a_{i}") for i, c in enumerate(columns)))
    right = rows.select(F.col(key).alias("n"), *(F.col(c).cast("double").alias(f"b_{i}") for i, c in enumerate(columns)))
    j = nearest.select("q", "n").join(left, "q").join(right, "n")
    parts = F.array(*(F.struct(F.lit(c.split("__")[0]).alias("column"), F.abs(F.col(f"a_{i}") - F.col(f"b_{i}")).alias("d")) for i, c in enumerate(columns)))
    return j.select("q", F.explode(parts).alias("x")).groupBy("q", "x.column").agg(F.avg("x.d").alias("value"))


def max_normalised(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top), keys).withColumn(value, F.coalesce(F.try_divide(value, "_top"), F.lit(0.0))).drop("_top")


def permutation_p(df: DataFrame, keys: list[str], value: str, rounds: int = 500) -> DataFrame:
    """P-value and z against the pooled null of ``rounds`` permutations.

    Permuting keeps the multiset, so the pooled null holds each value ``rounds`` times and the
    p-value is a rank; counts per distinct value give it without drawing anything.
    """
    by = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    at_least = F.sum("_n").over(w.orderBy(F.col(value).desc()))
    ranks = by.select(*keys, value, ((1 + rounds * at_least) / (1 + rounds * F.sum("_n").over(w))).alias("p_value"))
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(ranks, [*keys, value]).join(F.broadcast(stats), keys).withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.col("_m"), "_s"), F.lit(0.0))).drop("_m", "_s")


def conditions(value: Column, z: Column, p: Column) -> Column:
    """The five forms of a descriptor: raw, z, z gated, 1 - p, 1 - p gated."""
    gate = lambda x: F.when(p < 0.05, x).otherwise(0.0)
    return F.array(*(F.struct(F.lit(n).alias("condition"), v.cast("double").alias("value")) for n, v in (("raw", value), ("z", z), ("z_gated", gate(z)), ("p", 1 - p), ("p_gated", gate(1 - p)))))


def fuzzy_p(x: np.ndarray, memory: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(((x[:, None, :] - memory[None]) ** 2).sum(2))
    return q[np.argsort(d, 1, kind="stable")[:, :k]].mean(1)


def exact_shapley(rows: DataFrame, memory: np.ndarray, q: np.ndarray, background: np.ndarray, k: int = 3) -> DataFrame:
    """``id, values``: Shapley values of the fuzzy neighbour vote over all subsets of a few features.

    ``rows(id, v)`` may be any number; memory and background are model parameters, small and fixed.
    """
    d = memory.shape[1]
    subsets = [s for n in range(d + 1) for s in combinations(range(d), n)]
    weight = [factorial(n) * factorial(d - n - 1) / factorial(d) for n in range(d)]

    def explain(batches):
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                x = np.asarray(v)
                value = {}
                for s in subsets:
                    mixed = background.copy()
                    mixed[:, list(s)] = x[list(s)]
                    value[s] = float(fuzzy_p(mixed, memory, q, k).mean())
                out.append([sum(weight[len(s)] * (value[tuple(sorted((*s, i)))] - value[s]) for s in subsets if i not in s) for i in range(d)])
            yield pd.DataFrame({"id": pdf["id"], "values": out})

    return rows.mapInPandas(explain, "id long, values array<double>")


def kdm_signals(sums: DataFrame) -> DataFrame:
    """Signals of a kernel density classifier from the sums over all prototypes (``vectors.kernel_sums``).

    Total entropy is that of the mean label, aleatoric the mean of the prototypes' label entropies, epistemic the rest.
    """
    p, aleatoric = F.try_divide("sy", "s"), F.try_divide("kh", "s")
    h = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    total = h(p) + h(1 - p)
    return sums.select(
        "q", p.alias("p"), total.alias("total_entropy"), aleatoric.alias("aleatoric"), (total - aleatoric).alias("epistemic"),
        F.try_subtract(F.log("s"), F.try_divide("klogk", "s")).alias("weight_entropy"), F.log(F.try_divide(F.col("s") ** 2, "s2")).alias("log_ess"),
        F.try_divide("top", "s").alias("max_weight"), F.log("s").alias("log_marginal"),
    )


def explained(attribution: DataFrame, variables: list[str], thresholds: dict[str, tuple[float, ...]]) -> DataFrame:
    """``q``, the relevance class of each variable (0 to 3) and ``reveal``, the sections that they call for.

    ``attribution(q, column, value)`` is scaled by each variable's largest value over all rows and cut by its thresholds.
    """
    scaled = max_normalised(attribution, ["column"], "value")
    cut = F.coalesce(*(F.when(F.col("column") == v, by_thresholds("value", *thresholds[v])) for v in variables))
    wide = scaled.groupBy("q").agg(*(F.max(F.when(F.col("column") == v, cut)).alias(v) for v in variables))
    return wide.withColumn("reveal", reveal_list({v: F.col(v) for v in variables}))


def seeds_averaged(runs: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Over ``seed``: mean probability, its deviation, the vote at 0.5 (no at a draw) and the share of seeds that agree with it."""
    yes = F.avg((F.col(p) >= 0.5).cast("double"))
    m = runs.groupBy(*keys).agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("deviation"), yes.alias("_yes"))
    return m.select(*keys, "mean", "deviation", (F.col("_yes") > 0.5).cast("int").alias("vote"), F.greatest("_yes", 1 - F.col("_yes")).alias("agreement"))
