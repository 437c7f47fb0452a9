"""Decision trees per key (split, configuration), grown as a plan over counts.

A level of all trees is one aggregation: rows per key, node, feature and distinct value, running
weights of the target's levels along each feature, and the best midpoint of each node. Rows are
routed by a join with the splits. The target takes few levels (classes, or grades with numbers),
so Gini, squared and absolute error all follow from the levels' weights.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import kept


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def _impurity(w: list[Column], levels: list[float], criterion: str) -> Column:
    """Total impurity of a node with these weights of the levels."""
    if criterion == "gini":
        return _sum(w) - F.coalesce(F.try_divide(_sum([x * x for x in w]), _sum(w)), F.lit(0.0))
    if criterion == "squared":
        return _sum([x * v * v for x, v in zip(w, levels)]) - F.coalesce(F.try_divide(_sum([x * v for x, v in zip(w, levels)]) ** 2, _sum(w)), F.lit(0.0))
    if criterion == "absolute":
        return F.least(*(_sum([x * abs(v - m) for x, v in zip(w, levels)]) for m in levels))
    raise ValueError(f"unknown criterion {criterion}")


def weighted(rows: DataFrame, keys: list[str], level: str, balanced: bool, n_levels: int) -> DataFrame:
    """``rows`` with ``_w``: 1, or so that the levels that occur in a key weigh alike."""
    if not balanced:
        return rows.withColumn("_w", F.lit(1.0))
    n = rows.groupBy(*keys).agg(*(F.sum((F.col(level) == k).cast("long")).alias(f"_n{k}") for k in range(n_levels)))
    total, present = _sum([F.col(f"_n{k}") for k in range(n_levels)]), _sum([(F.col(f"_n{k}") > 0).cast("int") for k in range(n_levels)])
    own = F.element_at(F.array(*(F.col(f"_n{k}") for k in range(n_levels))), F.col(level) + 1)
    return rows.join(n.withColumn("_total", total).withColumn("_present", present), keys).withColumn("_w", F.col("_total") / (F.col("_present") * own)).select(*rows.columns, "_w")


def best_splits(rows: DataFrame, keys: list[str], features: list[str], level: str, levels: list[float], criterion: str, min_leaf: int) -> DataFrame:
    """``keys, node, feature, tau, gain``: of each node the split that gains most, then the first feature, the least threshold."""
    k = range(len(levels))
    long = rows.select(*keys, "node", level, "_w", F.posexplode(F.array(*(F.col(f).cast("double") for f in features))).alias("feature", "v"))
    at = [*keys, "node", "feature"]
    by = long.groupBy(*at, "v").agg(F.count("*").alias("n"), *(F.sum(F.when(F.col(level) == i, F.col("_w")).otherwise(0.0)).alias(f"w{i}") for i in k))
    every = Window.partitionBy(*at)
    up = every.orderBy("v")
    c = by.select(*at, "v", F.lead("v").over(up).alias("nxt"), F.sum("n").over(up).alias("n"), F.sum("n").over(every).alias("all"), *(F.sum(f"w{i}").over(up).alias(f"l{i}") for i in k), *(F.sum(f"w{i}").over(every).alias(f"t{i}") for i in k))
    left, total = [F.col(f"l{i}") for i in k], [F.col(f"t{i}") for i in k]
    right = [t - x for t, x in zip(total, left)]
    gain = _impurity(total, levels, criterion) - _impurity(left, levels, criterion) - _impurity(right, levels, criterion)
    can = c.filter((F.col("nxt").isNotNull()) & (F.col("n") >= min_leaf) & (F.col("all") - F.col("n") >= min_leaf))
    can = can.select(*keys, "node", "feature", ((F.col("v") + F.col("nxt")) / 2).alias("tau"), F.round(gain, 9).alias("gain")).filter("gain > 0")
    best = can.groupBy(*keys, "node").agg(F.max_by(F.struct("feature", "tau", "gain"), F.struct("gain", -F.col("feature"), -F.col("tau"))).alias("s"))
    return best.select(*keys, "node", "s.*")


def routed(rows: DataFrame, splits: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``rows(node)`` one level further down where their node is split; left is 2 n, right 2 n + 1."""
    x = F.element_at(F.array(*(F.col(f).cast("double") for f in features)), F.col("feature") + 1)
    j = rows.join(splits.select(*keys, "node", "feature", "tau"), [*keys, "node"], "left")
    to = F.when(F.col("tau").isNull(), F.col("node")).otherwise(2 * F.col("node") + (x > F.col("tau")).cast("long"))
    return j.withColumn("node", to).select(*rows.columns)


def grown(train: DataFrame, keys: list[str], features: list[str], level: str, levels: list[float], criterion: str = "gini", depth: int = 2, max_leaves: int | None = None, min_leaf: int = 1, balanced: bool = False) -> DataFrame:
    """The splits of a tree for each key: ``keys, node, feature, tau, gain``; the root is node 1.

    ``level`` is the place of a row's target in ``levels``. With ``max_leaves`` the splits are taken
    best first, as far as their parents are.
    """
    rows = weighted(train, keys, level, balanced, len(levels)).withColumn("node", F.lit(1).cast("long"))
    splits = None
    for d in range(depth):
        best = kept(best_splits(rows, keys, features, level, levels, criterion, min_leaf))
        splits = best if splits is None else splits.unionByName(best)
        if d + 1 < depth:
            # Rows whose node isn't split are done.
            rows = routed(rows.join(best.select(*keys, "node"), [*keys, "node"], "left_semi"), best, keys, features)
    if max_leaves is None:
        return splits
    chosen = splits.filter("node = 1")
    for _ in range(max_leaves - 2):
        below = chosen.select(*keys, F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"))
        open_ = splits.join(below, [*keys, "node"]).join(chosen.select(*keys, "node"), [*keys, "node"], "left_anti")
        best = open_.groupBy(*keys).agg(F.max_by(F.struct("node", "feature", "tau", "gain"), F.struct("gain", -F.col("node"))).alias("s"))
        chosen = chosen.unionByName(best.select(*keys, "s.*"))
    return chosen


def leaves_of(rows: DataFrame, splits: DataFrame, keys: list[str], features: list[str], depth: int) -> DataFrame:
    """``rows`` with the ``node`` of the leaf that they come to."""
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    for _ in range(depth):
        rows = routed(rows, splits, keys, features)
    return rows


def predicted(train: DataFrame, rows: DataFrame, splits: DataFrame, keys: list[str], features: list[str], level: str, levels: list[float], criterion: str = "gini", depth: int = 2, balanced: bool = False) -> DataFrame:
    """``rows`` with ``predicted``: the place of the heaviest level, or the mean or median, of the leaf's training rows."""
    k = range(len(levels))
    own = leaves_of(weighted(train, keys, level, balanced, len(levels)), splits, keys, features, depth)
    w = own.groupBy(*keys, "node").agg(*(F.sum(F.when(F.col(level) == i, F.col("_w")).otherwise(0.0)).alias(f"w{i}") for i in k))
    ws = [F.col(f"w{i}") for i in k]
    if criterion == "gini":
        # Of equal weights the least level; rounded, for sums of the same weights may differ in their last digit.
        said = F.array_max(F.array(*(F.struct(F.round(x, 9).alias("w"), F.lit(-i).alias("i")) for i, x in enumerate(ws))))["i"] * -1
    elif criterion == "squared":
        said = _sum([x * v for x, v in zip(ws, levels)]) / _sum(ws)
    else:
        order = sorted(k, key=lambda i: levels[i])
        said = F.coalesce(*(F.when(2 * _sum([ws[j] for j in order[: n + 1]]) >= _sum(ws) - 1e-9, F.lit(float(levels[i]))) for n, i in enumerate(order)))
    return leaves_of(rows, splits, keys, features, depth).join(w.select(*keys, "node", said.alias("predicted")), [*keys, "node"], "left").drop("node")


def thresholds(splits: DataFrame, keys: list[str]) -> DataFrame:
    """Of trees on one feature the thresholds in order, and whether the tree has three leaves (five nodes)."""
    t = splits.groupBy(*keys).agg(F.array_sort(F.collect_list("tau")).alias("taus"), F.count("*").alias("n"))
    return t.select(*keys, "taus", (F.col("n") == 2).alias("three_leaves"))


def meta_thresholds(df: DataFrame, split: str, role: str, signal: str, level: str, n_levels: int = 3, sweep: int = 50) -> DataFrame:
    """One row: two thresholds averaged over splits, the sign of the signal's direction and how often trees fell short.

    A balanced tree of depth 2 per split gives its two least thresholds. With one only, the second is the 67th
    percentile or half-way from the first to the largest value, whichever is larger; with none both are the 33rd and 67th percentiles.
    The direction is the majority of the signs of Spearman's correlation along a sweep of the signal; trees whose
    predictions don't vary have no say.
    """
    from .metrics import spearman

    levels = [float(i) for i in range(n_levels)]
    train = df.filter(F.col(role) == 0)
    splits = grown(train, [split], [signal], level, levels, depth=2, balanced=True)
    stats = train.groupBy(split).agg(F.percentile(signal, 0.33).alias("p33"), F.percentile(signal, 0.67).alias("p67"), F.max(signal).alias("top"))
    t = stats.join(thresholds(splits, [split]), split, "left").withColumn("n", F.coalesce(F.size("taus"), F.lit(0)))
    t1 = F.when(F.col("n") >= 1, F.get("taus", 0)).otherwise(F.col("p33"))
    t2 = F.when(F.col("n") >= 2, F.get("taus", 1)).when(F.col("n") == 1, F.greatest("p67", F.get("taus", 0) + (F.col("top") - F.get("taus", 0)) / 2)).otherwise(F.col("p67"))
    ends = df.agg(F.min(signal).alias("lo"), F.max(signal).alias("hi"))
    steps = train.select(split).distinct().crossJoin(F.broadcast(ends)).select(split, F.explode(F.sequence(F.lit(0), F.lit(sweep - 1))).alias("i"), "lo", "hi")
    steps = steps.select(split, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (sweep - 1)).alias(signal))
    rho = spearman(predicted(train, steps, splits, [split], [signal], level, levels, balanced=True), [split], "i", "predicted")
    varies = F.col("rho").isNotNull() & ~F.isnan("rho")
    each = t.select(split, t1.alias("t1"), t2.alias("t2"), (F.col("n") < 2).cast("long").alias("short")).join(rho, split, "left")
    return each.agg(
        F.avg("t1").alias("threshold_1"),
        F.avg("t2").alias("threshold_2"),
        F.signum(F.coalesce(F.sum(F.when(varies, F.signum("rho"))), F.lit(0.0))).cast("int").alias("direction"),
        F.sum("short").alias("fallbacks"),
        F.sum((~varies).cast("long")).alias("degenerate"),
        F.sum((varies & (F.abs("rho") < 0.1)).cast("long")).alias("not_monotone"),
    )


def out_of_bag_votes(df: DataFrame, split: str, role: str, key: str, signals: list[str], level: str, n_levels: int = 3, depth: int = 3) -> DataFrame:
    """``key, vote, votes``: the majority of the trees that have a row in validation, the least level among equals."""
    from .aggregates import majority

    levels = [float(i) for i in range(n_levels)]
    train, held = df.filter(F.col(role) == 0), df.filter(F.col(role) == 1)
    splits = grown(train, [split], signals, level, levels, depth=depth, balanced=True)
    said = predicted(train, held, splits, [split], signals, level, levels, depth=depth, balanced=True)
    return majority(said.select(key, F.col("predicted").alias("vote")), [key], "vote")
