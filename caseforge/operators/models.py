"""Neighbour votes, fusion, risk scores, threshold search and selection."""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trees

EPS = 1e-10


def inverse_distance(d: Column | str) -> Column:
    return 1 / F.greatest(F.col(d) if isinstance(d, str) else d, F.lit(EPS))


def knn_vote(edges: DataFrame, keys: list[str], y: str = "y", dist: str = "dist", weighted: bool = False) -> DataFrame:
    """Probability by vote. With distance weights, neighbours at distance 0 take all the weight."""
    if not weighted:
        return edges.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("p"))
    exact = F.col(dist) == 0
    w = F.try_divide(F.lit(1.0), F.col(dist))
    e = edges.groupBy(*keys).agg(
        F.avg(F.when(exact, F.col(y).cast("double"))).alias("_exact"), F.try_divide(F.sum(w * F.col(y)), F.sum(w)).alias("_near")
    )
    return e.select(*keys, F.coalesce("_exact", "_near").alias("p"))


def fuzzy_vote(edges: DataFrame, keys: list[str], y: str = "y", certainty: str = "c", dist: str = "dist", weighted: bool = False, serving: bool = False, k: Column | None = None) -> DataFrame:
    """Each neighbour says ``0.5 + c * (y - 0.5)``. The serving variant weighs by ``1 / (d + eps)``, and only if ``k > 1``."""
    q = 0.5 + F.col(certainty) * (F.col(y) - 0.5)
    w = F.lit(1.0)
    if weighted:
        w = 1 / (F.col(dist) + EPS) if serving else inverse_distance(dist)
        if serving and k is not None:
            w = F.when(k > 1, w).otherwise(1.0)
    return edges.groupBy(*keys).agg((F.sum(w * q) / (F.sum(w) + (0 if serving else EPS))).alias("p"))


#: The neighbours, the metrics of a model grid.
GRID_KS, GRID_METRICS = (1, 3, 5, 7, 9, 11, 15, 21, 31), ("euclidean", "cosine")


def knn_grid(edges: DataFrame, ks: list[int], y: str = "y", certainty: str = "c", query: str = "q", keys: tuple[str, ...] = ()) -> DataFrame:
    """``config, keys, q, p``: every k, weighting and variant from one table of ranked edges; no configuration ranks again."""
    grid = F.broadcast(edges.sparkSession.createDataFrame([(k,) for k in ks], "k int"))
    e = edges.join(grid, F.col("rk") <= F.col("k"))
    q, w = 0.5 + F.col(certainty) * (F.col(y) - 0.5), inverse_distance("dist")
    g = e.groupBy("k", *keys, query).agg(
        F.avg(F.col(y).cast("double")).alias("standard_uniform"),
        (F.sum(w * F.col(y)) / F.sum(w)).alias("standard_distance"),
        (F.sum(q) / (F.count("*") + EPS)).alias("fuzzy_uniform"),
        (F.sum(w * q) / (F.sum(w) + EPS)).alias("fuzzy_distance"),
    )
    long = g.unpivot(["k", *keys, query], ["standard_uniform", "standard_distance", "fuzzy_uniform", "fuzzy_distance"], "kind", "p")
    return long.select(F.concat_ws("_", "kind", F.concat(F.lit("k"), F.col("k").cast("string"))).alias("config"), *keys, query, "p")


#: Folds whose roles, two bits each, one number of a code holds exactly.
FOLDS_A_NUMBER = 26
GRID_KINDS = ("standard_uniform", "standard_distance", "fuzzy_uniform", "fuzzy_distance")


def _votes(roles: np.ndarray, dist: np.ndarray, y: np.ndarray, c: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each fold: how many of the listed rows are in its memory, and the four votes of its first k, for each k; NaN where none has a say. ``roles[row, fold]``; a missing ``y`` or ``c`` is NaN."""
    held = (roles == 0).T
    place = held.cumsum(1)
    w, q = 1 / np.maximum(dist, EPS), 0.5 + c * (y - 0.5)
    each = np.stack([~np.isnan(y), np.nan_to_num(y), np.nan_to_num(w * y), w, ~np.isnan(q), np.nan_to_num(q), np.nan_to_num(w * q)])
    sums = (each[:, None] * held).cumsum(2)
    at = np.minimum((place[:, :, None] < ks).sum(1), len(dist) - 1)
    said, sy, swy, sw, told, sq, swq = sums[:, np.arange(len(held))[:, None], at]
    found = place[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.stack([sy / said, np.where(said > 0, swy / sw, np.nan), sq / (np.minimum(found[:, None], ks) + EPS), swq / (sw + EPS)])
    p[2:, told == 0] = np.nan
    return found, p


def grid_over_splits(rows: DataFrame, truth: DataFrame, splits: DataFrame, ks=GRID_KS, metrics=GRID_METRICS, wide: int | None = None) -> DataFrame:
    """``config, fold, q, y, p``: of every split the held-out rows' truth and probabilities under every configuration.

    ``rows(id, v)``, ``truth(id, y, c)``, ``splits(split, id, role)``; splits are numbered from 0. Distances are taken once for all splits: each row's
    ``wide`` neighbours among all rows, whose roles and truths the walk hands on, and a task votes from that list in every fold and configuration; neither edges
    nor votes are shuffled. What a list lacks of a fold's memory is walked over that memory itself, so the result is exact whatever ``wide`` is.
    """
    from . import vectors
    from .order import kept
    from .resampling import fold_roles

    spark, most = rows.sparkSession, max(ks)
    folds = kept(rows.filter("v is not null").select("id", "v").join(fold_roles(splits, "id"), "id").join(truth, "id"))
    shares = folds.select(F.posexplode("roles").alias("fold", "role")).groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("role") == 0).cast("long")).alias("held")).filter("held > 0").collect()
    if not shares:
        return spark.createDataFrame([], "config string, fold long, q long, y int, p double")
    held, n = {r["fold"]: r["held"] for r in shares}, max(r["n"] for r in shares)
    listed = wide or vectors.wide_enough(most, min(r["held"] / r["n"] for r in shares))
    size = folds.agg(F.max(F.size("roles"))).first()[0]
    words = [F.aggregate(F.slice("roles", x + 1, FOLDS_A_NUMBER), F.lit(0.0), lambda a, r: a * 4 + r) for x in range(0, size, FOLDS_A_NUMBER)]
    said = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("y", "c")]
    coded = folds.select("id", "v", F.array(*words, *said).alias("code"))
    k_each, whole = np.array(ks), listed >= n - 1
    enough = np.array([min(held.get(f, 0), most) for f in range(size)])
    shift = [(x // FOLDS_A_NUMBER, 2 * (min(FOLDS_A_NUMBER, size - x // FOLDS_A_NUMBER * FOLDS_A_NUMBER) - 1 - x % FOLDS_A_NUMBER)) for x in range(size)]
    word, bits = np.array([w for w, _ in shift]), np.array([b for _, b in shift])

    def asked(batches, lacking: bool):
        for q, own, dist, code in vectors.unpacked_lists(batches):
            of = np.flatnonzero((own[:-2].astype(np.int64)[word] >> bits & 3 == 1) & (enough > 0))
            if not len(of):
                continue
            if not len(dist):
                found, p = np.zeros(len(of), np.int64), np.zeros((4, len(of), len(k_each)))
            else:
                found, p = _votes(code[:, :-2].astype(np.int64)[:, word[of]] >> bits[of] & 3, dist, code[:, -2], code[:, -1], k_each)
            short = (found < enough[of]) & (not whole)
            for x in np.flatnonzero(short if lacking else ~short & (found > 0)):
                yield q, int(of[x]), own[-2], p[:, x].reshape(-1)

    def votes(batches):
        of = iter(asked(batches, False))
        while some := list(islice(of, 2000)):
            q, fold, y, p = zip(*some)
            flat = pa.array(np.concatenate(p), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int64()), pa.array(q, pa.int64()), pa.array(np.array(y), pa.float64(), from_pandas=True).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * 4 * len(k_each), pa.int32()), flat)], names=["fold", "q", "y", "p"])

    def short(batches):
        some = list(asked(batches, True))
        yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in some], pa.int64()), pa.array([x[0] for x in some], pa.int64())], names=["fold", "q"])

    out, memory = None, truth.withColumnRenamed("id", "n")
    for metric in metrics:
        lists = vectors.knn_lists(coded, listed, metric)
        names = F.array(*(F.lit(f"{kind}_k{k}_{metric}") for kind in GRID_KINDS for k in ks))
        p = lists.mapInArrow(votes, "fold long, q long, y int, p array<double>").select("fold", "q", "y", F.explode(F.arrays_zip(names.alias("config"), F.col("p").alias("p"))).alias("x"))
        parts = [p.select("x.config", "fold", "q", "y", "x.p")]
        few = None if whole else kept(lists.mapInArrow(short, "fold long, q long"))
        for r in [] if few is None else few.select("fold").distinct().orderBy("fold").collect():
            lacking = folds.join(few.filter(F.col("fold") == r["fold"]).select(F.col("q").alias("id")), "id", "left_semi")
            edges = vectors.knn(folds.filter(F.get("roles", F.lit(r["fold"])) == 0), most, metric, lacking).join(memory, "n")
            one = knn_grid(edges, list(ks)).join(lacking.select(F.col("id").alias("q"), F.col("y").cast("int").alias("y")), "q")
            parts.append(one.select(F.concat_ws("_", "config", F.lit(metric)).alias("config"), F.lit(r["fold"]).cast("long").alias("fold"), "q", "y", "p"))
        out = reduce(DataFrame.unionByName, parts if out is None else [out, *parts])
    return out


def nested_probabilities(modalities: dict[str, tuple[DataFrame, dict]], truth: DataFrame, roles: DataFrame, k: int, inner: int = 3) -> DataFrame:
    """``split, id, role`` (0 inner, 1 outer) and a probability for each modality, none from a model that has seen the row.

    An inner fold's probabilities of the training rows are what a meta-model may be fitted on; those of the held-out rows come from
    models of all training rows. ``modalities`` holds rows and options of ``fuzzy_vote``.
    """
    from . import vectors

    out, memory = None, truth.withColumnRenamed("id", "n")
    for name, (rows, options) in modalities.items():
        edges = vectors.knn_folds(rows.join(roles, "id"), k).join(memory, "n")
        p = fuzzy_vote(edges, ["fold", "q"], **options).withColumnRenamed("p", name)
        out = p if out is None else out.join(p, ["fold", "q"])
    split = F.floor(F.col("fold") / (inner + 1)).cast("int")
    return out.select(split.alias("split"), F.col("q").alias("id"), (F.col("fold") % (inner + 1) == 0).cast("int").alias("role"), *modalities)


def soft_regression(edges: DataFrame, keys: list[str], target: str, dist: str = "dist", weighted: bool = False) -> DataFrame:
    w = inverse_distance(dist) if weighted else F.lit(1.0)
    return edges.groupBy(*keys).agg((F.sum(w * F.col(target)) / F.sum(w)).alias("p"))


#: The grid of the regressor on soft targets.
SOFT_KS, SOFT_METRICS = (1, 3, 5, 7, 9, 11, 13, 15, 17, 21, 25), ("euclidean", "manhattan", "cosine")


def soft_grid(edges: DataFrame, target: str, ks=SOFT_KS, query: str = "q") -> DataFrame:
    """``config, q, p``: every neighbour count and weighting of the regressor from one table of ranked edges."""
    e = edges.join(F.broadcast(edges.sparkSession.createDataFrame([(k,) for k in ks], "k int")), F.col("rk") <= F.col("k"))
    w = inverse_distance("dist")
    g = e.groupBy("k", query).agg(F.avg(target).alias("uniform"), (F.sum(w * F.col(target)) / F.sum(w)).alias("distance"))
    return g.unpivot(["k", query], ["uniform", "distance"], "weights", "p").select(F.concat_ws("_", "weights", F.concat(F.lit("k"), F.col("k").cast("string"))).alias("config"), query, "p")


#: The combinations of three modalities.
COMBINATIONS = {"T": ("p_t",), "M": ("p_m",), "X": ("p_x",), "T+M": ("p_t", "p_m"), "T+X": ("p_t", "p_x"), "M+X": ("p_m", "p_x"), "T+M+X": ("p_t", "p_m", "p_x")}


def fused_combinations(df: DataFrame, keys: list[str]) -> DataFrame:
    mean = lambda cols: reduce(lambda a, b: a + b, (F.col(c) for c in cols)) / len(cols)
    wide = df.select(*keys, *(mean(c).alias(n) for n, c in COMBINATIONS.items()))
    return wide.unpivot(keys, list(COMBINATIONS), "combination", "p")


def weight_grid(spark, steps: int = 20) -> DataFrame:
    """All weights of three parts in steps that sum to 1, named by them."""
    s = spark.range(steps + 1)
    w = s.select(F.col("id").alias("a")).join(s.select(F.col("id").alias("b")), F.col("a") + F.col("b") <= steps)
    w = w.withColumn("c", steps - F.col("a") - F.col("b"))
    return w.select(F.format_string("w_%02d_%02d_%02d", "a", "b", "c").alias("config"), *((F.col(x) / steps).alias(f"w_{m}") for x, m in zip("abc", "tmx")))


def fused_weighted(df: DataFrame, keys: list[str], grid: DataFrame) -> DataFrame:
    p = F.col("w_t") * F.col("p_t") + F.col("w_m") * F.col("p_m") + F.col("w_x") * F.col("p_x")
    return df.crossJoin(F.broadcast(grid)).select("config", *keys, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))


def spread(*ps: str) -> tuple[Column, Column]:
    """Mean and population deviation of a row's probabilities."""
    n = len(ps)
    mean = reduce(lambda a, b: a + b, (F.col(p) for p in ps)) / n
    return mean, F.sqrt(reduce(lambda a, b: a + b, ((F.col(p) - mean) ** 2 for p in ps)) / n)


def ici(*ps: str) -> Column:
    mean, sd = spread(*ps)
    return 2 * F.abs(mean - 0.5) * (1 - 2 * sd)


def decision_risk(c: Column, lam: Column, *ps: str) -> Column:
    """Cost-sensitive risk of the mean, mixed with the spread; low is clear."""
    mean, sd = spread(*ps)
    cost = F.least(mean * c, (1 - mean) * (1 - c)) / (c * (1 - c))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - lam) * cost + lam * 2 * sd))


def serving_risk(p: Column | str, factor: float = 0.65) -> Column:
    """High is clear."""
    return F.round(2 * F.abs(factor * (F.col(p) if isinstance(p, str) else p) - 0.5), 4)


def _class_counts(df: DataFrame, keys: list[str], x: str, cls: str, n_classes: int) -> DataFrame:
    """Counts of each class at or below each distinct value: searches use these, not the rows."""
    up = Window.partitionBy(*keys).orderBy(x)
    g = df.groupBy(*keys, x).agg(*(F.sum((F.col(cls) == k).cast("long")).alias(f"n{k}") for k in range(n_classes)))
    return g.select(*keys, x, *(F.sum(f"n{k}").over(up).alias(f"n{k}") for k in range(n_classes)))


def threshold_candidates(df: DataFrame, keys: list[str], x: str, cls: str, n_classes: int = 3, ends: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """``tau`` and how many of each class lie below it: midpoints of neighbouring values, and both ends."""
    c = _class_counts(df, keys, x, cls, n_classes)
    nxt = F.lead(x).over(Window.partitionBy(*keys).orderBy(x))
    mid = c.withColumn("_next", nxt).filter("_next is not null").select(*keys, ((F.col(x) + F.col("_next")) / 2).alias("tau"), *(f"n{k}" for k in range(n_classes)))
    total = c.groupBy(*keys).agg(*(F.max(f"n{k}").alias(f"n{k}") for k in range(n_classes)))
    none = total.select(*keys, F.lit(float(ends[0])).alias("tau"), *(F.lit(0).cast("long").alias(f"n{k}") for k in range(n_classes)))
    return mid.unionByName(none).unionByName(total.select(*keys, F.lit(float(ends[1])).alias("tau"), *(f"n{k}" for k in range(n_classes))))


def threshold_search(df: DataFrame, keys: list[str], x: str, cls: str, n_classes: int = 3, descending: bool = False, min_per_class: int = 0, ends: tuple[float, float] = (0.0, 1.0), absent: str = "zero") -> DataFrame:
    """The thresholds (one less than classes) with the least mean ordinal error; among equals the first.

    A row's error is the distance of its class from the one said over ``n_classes - 1``; ``moe`` is the mean of the
    classes' mean errors, where a class without rows counts 0 or, with ``absent="skip"``, isn't counted. The
    error is a sum of one term per threshold, and each term follows from class counts below it: a running
    minimum along the candidates finds the best tuple, so the work grows with the distinct values, not with
    their pairs. ``min_per_class`` rows must be said of each class. With fewer than two distinct values
    the thresholds are the k-th parts of ``ends`` (a third and two thirds, rounded to hundredths) and ``moe`` is null.
    """
    cand = threshold_candidates(df, keys, x, cls, n_classes, ends)
    total = cand.groupBy(*keys).agg(*(F.max(f"n{k}").alias(f"t{k}") for k in range(n_classes)), F.count("*").alias("_candidates"))
    c = cand.join(total, keys) if keys else cand.crossJoin(F.broadcast(total))
    present = reduce(lambda a, b: a + b, ((F.col(f"t{k}") > 0).cast("int") for k in range(n_classes)))
    scale = (n_classes - 1) * (F.lit(n_classes) if absent == "zero" else present)
    said = lambda i: n_classes - 1 - i if descending else i

    def cost(i: int, counts: str) -> Column:
        """Error of rows with these counts, were they all in interval ``i``."""
        return reduce(lambda a, b: a + b, (F.coalesce(F.try_divide(1.0 * abs(said(i) - k) * F.col(f"{counts}{k}"), F.col(f"t{k}")), F.lit(0.0)) for k in range(n_classes))) / scale

    below = reduce(lambda a, b: a + b, (F.col(f"n{k}") for k in range(n_classes)))
    every = reduce(lambda a, b: a + b, (F.col(f"t{k}") for k in range(n_classes)))
    taus = [f"tau{i}" for i in range(1, n_classes)]
    c = c.withColumn("_below", below).withColumn("_left", every - below)
    gap = max(1, min_per_class)
    best = None
    for i in range(1, n_classes):
        term = F.round(cost(i - 1, "n") - cost(i, "n"), 12)
        if i == 1:
            c = c.filter(F.col("_below") >= min_per_class).withColumn("_best", F.struct(term.alias("moe"), F.col("tau").alias("tau1")))
            continue
        # The best tuple up to here whose last threshold leaves rows enough.
        before = Window.partitionBy(*keys).orderBy("_below").rangeBetween(Window.unboundedPreceding, -gap)
        c = c.withColumn("_before", F.min("_best").over(before)).filter(F.col("_before").isNotNull())
        c = c.withColumn("_best", F.struct(F.round(F.col("_before.moe") + term, 12).alias("moe"), *(F.col(f"_before.tau{j}").alias(f"tau{j}") for j in range(1, i)), F.col("tau").alias(f"tau{i}")))
    c = c.filter((F.col("_left") >= min_per_class) & (F.col("_candidates") > 2))
    whole = F.round(F.col("_best.moe") + cost(n_classes - 1, "t"), 12)
    best = c.groupBy(*keys).agg(F.min(F.struct(whole.alias("moe"), *(F.col(f"_best.{t}").alias(t) for t in taus))).alias("b"))
    part = [round(ends[0] + (ends[1] - ends[0]) * i / n_classes, 2) for i in range(1, n_classes)]
    j = total.select(*keys, "_candidates").join(best, keys, "left") if keys else total.select("_candidates").join(best, how="left")
    few = F.col("_candidates") <= 2
    return j.select(*keys, *(F.when(few, F.lit(v)).otherwise(F.col(f"b.{t}")).alias(t) for t, v in zip(taus, part)), F.col("b.moe").alias("moe"))


def tree_split(df: DataFrame, keys: list[str], x: str, cls: str, n_classes: int = 3, min_leaf: int = 5, balanced: bool = False) -> DataFrame:
    """The first split of a tree on one feature: the midpoint that lowers Gini most, the lowest among equals, and the impurity that it leaves."""
    levels = [float(k) for k in range(n_classes)]
    rows = trees.weighted(df, keys, cls, balanced, n_classes)
    split = trees.best_splits(rows.withColumn("node", F.lit(1).cast("long")), keys, [x], cls, levels, "gini", min_leaf)
    w = rows.groupBy(*keys).agg(*(F.sum(F.when(F.col(cls) == k, F.col("_w")).otherwise(0.0)).alias(f"w{k}") for k in range(n_classes)))
    ws = [F.col(f"w{k}") for k in range(n_classes)]
    all_ = reduce(lambda a, b: a + b, ws)
    whole = all_ - reduce(lambda a, b: a + b, (c * c for c in ws)) / all_
    return split.join(w, keys).select(*keys, "tau", F.round((whole - F.col("gain")) / all_, 12).alias("impurity"))


def tree_thresholds(df: DataFrame, keys: list[str], x: str, cls: str, n_classes: int = 3, min_leaf: int = 5, balanced: bool = False) -> DataFrame:
    """The thresholds of a tree of depth 2 with three leaves at most, and whether it has them all."""
    splits = trees.grown(df, keys, [x], cls, [float(k) for k in range(n_classes)], depth=2, max_leaves=3, min_leaf=min_leaf, balanced=balanced)
    return trees.thresholds(splits, keys).select(*keys, F.get("taus", 0).alias("tau1"), F.get("taus", 1).alias("tau2"), "three_leaves")


#: The order in which configurations are compared.
SELECTION = (("f1_macro", False), ("brier", True), ("f1_yes", False), ("balanced_accuracy", False), ("mcc", False))


def selected(metrics: DataFrame, top: int = 1, order=SELECTION, config: str = "config") -> DataFrame:
    """The best configurations with their places; ties end with the name."""
    by = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    best = metrics.orderBy(*by, F.col(config)).limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*by, F.col(config))))


def selected_gated(metrics: DataFrame, baseline: float, config: str = "config") -> DataFrame:
    """Gates on valid share, baseline and zero recalls; relaxed in two steps if none passes. Then least error, then F1."""
    full = F.col("valid") >= 1
    tier = F.when(full & (F.col("moe_abs") < baseline) & ~F.col("any_zero"), 0).when(full & (F.col("moe_abs") < baseline), 1).otherwise(2)
    m = metrics.withColumn("tier", tier)
    return m.orderBy("tier", "moe_abs", F.col("f1").desc(), config).limit(1)
