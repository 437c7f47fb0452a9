"""Contrastive losses as aggregates over pairs, and the augmentations that make views.

``pairs(i, j, s)`` holds ordered pairs of rows with their similarity; the losses are values to
watch and compare. Training is ``refine``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nt_xent(pairs: DataFrame, positive: Column, temperature: float = 0.5) -> DataFrame:
    """Each anchor's log-sum over the others less its positive's similarity, averaged."""
    z = F.col("s") / temperature
    top = pairs.groupBy("i").agg(F.max(z).alias("m"))
    by = pairs.join(top, "i").groupBy("i").agg((F.first("m") + F.log(F.sum(F.exp(z - F.col("m"))))).alias("all"), F.max(F.when(positive, z)).alias("pos"))
    return by.filter("pos is not null").agg(F.avg(F.col("all") - F.col("pos")).alias("loss"))


def supcon(pairs: DataFrame, same: Column, temperature: float = 0.5) -> DataFrame:
    """Mean over each anchor's positives of the log-sum less their similarity; anchors without a positive are left out."""
    z = F.col("s") / temperature
    top = pairs.groupBy("i").agg(F.max(z).alias("m"))
    by = pairs.join(top, "i").groupBy("i").agg((F.first("m") + F.log(F.sum(F.exp(z - F.col("m"))))).alias("all"), F.avg(F.when(same, z)).alias("pos"))
    return by.filter("pos is not null").agg(F.avg(F.col("all") - F.col("pos")).alias("loss"))


def align_uniform(pairs: DataFrame, positive: Column, dist: str = "dist", alpha: float = 2.0, t: float = 2.0) -> DataFrame:
    """Mean distance of positives, and the log of the mean Gaussian potential."""
    return pairs.agg(F.avg(F.when(positive, F.pow(dist, F.lit(alpha)))).alias("alignment"), F.log(F.avg(F.exp(-t * F.col(dist) ** 2))).alias("uniformity"))


def triplet(pairs: DataFrame, same: Column, dist: str = "dist", margin: float = 0.2, mining: str = "hard") -> DataFrame:
    """Per anchor the mined positive and negative. Semi-hard takes the nearest negative beyond the positive, else the nearest."""
    d = F.col(dist)
    base = pairs.groupBy("i").agg(F.max(F.when(same, d)).alias("far_pos"), F.avg(F.when(same, d)).alias("mean_pos"), F.min(F.when(~same, d)).alias("near_neg"), F.avg(F.when(~same, d)).alias("mean_neg"))
    if mining == "easy":
        gap = F.col("mean_pos") - F.col("mean_neg")
    elif mining == "hard":
        gap = F.col("far_pos") - F.col("near_neg")
    else:
        semi = pairs.join(base.select("i", "far_pos"), "i").filter(~same & (d > F.col("far_pos"))).groupBy("i").agg(F.min(d).alias("semi"))
        base = base.join(semi, "i", "left")
        gap = F.col("far_pos") - F.coalesce("semi", "near_neg")
    return base.agg(F.avg(F.greatest(F.lit(0.0), gap + margin)).alias("loss"))


def rank_n_contrast(pairs: DataFrame, label_gap: str, temperature: float = 2.0) -> DataFrame:
    """For each pair the log-sum over the anchor's partners at least as far in label, less its own similarity."""
    z = F.col("s") / temperature
    by = Window.partitionBy("i")
    m = pairs.withColumn("m", F.max(z).over(by))
    tail = by.orderBy(F.col(label_gap).desc()).rangeBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("tail", F.col("m") + F.log(F.sum(F.exp(z - F.col("m"))).over(tail)))
    return m.agg(F.avg(F.col("tail") - z).alias("loss"))


def combined(parts: list[tuple[float, DataFrame, str]]) -> DataFrame:
    out, total = None, F.lit(0.0)
    for k, (w, df, c) in enumerate(parts):
        one = df.select(F.col(c).alias(f"_l{k}"))
        out = one if out is None else out.crossJoin(one)
        total = total + w * F.col(f"_l{k}")
    return out.select(total.alias("loss"))


def _unit(seed: int, *parts) -> Column:
    """A number in (0, 1) from a hash: the same on each run."""
    return (F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def with_noise(df: DataFrame, key: str, vector: str, scale: Column | float, seed: int = 1) -> DataFrame:
    """Gaussian noise by Box-Muller over hashes; ``scale`` may be a column, as the mean neighbour distance."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))

    def shake(x, i):
        return x + scale * F.sqrt(-2 * F.log(_unit(seed, key, i))) * F.cos(2 * 3.141592653589793 * _unit(seed + 1, key, i))

    return df.withColumn(vector, F.transform(vector, shake))


def with_dropout(df: DataFrame, key: str, vector: str, share: float, seed: int = 1) -> DataFrame:
    return df.withColumn(vector, F.transform(vector, lambda x, i: F.when(_unit(seed, key, i) < share, 0.0).otherwise(x)))


def with_cutout(df: DataFrame, vector: str, start: int, width: int) -> DataFrame:
    """One block of features to 0, the same for all rows."""
    return df.withColumn(vector, F.transform(vector, lambda x, i: F.when((i >= start) & (i < start + width), 0.0).otherwise(x)))


def mixed_up(df: DataFrame, key: str, vector: str, edges: DataFrame, lam: Column | float) -> DataFrame:
    """Each row mixed with its neighbour ``(q, n)``; ``lam``, its own share, may be a column of ``key``."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    other = df.select(F.col(key).alias("n"), F.col(vector).alias("_o"))
    j = df.join(edges.select(F.col("q").alias(key), "n"), key).join(other, "n").withColumn("_lam", lam)
    return j.select(key, F.zip_with(vector, "_o", lambda a, b: F.col("_lam") * a + (1 - F.col("_lam")) * b).alias(vector))


def random_neighbour(edges: DataFrame, seed: int = 1) -> DataFrame:
    """Of each row ``q`` one of its neighbours, by the least hash."""
    return edges.groupBy("q").agg(F.min_by("n", F.xxhash64("q", "n", F.lit(seed))).alias("n"))


def beta_share(key: str, a: float = 0.4, seed: int = 1, tries: int = 16) -> Column:
    """A number from Beta(a, a), a at most 1, by Joehnk's rejection over hashes; one in about 10^12 rows runs out of tries and gets a half."""
    tried = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.struct(F.pow(_unit(seed, key, i), F.lit(1 / a)).alias("x"), F.pow(_unit(seed + 1, key, i), F.lit(1 / a)).alias("y")))
    fit = F.get(F.filter(tried, lambda t: t["x"] + t["y"] <= 1), 0)
    return F.coalesce(fit["x"] / (fit["x"] + fit["y"]), F.lit(0.5))


def knn_positive(df: DataFrame, key: str, vector: str, edges: DataFrame) -> DataFrame:
    """Each row with its neighbour's vector as the positive view: of ranked edges give the first, or ``random_neighbour``."""
    other = df.select(F.col(key).alias("n"), F.col(vector).alias("positive"))
    return df.join(edges.select(F.col("q").alias(key), "n"), key).join(other, "n")


def composed(df: DataFrame, *steps) -> DataFrame:
    for f in steps:
        df = f(df)
    return df


def one_of(df: DataFrame, key: str, vector: str, *steps, seed: int = 1) -> DataFrame:
    """Each row by one of the steps, chosen by a hash of its key; steps keep keys and columns."""
    chosen = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("step")), F.lit(len(steps)))
    out = None
    for i, f in enumerate(steps):
        part = f(df.filter(chosen == i)).select(key, vector)
        out = part if out is None else out.unionByName(part)
    return out
