"""Metrics of predictions, per key (configuration, split): one plan for all keys.

Curves work on counts per distinct score, so what a window orders is the scores, not the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification(df: DataFrame, keys: list[str], y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Counts, F1 macro and per class, precision, recall, specificity, accuracies and MCC; 0 where a denominator is."""
    pos, hit = F.col(y) == 1, F.col(p) >= threshold
    n = lambda c: F.sum(c.cast("long"))
    m = df.groupBy(*keys).agg(n(pos & hit).alias("tp"), n(~pos & hit).alias("fp"), n(pos & ~hit).alias("fn"), n(~pos & ~hit).alias("tn"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    m = m.withColumns(
        {
            "f1_yes": _ratio(2.0 * tp, 2 * tp + fp + fn),
            "f1_no": _ratio(2.0 * tn, 2 * tn + fp + fn),
            "precision": _ratio(1.0 * tp, tp + fp),
            "recall": _ratio(1.0 * tp, tp + fn),
            "specificity": _ratio(1.0 * tn, tn + fp),
            "accuracy": _ratio(1.0 * (tp + tn), tp + fp + fn + tn),
            "mcc": _ratio(1.0 * (tp * tn - fp * fn), F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))),
        }
    )
    return m.withColumns({"f1_macro": (F.col("f1_yes") + F.col("f1_no")) / 2, "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "one_minus_brier": 1 - F.col("brier")})


def by_score(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*keys, F.col(p).alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; null with one class."""
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = by_score(df, keys, y, p).withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return s.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """``fpr, tpr`` at each distinct score, for drawing."""
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    every = Window.partitionBy(*keys)
    s = by_score(df, keys, y, p)
    return s.select(*keys, "score", F.try_divide(F.sum("neg").over(down), F.sum("neg").over(every)).alias("fpr"), F.try_divide(F.sum("pos").over(down), F.sum("pos").over(every)).alias("tpr"))


def average_precision(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    s = by_score(df, keys, y, p).withColumn("tp", F.sum("pos").over(down)).withColumn("said", F.sum(F.col("pos") + F.col("neg")).over(down))
    return s.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("said")), F.sum("pos")).alias("average_precision"))


def calibration(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """Per bin rows, mean probability and share of positives. Edges are ``k * (1 / bins)``, the last bin closed."""
    at = sum(((F.col(p) >= k * (1.0 / bins)).cast("int") for k in range(1, bins)), F.lit(0))
    return df.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("said"), F.avg(F.col(y).cast("double")).alias("was"))


def ece(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    b = calibration(df, keys, y, p, bins)
    return b.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("said") - F.col("was"))) / F.sum("n")).alias("ece"))


def moe_abs(df: DataFrame, keys: list[str], truth: str, predicted: str, absent: str = "skip", n_classes: int = 3) -> DataFrame:
    """Mean over classes of the mean ordinal error. ``absent``: classes without rows are skipped, count ``zero`` (divisor the number of classes), or are skipped with errors ``scaled`` by the number of classes."""
    by = df.groupBy(*keys, truth).agg(F.avg(F.abs(F.col(truth) - F.col(predicted)).cast("double")).alias("e"))
    scale = {"skip": F.avg("e"), "zero": F.sum("e") / n_classes, "scaled": F.avg(F.col("e") / n_classes)}[absent]
    return by.groupBy(*keys).agg(scale.alias("moe_abs"))


def class_recalls(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Recall of each class, and whether any is zero."""
    r = df.groupBy(*keys, F.col(truth).alias("class")).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return r.withColumn("any_zero", F.max((F.col("recall") == 0).cast("int")).over(Window.partitionBy(*keys)) == 1)


def mcnemar(df: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """Rows that only a or only b has right, and the exact two-sided binomial p-value (in logarithms, so counts may be large)."""
    right_a, right_b = F.col(a) == F.col(y), F.col(b) == F.col(y)
    m = df.groupBy(*keys).agg(F.sum((right_a & ~right_b).cast("long")).alias("only_a"), F.sum((~right_a & right_b).cast("long")).alias("only_b"))

    def p_value(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for x, z in zip(pdf["only_a"], pdf["only_b"]):
                n, k = int(x + z), int(min(x, z))
                # Downward from k each term is smaller than the one before, so the tail ends after some root of n terms.
                term = tail = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
                while k and term > 1e-18 * tail:
                    term *= k / (n - k + 1)
                    tail, k = tail + term, k - 1
                out.append(min(1.0, 2 * tail) if n else 1.0)
            yield pdf.assign(p_value=pd.Series(out, index=pdf.index, dtype=float))

    return m.mapInPandas(p_value, m.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",p_value:double")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    r = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_rx", rank(x)).withColumn("_ry", rank(y))
    return r.groupBy(*keys).agg(F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("rho"))


def section_f1(df: DataFrame, truth: str, predicted: str, sections: list[str]) -> DataFrame:
    """F1 of each section over all rows, as a multi-label problem."""
    s = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("section"), F.array_contains(truth, x).alias("t"), F.array_contains(predicted, x).alias("p")) for x in sections))).alias("s")).select("s.*")
    n = lambda c: F.sum(c.cast("long"))
    by = s.groupBy("section").agg(n(F.col("t") & F.col("p")).alias("tp"), n(F.col("t") != F.col("p")).alias("wrong"))
    return by.select("section", _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")).alias("f1"))


def quadratic_kappa(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Quadratic weighted kappa; null if fewer than two labels occur."""
    d = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    # The expected disagreement under independence needs only means and variances.
    m = d.groupBy(*keys).agg(F.avg((t - p) ** 2).alias("seen"), (F.var_pop(t) + F.var_pop(p) + (F.avg(t) - F.avg(p)) ** 2).alias("chance"))
    return m.select(*keys, F.when(F.col("chance") > 0, 1 - F.col("seen") / F.col("chance")).alias("kappa"))


def weighted_f1(df: DataFrame, keys: list[str], truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """Support-weighted F1 on fixed labels; a missing prediction is a wrong one, never a label."""
    p = F.coalesce(predicted, F.lit("__missing__"))
    s = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(x).alias("label"), (F.col(truth) == x).alias("t"), (p == x).alias("p")) for x in labels))).alias("s")).select(*keys, "s.*")
    n = lambda c: F.sum(c.cast("long"))
    by = s.groupBy(*keys, "label").agg(n(F.col("t") & F.col("p")).alias("tp"), n(F.col("t") != F.col("p")).alias("wrong"), n(F.col("t")).alias("support"))
    return by.groupBy(*keys).agg(_ratio(F.sum(F.col("support") * _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("wrong"))), F.sum("support")).alias("weighted_f1"))
