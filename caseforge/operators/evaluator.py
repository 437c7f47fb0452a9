"""Scores of candidate records against the truth, per case and over the table; survival measures."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CONFIDENCE, WEIGHT, coded, ordered_distinct, weight_name
from .order import filled, running
from .sets import set_f1

#: Weights of the components, without and with a rationale judge.
COMPOSITE = {"confidence": 0.225, "weights": 0.275, "factors": 0.175, "tools": 0.150, "grounding": 0.175}
COMPOSITE_JUDGED = {"confidence": 0.20, "weights": 0.25, "factors": 0.15, "tools": 0.15, "grounding": 0.15, "rationale": 0.10}
HORIZONS = (12.0, 24.0, 36.0, 60.0)


def decision_gate(truth: Column, predicted: Column) -> Column:
    return F.when(truth.isNotNull() & (truth == predicted), 1.0).otherwise(0.0)


def confidence_score(truth: Column, predicted: Column) -> Column:
    return 1 - F.abs(coded(truth, CONFIDENCE) - coded(predicted, CONFIDENCE)) / 2.0


def weight_score(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """From two maps variable -> level: 1 less the mean ordinal error over the truth's known levels; a level that isn't predicted is ``not_used``."""
    long = df.select(*keys, F.explode(truth).alias("variable", "level"), F.col(predicted).alias("_p"))
    g, p = coded(weight_name("level"), WEIGHT), F.coalesce(coded(weight_name(F.try_element_at("_p", F.col("variable"))), WEIGHT), F.lit(0))
    return long.groupBy(*keys).agg((1 - F.avg(F.abs(g - p) / 3.0)).alias("weight_score"))


def important(weights: Column | str) -> Column:
    """The variables of a map that are important or decisive."""
    return F.map_keys(F.map_filter(weights, lambda k, v: F.coalesce(weight_name(v).isin("important", "decisive"), F.lit(False))))


def factor_score(truth: Column | str, predicted: Column | str) -> Column:
    return set_f1(important(truth), important(predicted))


def tool_precision(expected: Column | str, used: Column | str) -> Column:
    """Share of the used tools that were expected; 1 if none was used."""
    u = ordered_distinct(used)
    return F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(u, ordered_distinct(expected))) / F.size(u).cast("double"))


def grounding(df: DataFrame, keys: list[str], weights: str, revealed: str, sections: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Share of the variables in use that the revealed sections ground; null if none can be graded.

    ``sections(variable, primary, always)``: a variable that is always available or has no
    section is grounded; one whose sections are all outside the vocabulary isn't graded.
    """
    used = df.select(*keys, F.col(revealed).alias("_r"), F.explode(weights).alias("variable", "level")).filter(F.coalesce(weight_name("level") != "not_used", F.lit(False)))
    m = used.join(F.broadcast(sections), "variable", "left")
    named = F.array_intersect("primary", F.array(*map(F.lit, vocabulary)))
    free = F.coalesce("always", F.lit(False)) | (F.coalesce(F.size("primary"), F.lit(0)) == 0)
    state = F.when(free, 1).when(F.size(named) == 0, F.lit(None)).when(F.arrays_overlap(named, ordered_distinct("_r")), 1).otherwise(0)
    return m.groupBy(*keys).agg(F.avg(state.cast("double")).alias("grounding"))


def composite(parts: dict[str, Column], judged: bool = False) -> Column:
    w = COMPOSITE_JUDGED if judged else COMPOSITE
    return reduce(lambda a, b: a + b, (F.coalesce(parts.get(k, F.lit(None).cast("double")), F.lit(0.0)) * x for k, x in w.items()))


def recurrence_time_score(event: Column, truth: Column, predicted: Column) -> Column:
    """Closeness of times; a censored case only counts predictions that come too early."""
    scale = F.greatest(truth, F.lit(1.0))
    close = F.greatest(F.lit(0.0), 1 - F.abs(predicted - truth) / scale)
    return F.when(truth.isNull() | predicted.isNull(), None).when((event != 1) & (predicted >= truth), 1.0).otherwise(close)


def recurrence_score(event: Column, said: Column, truth: Column, predicted: Column, judged: Column | None = None) -> Column:
    """Half the event's match and half the closeness of times; with a judge's score 0.35 of each and 0.30 of that."""
    parts = F.coalesce((event == said).cast("double"), F.lit(0.0)), F.coalesce(recurrence_time_score(event, truth, predicted), F.lit(0.0))
    if judged is None:
        return 0.5 * parts[0] + 0.5 * parts[1]
    return 0.35 * parts[0] + 0.35 * parts[1] + 0.30 * F.coalesce(judged, F.lit(0.0))


def distinct_subjects(df: DataFrame, time: str, predicted: str, event: str) -> DataFrame:
    """Subjects counted per distinct time, prediction and event: the pair joins work on these."""
    return df.groupBy(F.col(time).cast("double").alias("t"), F.col(predicted).cast("double").alias("p"), F.col(event).cast("int").alias("e")).agg(F.count("*").alias("n"))


def comparable_pairs(df: DataFrame, time: str, event: str) -> DataFrame:
    """``t, pairs``: of each event time how many pairs start there; the later subject lasts longer, from a running sum over the times."""
    by = df.groupBy(F.col(time).cast("double").alias("t")).agg(F.count("*").alias("n"), F.sum((F.col(event) == 1).cast("long")).alias("events")).filter("t is not null")
    later = running(by, "n", F.col("t").desc(), name="later")
    return later.withColumn("pairs", F.col("events") * F.col("later")).filter("pairs > 0").select("t", "pairs")


#: Values by which times and predictions are cut into ranges; a task gets the distinct subjects of one range.
C_BUCKETS = 256


def _wins(t: np.ndarray, p: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Pairs whose first subject had the event and whose second has a later ``t``, weighted by ``n``: how many there are, and those with the larger ``p`` second, equal ones by half.

    Merge counting by the bits of the time's rank: of subjects that agree in the higher bits, those with the bit set are
    later. They stay sorted by ``p``, so each bit takes one running sum: n log n in all.
    """
    rank, by_p = np.unique(t, return_inverse=True)[1], np.argsort(p, kind="stable")
    rank, p, own, n = rank[by_p], p[by_p], np.where(e[by_p] == 1, n[by_p], 0).astype(np.float64), n[by_p].astype(np.float64)
    pairs = won = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        order = np.argsort(rank >> (bit + 1), kind="stable")  # by the higher bits, within them by p
        group, q, later = (rank >> (bit + 1))[order], p[order], (rank[order] >> bit) & 1
        so_far = np.concatenate([[0.0], np.cumsum(n[order] * later)])
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ties = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(q, prepend=np.nan) != 0))
        group_end = np.append(starts[1:], len(q))[np.searchsorted(starts, np.arange(len(q)), "right") - 1]
        tie = np.searchsorted(ties, np.arange(len(q)), "right") - 1
        tie_start, tie_end = ties[tie], np.append(ties[1:], len(q))[tie]
        group_start = starts[np.searchsorted(starts, np.arange(len(q)), "right") - 1]
        first = own[order] * (1 - later)
        pairs += float((first * (so_far[group_end] - so_far[group_start])).sum())
        won += float((first * (so_far[group_end] - so_far[tie_end] + (so_far[tie_end] - so_far[tie_start]) / 2)).sum())
    return pairs, won


def c_index(df: DataFrame, time: str, predicted: str, event: str, buckets: int = C_BUCKETS) -> DataFrame:
    """Harrell's index over pairs whose earlier subject had the event; null without such a pair. A subject without time, prediction or event takes no part; NaN counts as none.

    Up to ``buckets - 1`` values cut times and predictions into ranges, each of these values a range of its own, so a value of very many
    subjects leaves nothing to compare within its range. Pairs that differ in both ranges follow from the counts of the grid of
    ranges (its size goes by ``buckets``, not by the rows). Pairs in one range of times are counted there; pairs in
    one range of predictions and different ranges of times there. A range of d distinct subjects costs d log d.
    """
    given = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in ((time, "t"), (predicted, "p"))]
    s = df.select(*given, F.col(event).cast("int").alias("e")).dropna().groupBy("t", "p", "e").agg(F.count("*").alias("n"))
    at = [i / buckets for i in range(1, buckets)]
    if at:
        ends = s.agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in ("t", "p"))).first()
        cuts = {c: np.unique(np.array(ends[c] or [], np.float64)) for c in ("t", "p")}
    else:
        cuts = {c: np.zeros(0) for c in ("t", "p")}

    def ranged(batches):
        for b in batches:
            of = []
            for c in ("t", "p"):
                x = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                below = np.searchsorted(cuts[c], x)
                of.append(below + np.searchsorted(cuts[c], x, "right"))  # odd where x is a cut
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x.astype(np.int32)) for x in of)], names=[*b.schema.names, "tr", "pr"])

    s = s.mapInArrow(ranged, "t double, p double, e int, n long, tr int, pr int")
    n_t, n_p = (2 * len(cuts[c]) + 1 for c in ("t", "p"))
    every, events = np.zeros((n_t, n_p)), np.zeros((n_t, n_p))
    for r in s.groupBy("tr", "pr").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("e") == 1, F.col("n")).otherwise(0)).alias("events")).collect():
        every[r["tr"], r["pr"]], events[r["tr"], r["pr"]] = r["n"], r["events"]
    later = np.cumsum(every[::-1], 0)[::-1] - every  # same range of predictions, later ranges of times
    above = np.cumsum(later[:, ::-1], 1)[:, ::-1] - later
    single = np.arange(n_p) % 2 == 1
    pairs, won = float((events * later.sum(1, keepdims=True)).sum()), float((events * (above + np.where(single, later / 2, 0))).sum())

    def counted(time_column: str):
        def count(table):
            same, more = _wins(*(table[c].to_numpy() for c in (time_column, "p", "e", "n")))
            return pa.table([[same], [more]], names=["pairs", "won"])

        return count

    # Within a range of times all pairs, within one of predictions those whose ranges of times differ: their pairs are in the grid's sum.
    inside = s.filter("tr % 2 = 0").groupBy("tr").applyInArrow(counted("t"), "pairs double, won double")
    beside = s.filter("pr % 2 = 0").groupBy("pr").applyInArrow(counted("tr"), "pairs double, won double").withColumn("pairs", F.lit(0.0))
    total = inside.unionByName(beside).agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("won"), F.lit(0.0)).alias("won"))
    return total.select(F.try_divide(F.col("won") + won, F.col("pairs") + pairs).alias("c_index"), (F.col("pairs") + pairs).alias("pairs"))


def censoring_km(df: DataFrame, time: str, event: str) -> DataFrame:
    """``t, g``: Kaplan-Meier survival of censoring after each distinct time; 0 stays 0. Running sums over the distinct times, in ranges."""
    by = df.groupBy(F.col(time).cast("double").alias("t")).agg(F.count("*").alias("n"), F.sum((F.col(event) == 0).cast("long")).alias("censored")).filter("t is not null")
    s = running(by, "n", F.col("t").desc(), name="later").withColumn("f", 1 - F.col("censored") / (F.col("later") + F.col("n")))
    s = s.select("t", F.when(F.col("f") > 0, F.log("f")).otherwise(0.0).alias("log"), (F.col("f") <= 0).cast("long").alias("dead"))
    s = running(running(s, "log", F.col("t"), name="logs"), "dead", F.col("t"), name="deaths")
    return s.select("t", F.when(F.col("deaths") + F.col("dead") > 0, 0.0).otherwise(F.exp(F.col("logs") + F.col("log"))).alias("g"))


def km_at(times: DataFrame, km: DataFrame, at: str) -> DataFrame:
    """``times`` with ``g``, the last step at or before ``at`` (1 before the first): of the distinct times asked for, in one order with the steps; no range join."""
    asked = times.select(F.col(f"`{at}`").alias("_at")).distinct()
    both = km.select(F.col("t").alias("_at"), "g", F.lit(0).alias("_kind")).unionByName(asked.select("_at", F.lit(None).cast("double").alias("g"), F.lit(1).alias("_kind")))
    found = filled(both, "g", F.col("_at"), F.col("_kind"), name="_g").filter("_kind = 1").select("_at", F.coalesce("_g", F.lit(1.0)).alias("g"))
    return times.join(found, F.col(f"`{at}`").eqNullSafe(F.col("_at"))).drop("_at")


def time_dependent_auc(df: DataFrame, time: str, predicted: str, event: str, horizons=HORIZONS) -> DataFrame:
    """Inverse-censoring-weighted AUC at each horizon; null without a case or control."""
    spark = df.sparkSession
    km = censoring_km(df, time, event)
    s = distinct_subjects(df, time, predicted, event)
    hs = km_at(spark.createDataFrame([(float(h),) for h in horizons], "h double"), km, "h").withColumnRenamed("g", "gh")
    cases = km_at(s.select("t").distinct(), km, "t")
    x = s.join(cases, "t").crossJoin(F.broadcast(hs))
    case, control = (F.col("e") == 1) & (F.col("t") <= F.col("h")) & (F.col("g") > 0), (F.col("t") > F.col("h")) & (F.col("gh") > 0)
    w = F.when(case, F.col("n") / F.col("g")).when(control, F.col("n") / F.col("gh"))
    x = x.withColumn("w", w).filter("w is not null").groupBy("h", "p").agg(F.sum(F.when(case, F.col("w")).otherwise(0.0)).alias("wc"), F.sum(F.when(case, 0.0).otherwise(F.col("w"))).alias("wn"))
    x = running(x, "wn", F.col("p").desc(), keys=("h",), name="later").withColumn("won", F.col("wc") * (F.col("later") + F.col("wn") / 2))
    out = x.groupBy("h").agg(F.try_divide(F.sum("won"), F.sum("wc") * F.sum("wn")).alias("auc"))
    return spark.createDataFrame([(float(h),) for h in horizons], "h double").join(out, "h", "left").select(F.col("h").alias("horizon"), "auc")
