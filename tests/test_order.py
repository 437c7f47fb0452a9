import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseforge.operators import evaluator as EV
from caseforge.operators import order as O
from caseforge.operators import resampling as R


@pytest.fixture(scope="module")
def tied(spark):
    """Rows of which two thirds have one value; some are alike in all columns, some have no value."""
    r = random.Random(1)
    rows = [(k, "ab"[k % 2], 5 if k % 3 else r.randrange(12), float(k % 7)) for k in range(600)] + [(700, None, None, 1.0)] * 3 + [(800, "a", 5, 1.0)] * 40
    return rows, spark.createDataFrame(rows, "id long, c string, v int, w double").repartition(5)


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_places_count_every_row_once(tied, ranges):
    rows, df = tied
    got = O.placed(df, F.col("v"), ranges=ranges).collect()
    assert [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(len(rows)))
    assert [r.v for r in sorted(got, key=lambda r: r.place)] == sorted((x[2] for x in rows), key=lambda x: (x is not None, x))
    by = {}
    for r in O.placed(df, F.col("v").desc(), F.col("id"), keys=("c",), ranges=ranges).collect():
        by.setdefault(r.c, []).append((r.place, r.v, r.id))
    for c, own in by.items():
        want = sorted(((x[2], x[0]) for x in rows if x[1] == c), key=lambda x: (-x[0] if x[0] is not None else 1, x[1]))
        assert [(v, i) for _, v, i in sorted(own)] == want and [p for p, _, _ in sorted(own)] == list(range(len(want)))


def test_a_hot_value_spans_ranges(tied):
    _, df = tied
    hot = O._numbered(O._sorted_ranges(df.filter("v = 5"), [F.col("v")], 7))
    sizes = [r["count"] for r in hot.groupBy(O.PART).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 0.4 * sum(sizes)


@pytest.mark.parametrize("ranges", [1, 6])
def test_running_sums_and_last_values(spark, tied, ranges):
    rows, df = tied
    got = {r.id: (r.before, r.less) for r in O.running(O.running(df.filter("id < 600"), "v", F.col("id"), ranges=ranges), "w", F.col("id"), keys=("c",), name="less", ranges=ranges).collect()}
    for k in range(600):
        assert got[k] == (sum(x[2] for x in rows[:k]), pytest.approx(sum(x[3] for x in rows[:k] if x[1] == rows[k][1])))
    gaps = spark.createDataFrame([(k, k * 10 if k % 40 == 7 else None) for k in range(300)], "id long, x int").repartition(4)
    assert {r.id: r["last"] for r in O.filled(gaps, "x", F.col("id"), ranges=ranges).collect()} == {k: (k - 7) // 40 * 400 + 70 if k >= 7 else None for k in range(300)}


def test_average_ranks_share_ties(tied):
    rows, df = tied
    for r in O.average_ranks(df, F.col("v"), ("c",), ranges=3).collect():
        own = [x[2] for x in rows if x[1] == r.c]
        key = lambda x: -1 if x is None else x
        less, same = sum(key(x) < key(r.v) for x in own), sum(x == r.v for x in own)
        assert r["rank"] == less + (same + 1) / 2


def test_of_nothing(spark, tied):
    nothing = tied[1].limit(0)
    assert O.placed(nothing, F.col("v")).count() == O.running(nothing, "v", F.col("v"), keys=("c",)).count() == O.filled(nothing, "v", F.col("id")).count() == O.average_ranks(nothing, F.col("v"), ("c",)).count() == 0
    assert R.contiguous_folds(nothing, "id").count() == 0
    assert sorted(r.fold for r in R.contiguous_folds(tied[1].limit(2), "id").collect()) == [0, 1]


def concordance(t, p, e):
    first = (t[:, None] < t[None]) & (e[:, None] == 1)
    return np.where(p[:, None] < p[None], 1.0, np.where(p[:, None] == p[None], 0.5, 0.0))[first].sum(), first.sum()


@pytest.mark.parametrize("kind", ["ties", "distinct", "one time", "one prediction"])
@pytest.mark.parametrize("buckets", [1, 3, 64, 2000])
def test_concordance_equals_all_pairs(spark, kind, buckets):
    rng = np.random.default_rng(len(kind))
    t, p, e = rng.integers(0, 30, 400).astype(float), rng.integers(0, 25, 400).astype(float), rng.integers(0, 2, 400)
    if kind == "distinct":
        t, p = rng.normal(size=400), rng.normal(size=400)
    t[:150] = 7.0 if kind == "one time" else t[:150]
    p[:250] = 3.0 if kind == "one prediction" else p[:250]
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(t, p, e)] + [(None, 1.0, 1), (1.0, None, 1), (2.0, math.nan, 1), (3.0, 1.0, None)], "t double, p double, e int")
    won, pairs = concordance(t, p, e)
    r = EV.c_index(df, "t", "p", "e", buckets).first()
    assert (r.c_index, r.pairs) == (pytest.approx(won / pairs), pairs)


def test_concordance_without_predictions(spark):
    df = spark.createDataFrame([(1.0, None, 1), (2.0, None, 0)], "t double, p double, e int")
    for buckets in (1, 64):
        assert EV.c_index(df, "t", "p", "e", buckets).first() == (None, 0.0)
    assert EV.c_index(df.limit(0), "t", "p", "e").first() == (None, 0.0)


def test_a_range_of_a_million_is_no_square():
    import time

    rng = np.random.default_rng(9)
    n = 1_000_000
    t, p, e = rng.permutation(n).astype(float), rng.normal(size=n), np.ones(n, int)
    began = time.process_time()
    pairs, won = EV._wins(t, p, e, np.ones(n, int))
    assert time.process_time() - began < 60
    assert pairs == n * (n - 1) / 2 and abs(won / pairs - 0.5) < 0.01
    small = slice(0, 300)
    assert EV._wins(t[small], p[small], e[small], e[small]) == concordance(t[small], p[small], e[small])[::-1]
