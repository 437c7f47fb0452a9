"""Properties and edge cases that SQL can't show."""

import json
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseforge.functions import scalars as S
from caseforge.operators import aggregates as AG
from caseforge.operators import attribution as AT
from caseforge.operators import evaluator as EV
from caseforge.operators import features as fe
from caseforge.operators import losses as L
from caseforge.operators import metrics as M
from caseforge.operators import models as MO
from caseforge.operators import resampling as R
from caseforge.operators import sets, trees
from caseforge.operators import vectors as V
from caseforge.plans import QUERIES
from caseforge.sources import readers
from caseforge.streaming import scores


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 1, (40, 8)) for c in rng.normal(0, 6, (3, 8))])


def test_neighbours_equal_brute_force_in_any_blocks(spark, blobs):
    x = np.concatenate([blobs, blobs[:5]])  # duplicates: the self stays out, ties go by id
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(q, n) for q in range(len(x)) for n in [j for _, j in sorted((d[q, j], j) for j in range(len(x)) if j != q)][:7]}
    for block in (4096, 20):
        e = V.knn(frame(spark, x), 7, block=block).collect()
        assert {(r.q, r.n) for r in e} == want and all(r.dist >= 0 for r in e)


def test_occurrences_sum_and_report_ranges(spark, blobs):
    b = frame(spark, blobs)
    e = V.knn(b, 5).persist()
    occ = V.k_occurrence(e, b)
    assert occ.agg(F.sum("n_k")).first()[0] == len(blobs) * 5
    h = V.hubness(occ, e).first()
    assert h.robinhood <= 0 and h.gini == -h.robinhood and 0 <= h.contamination <= 1
    iso = V.isotropy(b)
    assert 1 <= iso["participation_ratio"] <= 8 and 0 <= iso["score"] <= 1
    p = V.pairs(b)
    k = V.rbf(p, V.median_sigma(p))
    labels = spark.createDataFrame([(i, i // 40) for i in range(len(blobs))], "id long, label int")
    assert 0 <= V.kernel_alignment(k, labels).first()[0] <= 1
    assert {(r.i, r.j) for r in V.pairs(b, block=25).collect()} == set(combinations(range(len(blobs)), 2))
    assert 2 < V.intrinsic_dimension(e, 5).first().two_nn < 16


def test_pca_is_centred_and_orthonormal(spark, blobs):
    b = frame(spark, blobs + 5)
    mean, comps = V.pca(b, 3)
    assert np.allclose(comps @ comps.T, np.eye(3), atol=1e-9)
    z = np.array([r.z for r in V.projected(b, mean, comps).orderBy("id").collect()])
    assert np.allclose(z.mean(0), 0, atol=1e-9) and (np.diff(z.var(0)) <= 1e-9).all()


def test_splits_are_stratified_and_leak_free(spark):
    d = spark.createDataFrame([(i, int(i < 54)) for i in range(88)], "id long, y int")
    s = R.stratified_splits(d, "id", "y", 5)
    for r in s.groupBy("split", "y", "role").count().collect():
        assert r["count"] == {(1, 1): 11, (1, 0): 43, (0, 1): 7, (0, 0): 27}[r.y, r.role]
    x = s.join(d.select("id", F.rand(1).alias("x")), "id")
    base, moved = (fe.minmax(v, "split", "role", ["x"]).filter("role = 0").orderBy("split", "id").collect() for v in (x, x.withColumn("x", F.when(F.col("role") == 1, 1e9).otherwise(F.col("x")))))
    assert [r.x for r in base] == [r.x for r in moved]
    assert R.subsample(d, "id", 10).orderBy("id").collect() == R.subsample(d.repartition(7), "id", 10).orderBy("id").collect()


@pytest.mark.parametrize("descending,least,absent,n_classes", [(False, 0, "zero", 3), (True, 0, "zero", 3), (True, 4, "zero", 3), (False, 0, "skip", 4), (True, 2, "skip", 4)])
def test_threshold_search_equals_enumeration(spark, descending, least, absent, n_classes):
    rng = np.random.default_rng(4)
    x, c = rng.random(40).round(2), rng.integers(0, 3, 40)  # of four classes one has no row
    d = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, c)], "x double, c int")
    u = np.unique(x)
    taus = [0.0, *((u[1:] + u[:-1]) / 2), 1.0]
    found = []
    for t in combinations(taus, n_classes - 1):
        said = sum((x >= v).astype(int) for v in t)
        said = n_classes - 1 - said if descending else said
        if least and min(np.bincount(said, minlength=n_classes)) < least:
            continue
        errors = [np.abs(said - c)[c == k].mean() / (n_classes - 1) for k in range(n_classes) if (c == k).any()]
        found.append((round(sum(errors) / (n_classes if absent == "zero" else len(errors)), 10), *t))
    r = MO.threshold_search(d, [], "x", "c", n_classes, descending, least, absent=absent).first()
    assert (r.moe, *(r[f"tau{i}"] for i in range(1, n_classes))) == pytest.approx(min(found), abs=1e-9)


def test_threshold_search_of_one_value_falls_back(spark):
    r = MO.threshold_search(spark.createDataFrame([(0.5, 0), (0.5, 2)], "x double, c int"), [], "x", "c").first()
    assert (r.tau1, r.tau2, r.moe) == (0.33, 0.67, None)


def brute_tree(x, level, weight, levels, criterion, depth, max_leaves, min_leaf):
    """Splits ``{node: (feature, tau)}`` by recursion over all midpoints, best first."""

    def impurity(rows):
        w = [weight[rows][level[rows] == k].sum() for k in range(len(levels))]
        if criterion == "gini":
            return sum(w) - sum(v * v for v in w) / sum(w)
        if criterion == "squared":
            return sum(v * g * g for v, g in zip(w, levels)) - sum(v * g for v, g in zip(w, levels)) ** 2 / sum(w)
        return min(sum(v * abs(g - m) for v, g in zip(w, levels)) for m in levels)

    def best(rows):
        out = []
        for f in range(x.shape[1]):
            u = np.unique(x[rows, f])
            for tau in (u[1:] + u[:-1]) / 2:
                left = rows[x[rows, f] <= tau]
                right = rows[x[rows, f] > tau]
                if min(len(left), len(right)) >= min_leaf:
                    out.append((-round(impurity(rows) - impurity(left) - impurity(right), 9), f, tau))
        return min(out, default=(0, 0, 0))

    splits, frontier = {}, {1: np.arange(len(x))}
    while frontier:
        scored = {n: best(r) for n, r in frontier.items() if n.bit_length() <= depth}
        scored = {n: s for n, s in scored.items() if s[0] < 0}
        if not scored or max_leaves and len(splits) == max_leaves - 1:
            break
        n = min(scored, key=lambda n: (scored[n][0], n))
        _, f, tau = scored[n]
        splits[n] = (f, float(tau))
        rows = frontier.pop(n)
        frontier |= {2 * n: rows[x[rows, f] <= tau], 2 * n + 1: rows[x[rows, f] > tau]}
    return splits


@pytest.mark.parametrize("criterion,depth,max_leaves,balanced", [("gini", 3, None, True), ("gini", 2, 3, False), ("squared", 2, 3, True), ("absolute", 2, 3, False)])
def test_trees_equal_brute_force(spark, criterion, depth, max_leaves, balanced):
    rng = np.random.default_rng(6)
    levels = [0.0, 0.5, 1.0]
    rows, brute = [], {}
    for key in (0, 1):
        x, noise = rng.random((60, 3)).round(2), rng.random(60)
        level = np.digitize(x[:, key] + 0.4 * noise, [0.4, 1.0])
        counts = np.bincount(level, minlength=3)
        weight = (60 / ((counts > 0).sum() * counts))[level] if balanced else np.ones(60)
        brute[key] = brute_tree(x, level, weight, levels, criterion, depth, max_leaves, 5)
        rows += [(key, i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, level))]
    d = spark.createDataFrame(rows, "key int, id int, a double, b double, c double, cls int")
    splits = trees.grown(d, ["key"], ["a", "b", "c"], "cls", levels, criterion, depth, max_leaves, 5, balanced)
    got = {0: {}, 1: {}}
    for r in splits.collect():
        got[r.key][r.node] = (r.feature, pytest.approx(r.tau))
    assert got == brute
    said = trees.predicted(d, d, splits, ["key"], ["a", "b", "c"], "cls", levels, criterion, depth, balanced)
    assert said.count() == 120 and said.filter("predicted is null").count() == 0


def test_meta_thresholds_follow_the_signal(spark):
    rng = np.random.default_rng(9)
    rows = [(s, i, float(v), int(2 - (v > 0.3) - (v > 0.7)), int(i % 5 == s % 5)) for i, v in enumerate(rng.random(100)) for s in range(5)]
    d = spark.createDataFrame(rows, "split int, id int, x double, cls int, role int")
    m = trees.meta_thresholds(d, "split", "role", "x", "cls").first()
    assert m.direction == -1 and abs(m.threshold_1 - 0.3) < 0.05 and abs(m.threshold_2 - 0.7) < 0.05 and (m.fallbacks, m.degenerate) == (0, 0)
    v = trees.out_of_bag_votes(d, "split", "role", "id", ["x"], "cls")
    right = v.join(d.select("id", "cls").distinct(), "id").filter("vote = cls").count()
    assert v.count() == 100 and right >= 90


def test_folds_at_once_equal_folds_one_by_one(spark, blobs):
    x = blobs[:60]
    d = frame(spark, x).withColumn("y", (F.col("id") % 2).cast("int"))
    splits = R.stratified_splits(d.select("id", "y"), "id", "y", 3)
    for block in (4096, 17):
        e = V.knn_folds(d.select("id", "v").join(R.fold_roles(splits, "id"), "id"), 4, block=block)
        got = {(r.fold, r.q, r.n, r.rk) for r in e.collect()}
        want = set()
        for f in range(3):
            role = {r.id: r.role for r in splits.filter(F.col("split") == f).collect()}
            of = lambda k: frame(spark, x).filter(F.col("id").isin([i for i, r in role.items() if r == k]))
            want |= {(f, r.q, r.n, r.rk) for r in V.knn(of(0), 4, queries=of(1)).collect()}
        assert got == want
        # Too short a list for any fold: what it lacks is found in the folds themselves.
        e = V.knn_folds(d.select("id", "v").join(R.fold_roles(splits, "id"), "id"), 4, block=block, wide=3)
        assert {(r.fold, r.q, r.n, r.rk) for r in e.collect()} == want
    nested = R.nested_roles(splits, "id", "y").collect()
    for r in nested:
        for s in range(3):
            outer, *inner = r.roles[4 * s : 4 * s + 4]
            assert inner == [2, 2, 2] if outer else sorted(inner) == [0, 0, 1]


@pytest.mark.parametrize("wide, n_splits", [(None, 30), (4, 2)])
def test_grid_over_splits_equals_votes_of_ranked_edges_and_shuffles_no_votes(spark, blobs, wide, n_splits):
    d = frame(spark, blobs[:60]).withColumn("y", F.when(F.col("id") != 7, (F.col("id") % 2).cast("int"))).withColumn("c", 1.0 / (1 + F.col("id") % 3))
    splits = R.stratified_splits(d.select("id", "y"), "id", "y", n_splits)
    truth, ks = d.select("id", "y", "c"), (1, 3, 5)
    got = MO.grid_over_splits(d.select("id", "v"), truth, splits, ks, wide=wide)
    if wide is None:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for metric in MO.GRID_METRICS:
        e = V.knn_folds(d.select("id", "v").join(R.fold_roles(splits, "id"), "id"), 5, metric).join(truth.withColumnRenamed("id", "n"), "n")
        want |= {(f"{r.config}_{metric}", r.fold, r.q): r.p for r in MO.knn_grid(e, list(ks), keys=("fold",)).collect()}
    got = {(r.config, r.fold, r.q): (r.p, r.y) for r in got.collect()}
    assert got.keys() == want.keys() and all(p == (None if want[x] is None else pytest.approx(want[x])) for x, (p, _) in got.items())
    assert all(y == (None if q == 7 else q % 2) for (_, _, q), (_, y) in got.items())


def test_tfidf_reads_its_words_once(spark):
    words = F.filter(F.split(F.regexp_replace("text", "[0-9]", ""), " "), lambda w: F.char_length(w) > 1)
    d = spark.createDataFrame([(1, "ab ab cd 12"), (2, "ab"), (3, "7"), (4, None)], "id long, text string").select("id", words.alias("w"))
    t = fe.tfidf(d, "id", "w")
    got = {(r.id, r.term): r.weight for r in t.collect()}
    plan = t._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("regexp_replace") == 1
    a, c = 2 * (math.log(5 / 3) + 1), math.log(5 / 2) + 1
    assert got == {(1, "ab"): pytest.approx(a / math.hypot(a, c)), (1, "cd"): pytest.approx(c / math.hypot(a, c)), (2, "ab"): 1.0}


def test_svd_computes_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    t = spark.createDataFrame([(i, f"t{j}", 1.0 + i * j) for i in range(5) for j in range(4)], "id long, term string, weight double")
    fe.svd_parts(t.mapInArrow(counted, t.schema), "id", 1)
    assert read.value == 20


def test_kernel_sums_and_signals_equal_brute_force(spark, blobs):
    x = blobs[:50]
    w, y = np.arange(50) % 5 + 1.0, (np.arange(50) % 3) / 2
    pr = spark.createDataFrame([(i, r.tolist(), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, w, y))], "id long, v array<double>, w double, y double")
    for alone in (False, True):
        k = w * np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 3.0**2)) ** 2
        if alone:
            np.fill_diagonal(k, 0)
        got = {r.q: r for r in AT.kdm_signals(V.kernel_sums(frame(spark, x), pr, 3.0, alone, block=16)).collect()}
        share = k / k.sum(1, keepdims=True)
        assert [got[i].p for i in range(50)] == pytest.approx((share @ y).tolist())
        assert [got[i].max_weight for i in range(50)] == pytest.approx(share.max(1).tolist())
        assert all(r.epistemic >= -1e-9 for r in got.values())


def test_severity_has_the_seven_groups_of_rules(spark):
    def graded(*v):
        r = spark.range(1).select(V.severity(*map(F.lit, v)).alias("s")).first().s
        return r.score, r.grade, len(r.advice)

    assert graded(0.0, 0.0, 32.0, 64.0, 32.0, 0.1, 0.9, -2.0) == (0, "low", 1)
    assert graded(2.5, 0.0, 32.0, 64.0, 32.0, 0.1, 0.9, -2.0) == (1, "low", 1)
    assert graded(6.0, 0.4, 6.0, 64.0, 6.0, 0.9, 0.4, -0.5) == (11, "high", 7)
    assert graded(0.0, 0.0, float("nan"), 64.0, 10.0, 0.1, 0.9, -0.5) == (2, "medium", 2)


def test_analysis_gives_the_whole_report(spark, blobs):
    r = V.analysis(frame(spark, blobs)).first()
    assert r.input_rows == 120 and r.width == 8 and r.suggested.k == 5 and 4 <= r.suggested.dimension <= 8
    assert 1 <= r.intrinsic.consensus <= 12 and r.kernel.effective_rank > 1 and r.kernel.condition_number >= r.kernel.spectral_gap >= 1
    assert 0.5 < r.geometry.consistency <= 1 and r.severity.grade in ("low", "medium", "high")
    small = V.analysis(frame(spark, blobs), n_max=60).first()
    assert small.input_rows == 120 and small.hubness.n == 60
    k = V.kernel_spectrum(frame(spark, blobs), 3.0)
    full = np.exp(-((blobs[:, None] - blobs[None]) ** 2).sum(2) / 18)
    lam = np.sort(np.linalg.eigvalsh(full))[::-1][:50]
    assert k["spectral_gap"] == pytest.approx(lam[0] / lam[1], rel=1e-6)


def test_local_dimension_of_a_plane(spark):
    x = np.zeros((400, 6))
    x[:, :2] = np.random.default_rng(1).random((400, 2))
    e = V.knn(frame(spark, x), 20)
    d = V.intrinsic_dimension(e, 20).crossJoin(V.correlation_dimension(V.pairs(frame(spark, x)), e)).first()
    assert all(1.5 < v < 2.6 for v in (d.two_nn, d.mle, d.mom, d.corr_int, d.consensus)) and V.isotropy(frame(spark, x))["l_pca"] == 2


def test_vector_labels_and_equal_classes_agree_on_one_hot(spark, blobs):
    b = frame(spark, blobs)
    kernel = V.rbf(V.pairs(b), V.median_sigma(V.pairs(b)))
    one_hot = spark.createDataFrame([(i, [float(i // 40 == k) for k in range(3)]) for i in range(120)], "id long, y array<double>")
    labels = spark.createDataFrame([(i, i // 40) for i in range(120)], "id long, label int")
    assert V.vector_label_alignment(kernel, one_hot).first()[0] == pytest.approx(V.kernel_alignment(kernel, labels).first()[0], abs=1e-6)


def test_c_index_in_any_buckets(spark):
    rng = np.random.default_rng(3)
    t, p, e = rng.integers(0, 40, 300), rng.integers(0, 200, 300) / 4, rng.integers(0, 2, 300)
    d = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(t, p, e)], "t double, p double, e int")
    first = (t[:, None] < t[None]) & (e[:, None] == 1)
    won = np.where(p[:, None] < p[None], 1.0, np.where(p[:, None] == p[None], 0.5, 0.0))[first].sum()
    for buckets in (1, 8, 64):
        r = EV.c_index(d, "t", "p", "e", buckets).first()
        assert (r.c_index, r.pairs) == (pytest.approx(won / first.sum()), first.sum())
    assert {r.t: r.pairs for r in EV.comparable_pairs(d, "t", "e").collect()} == {float(v): int(first[t == v].sum()) for v in np.unique(t) if first[t == v].sum()}


def test_fuzzy_votes(spark):
    e = spark.createDataFrame([(1, 1, 1.0, 0.0), (1, 0, 1.0, 2.0), (2, 1, 0.5, 1.0), (2, 0, 0.25, 1.0)], "q long, y int, c double, dist double")
    assert {r.q: r.p for r in MO.knn_vote(e, ["q"], weighted=True).collect()} == {1: 1.0, 2: 0.5}
    p = {r.q: r.p for r in MO.fuzzy_vote(e, ["q"]).collect()}
    assert p[2] == pytest.approx((0.75 + 0.375) / 2) and 0 <= p[1] <= 1


def test_metrics_on_one_class_and_ties(spark):
    d = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.5), (1, 1, 0.5), (1, 0, 0.5)], "k int, y int, p double")
    assert {r.k: r.auc for r in M.roc_auc(d, ["k"], "y", "p").collect()} == {0: None, 1: 0.5}
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert M.quadratic_kappa(same, [], "a", "b").first().kappa is None
    m = M.mcnemar(spark.createDataFrame([(1, 1, 0)] * 5, "y int, a int, b int"), [], "y", "a", "b").first()
    assert (m.only_a, m.only_b) == (5, 0) and m.p_value == pytest.approx(2 * 0.5**5)


def test_survival_edges(spark):
    tied = spark.createDataFrame([(5.0, 1.0, 0), (5.0, 2.0, 0)], "t double, p double, e int")
    assert EV.c_index(tied, "t", "p", "e").first().c_index is None
    assert [r.g for r in EV.censoring_km(tied, "t", "e").collect()] == [0.0]
    assert all(r.auc is None for r in EV.time_dependent_auc(tied, "t", "p", "e").collect())
    ordered = spark.createDataFrame([(float(t), float(t), 1) for t in range(1, 60)], "t double, p double, e int")
    assert EV.c_index(ordered, "t", "p", "e").first().c_index == 1.0
    assert {r.horizon: r.auc for r in EV.time_dependent_auc(ordered, "t", "p", "e").collect()}[24.0] == pytest.approx(1.0)


def test_evaluator_edges(spark):
    d = spark.createDataFrame([(1, {"psa": "decisive", "vol": "bad"}, {"psa": "not_revealed"}, ["a", None, "a"], [])], "id int, g map<string,string>, p map<string,string>, t array<string>, u array<string>")
    assert EV.weight_score(d, ["id"], "g", "p").first().weight_score == 0.0
    r = d.select(EV.factor_score("g", "p").alias("f"), EV.tool_precision("t", "u").alias("u"), EV.tool_precision("u", "t").alias("x"), sets.set_f1("u", "u").alias("e"), S.ordered_distinct("t").alias("o")).first()
    assert (r.f, r.u, r.x, r.e, r.o) == (0.0, 1.0, 0.0, 1.0, ["a"])


def test_shapley_sums_to_the_difference(spark):
    rng = np.random.default_rng(2)
    mem, q = rng.random((20, 3)), rng.random(20)
    x = rng.random((4, 3))
    for r, v in zip(AT.exact_shapley(frame(spark, x), mem, q, mem[:5]).orderBy("id").collect(), x):
        assert sum(r["values"]) == pytest.approx(AT.fuzzy_p(v[None], mem, q, 3)[0] - AT.fuzzy_p(mem[:5], mem, q, 3).mean())


def test_augmentation_and_losses(spark, blobs):
    b = frame(spark, blobs)
    assert L.with_noise(b, "id", "v", 0.1).orderBy("id").collect() == L.with_noise(b.repartition(5), "id", "v", 0.1).orderBy("id").collect()
    noise = np.array([r.v for r in L.with_noise(b, "id", "v", 1.0).orderBy("id").collect()]) - blobs
    assert abs(noise.mean()) < 0.1 and abs(noise.std() - 1) < 0.1
    share = np.mean([x == 0 for r in L.with_dropout(b, "id", "v", 0.3).collect() for x in r.v])
    assert abs(share - 0.3) < 0.06


def test_random_views(spark, blobs):
    b = frame(spark, blobs)
    lam = np.array([r[0] for r in spark.range(4000).select(L.beta_share("id")).collect()])
    assert 0 < lam.min() and lam.max() < 1 and abs(lam.mean() - 0.5) < 0.03 and abs(lam.var() - 1 / 7.2) < 0.01
    edges = V.knn(b, 5).persist()
    one, two = ({r.q: r.n for r in L.random_neighbour(edges, s).collect()} for s in (1, 2))
    near = {(r.q, r.n) for r in edges.collect()}
    assert set(one.items()) <= near and len(one) == 120 and sum(one[q] != two[q] for q in one) > 60
    mixed = {r.id: np.array(r.v) for r in L.mixed_up(b, "id", "v", L.random_neighbour(edges), F.lit(1.0)).collect()}
    assert all(np.allclose(mixed[i], blobs[i]) for i in range(120))
    out = L.one_of(b, "id", "v", lambda d: d, lambda d: d.withColumn("v", F.transform("v", lambda x: x * 0))).collect()
    zero = sum(not any(r.v) for r in out)
    assert len(out) == 120 and 30 < zero < 90


def test_mcnemar_of_large_counts(spark):
    d = spark.createDataFrame([(1, 1, 0)] * 60 + [(1, 0, 1)] * 40, "y int, a int, b int")
    p = M.mcnemar(d, [], "y", "a", "b").first().p_value
    assert p == pytest.approx(2 * sum(math.comb(100, i) for i in range(41)) / 2**100)
    even = spark.createDataFrame([(1, 1, 0)] * 5 + [(1, 0, 1)] * 5, "y int, a int, b int")
    assert M.mcnemar(even, [], "y", "a", "b").first().p_value == 1.0


def test_clusters_and_representatives():
    rho = {("a", "b"): 0.95, ("a", "c"): 0.1, ("b", "c"): 0.2, ("c", "d"): 0.9, ("a", "d"): 0.1, ("b", "d"): 0.1}
    c = fe.complete_linkage(list("abcd"), rho, 0.8)
    assert c["a"] == c["b"] != c["c"] == c["d"] and fe.representatives(c, rho, {"b"}) == ["b", "c"]


def test_sources(spark, tmp_path):
    for case, age, extra in (("PT-1", 60, True), ("PT-2", "NONE", False)):
        (tmp_path / "cases" / case).mkdir(parents=True)
        (tmp_path / "cases" / case / "s.json").write_text(json.dumps({"age": str(age), "notes": [{"s": "a", "t": "b"}]}, indent=1))
        if extra:
            (tmp_path / "cases" / case / "d.json").write_text('"yes"')
            (tmp_path / "cases" / case / "r.json").write_text('{"confidence": "clear"}')
    (tmp_path / "cases" / "PT-3").mkdir()
    (tmp_path / "cases" / "PT-3" / "s.json").write_text("{broken")
    t = readers.case_table(spark, f"{tmp_path}/cases", {"s": ("s.json", "age string, notes array<struct<s:string,t:string>>"), "d": ("d.json", "string")})
    r = {x.case_id: x for x in t.select("case_id", S.safe_float("s.age").alias("age"), "d").collect()}
    assert r["PT-1"].age == 60 and r["PT-2"].age is None and r["PT-2"].d is None and r["PT-3"].age is None
    truth = readers.ground_truth(spark, f"{tmp_path}/cases", "d.json", "r.json", "confidence string").collect()
    assert [(x.case_id, x.decision, x.confidence) for x in truth] == [("PT-1", "yes", "clear")]
    (tmp_path / "a.csv").write_text("k,v\n1,2.5\n2,\n3,NA\n4,n/a\n")
    for nulls in ("strict", "coerce"):
        assert [x.v for x in readers.csv_table(spark, f"{tmp_path}/a.csv", "k int, v double", nulls).orderBy("k").collect()] == [2.5, None, None, None]
    assert readers.csv_table(spark, f"{tmp_path}/a.csv", "k int, v string").filter("v is null").count() == 1
    d = spark.range(3)
    readers.save_bundle(f"{tmp_path}/b", {"k": 1}, rows=d)
    config, tables = readers.load_bundle(spark, f"{tmp_path}/b")
    assert config["k"] == 1 and tables["rows"].count() == 3
    assert readers.manifest(spark, f"{tmp_path}/a.csv").first().length == len("k,v\n1,2.5\n2,\n3,NA\n4,n/a\n")
    (tmp_path / "p.json").write_text(json.dumps([{"pk": "1", "inputs": [{"socket": {"slug": s, "relative_path": s}, "value": s} for s in ("b", "a")], "outputs": []}]))
    j = readers.jobs(spark, f"{tmp_path}/p.json", {"a|b": "task1"}).withColumn("x", readers.input_value("inputs", ["z", "b"])).first()
    assert (j.task, j.x) == ("task1", "b")
    readers.write_csv(d, f"{tmp_path}/out", ["id", "absent"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["id", "absent"]
    v = spark.createDataFrame([("[[1, 2]]",), ("[3.5]",)], "x string").select(readers.first_vector(F.col("x")).alias("v")).collect()
    assert [x.v for x in v] == [[1.0, 2.0], [3.5]]


def test_streams_give_the_batch_rows(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/in")
    stream = scores.windowed_rates(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.event_type, r.n, round(r["mean"], 9))
    assert sorted(map(key, spark.table("rates").collect())) == sorted(map(key, scores.windowed_rates(e).collect()))


def test_checks_raise(spark):
    with pytest.raises(ValueError, match="is in"):
        sets.assert_disjoint(a=["x"], b=["x"])
    with pytest.raises(ValueError, match="expected 3"):
        S.with_prefixes(spark.range(1), "id", "i", expect=3)
    assert math.isclose(S.CERTAINTY["borderline"], 0.5)


def test_lemmas(spark):
    said = {"studies": "study", "classes": "class", "watches": "watch", "cats": "cat", "bus": "bus", "tried": "try", "stopped": "stop", "scanning": "scan", "dated": "date", "treated": "treat", "used": "use", "increased": "increase", "making": "make", "showing": "show", "enlarged": "enlarge", "sizes": "size", "men": "man", "was": "be", "biopsies": "biopsy", "bed": "bed", "mri-guided": "mri-guid", "": ""}
    got = {r.w: r.l for r in spark.createDataFrame([(w,) for w in said], "w string").select("w", S.lemma(F.col("w")).alias("l")).collect()}
    assert got == said
    df = spark.createDataFrame([("The studies were not stopped; 3 scans, three x",), (None,)], "t string")
    assert [r[0] for r in df.select(S.clean_tokens("t")).collect()][0][:3] == ["study", "not", "stop"]
    assert df.select(S.clean_tokens("t", lemmas={"studies": "work"})).first()[0][0] == "work"


def test_digests_see_rows_not_their_order(spark):
    rows = [(i, None if i % 7 == 0 else float(i), str(i % 5), [i, i + 1]) for i in range(200)]
    one = spark.createDataFrame(rows, "a long, b double, c string, d array<int>")
    base = R.digest(one).first()
    assert R.digest(one.repartition(7, "c").select("d", "c", "a", "b")).first() == base
    assert R.digest(one.unionAll(one.limit(1))).first() != base and R.digest(one.withColumn("b", F.coalesce("b", F.lit(0.0)))).first() != base
    swapped = one.select("a", F.lit(None).cast("double").alias("b"), "c", "d")
    assert R.digest(swapped.limit(1)).first() != R.digest(one.filter("a = 1")).first() and R.digest(one.limit(0)).first().rows == 0
    assert [r.same for r in R.run_twice(lambda n: one.repartition(n)).collect()] == [True, True]
    assert [r.same for r in R.run_twice(lambda n: one.limit(10 * n)).orderBy("run").collect()] == [True, False]


def test_randomised_svd_equals_the_dense_one(spark):
    rng = np.random.default_rng(4)
    dense = (rng.normal(size=(60, 6)) * [9, 7, 5, 3, 2, 1]) @ rng.normal(size=(6, 40)) * (rng.random((60, 40)) < 0.6)
    rows = spark.createDataFrame([(i, f"t{j:02}", float(dense[i, j])) for i in range(60) for j in range(40) if dense[i, j]], "doc long, term string, weight double").repartition(5)
    z, load, sigma = fe.svd_parts(rows, "doc", 4)
    u, s, v = np.linalg.svd(dense)
    assert sigma == pytest.approx(s[:4], rel=1e-3)
    got = np.array([r.z for r in z.orderBy("doc").collect()])
    loads = np.array([r.v for r in load.orderBy("term").collect()])
    # The residual is hardly above the best one, and scores are the table times the loadings.
    best = np.linalg.norm(dense - u[:, :4] * s[:4] @ v[:4])
    assert np.linalg.norm(dense - got @ loads.T) < 1.01 * best and np.allclose(dense @ loads, got, atol=0.02 * s[0])
    assert (loads[np.abs(loads).argmax(0), range(4)] > 0).all()
    unit = fe.svd(rows, "doc", 4).groupBy("doc").agg(F.sum(F.col("z") ** 2).alias("l")).collect()
    assert all(r.l == pytest.approx(1) for r in unit)
    few = fe.svd_parts(rows.filter("term < 't03'"), "doc", 10)
    assert len(few[2]) == 2


def test_correlation_with_a_constant_merged_from_parts(spark):
    # 49 * (1 / 49) isn't 1: parts of 49 rows merge to a mean that differs from that of the other.
    r = spark.range(0, 98, 1, 2).selectExpr("cast(id as double) as x", "1.0D as one", "case when id % 7 > 0 then 2.0D * id end as y")
    got = r.agg(AG.pearson("x", "one").alias("flat"), AG.pearson("x", "y").alias("line")).first()
    assert got.flat is None and got.line == pytest.approx(1)


def test_decimals_by_the_exact_value(spark):
    want = {0.365: "0.36", 0.725: "0.72", 0.125: "0.12", 0.375: "0.38", 0.005: "0.01", 1.0: "1.00", 0.815: "0.81", None: None}
    r = spark.createDataFrame([(x,) for x in want], "x double").select("x", S.fixed("x", 2).alias("t"))
    assert {x.x: x.t for x in r.collect()} == want


def test_the_meta_model_reads_nested_probabilities_once(spark, sf, monkeypatch):
    from caseforge.plans import vector_queries as Q

    reads, plain = spark.sparkContext.accumulator(0), Q._nested

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    def nested(*a):
        n = plain(*a)
        return n.mapInArrow(counted, n.schema)

    monkeypatch.setattr(Q, "_nested", nested)
    rows = Q.meta_model(spark, sf).count()
    assert rows == 5 * 100
    assert reads.value <= 2 * 5 * 500  # each level of the tree read them before


def test_a_term_of_the_svd_is_drawn_once_a_task(spark, monkeypatch):
    taken, drawn, plain = [], [], fe._drawn

    class Taken(Exception):
        pass

    def take(rows, width, f):
        taken.append(f)
        raise Taken

    monkeypatch.setattr(fe, "_per_task", take)
    monkeypatch.setattr(fe, "_drawn", lambda t, *a: drawn.append(t) or plain(t, *a))
    with pytest.raises(Taken):
        fe.svd_parts(spark.createDataFrame([(d, t, 1.0) for d in range(4) for t in "abc"], "doc long, term string, weight double"), "doc", 2)
    x = {t: plain(t, 42, 3) for t in "ab"}
    assert taken[0](["a", "b"], [1.0, 2.0], None) == pytest.approx(x["a"] + 2 * x["b"]) and taken[0](["b"], [1.0], None) == pytest.approx(x["b"])
    assert drawn == ["a", "b"]
