import json

import numpy as np
import pytest

from caseforge.operators import kdm as KD
from caseforge.operators import network as N
from caseforge.operators import shapley as SH
from caseforge.operators.refine import Refiner, auto_config
from caseforge.operators.vectors import kernel_sums


def rows_of(spark, x, y, roles=None, parts=3):
    data = [(i, v.tolist(), float(c), [0] if roles is None else roles[i]) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, v array<double>, y double, roles array<int>").repartition(parts, "id")


@pytest.fixture(scope="module")
def two_classes():
    rng = np.random.default_rng(0)
    y = np.arange(60) % 2
    return rng.normal(size=(60, 4)) + 1.5 * y[:, None], y.astype(float)


def nudged(f, p, key, at, h=1e-5):
    out = []
    for s in (h, -h):
        q = {k: v.copy() for k, v in p.items()}
        q[key] = np.array(q[key], float)
        q[key][at] += s
        out.append(f(q))
    return (out[0] - out[1]) / (2 * h)


# Kernel density models


@pytest.mark.parametrize("config", [KD.Config(x_train=True, y_train=True, eps=0.1), KD.Config(2.0, True, True, "linear", 0.2)])
def test_kdm_gradient_is_the_slope_of_the_loss(two_classes, config):
    x, y = two_classes
    rng = np.random.default_rng(1)
    p = KD.start(x[:12], y[:12], config)
    own = np.where(np.arange(60) < 12, np.arange(60), -1)
    t = np.clip(y + rng.normal(0, 0.1, 60), 0, 1)
    weight = rng.random(60)
    loss = lambda q: KD.gradient(q, [], x, t, weight, own)[0]
    g = KD.gradient(p, KD.trained_parts(config), x, t, weight, own)[1]
    assert set(g) == set(KD.trained_parts(config))
    for key, at in (("logits", 3), ("log_sigma", ()), ("amplitude", (2, 1)), ("x", (4, 1)), *([("encoder", (1, 2))] if config.encoder == "linear" else [])):
        assert g[key][at] == pytest.approx(nudged(loss, p, key, at), rel=1e-4, abs=1e-7)


def test_kdm_on_executors_equals_one_fit_in_memory(spark, two_classes):
    x, y = two_classes
    roles = [[int(i % 5 == s) for s in range(2)] for i in range(60)]
    configs = [KD.Config(1.0, True, True, "linear", 0.1), KD.Config(0.5)]
    got = KD.fit(rows_of(spark, x, y, roles), configs, epochs=4, rate=0.05, prototypes=60)
    again = KD.fit(rows_of(spark, x, y, roles, 3), configs, epochs=4, rate=0.05, prototypes=60)
    for c, config in enumerate(configs):
        for s in range(2):
            train = np.array([r[s] == 0 for r in roles])
            p = KD.start(x, y, config)
            p["logits"] = np.where(train, p["logits"], -np.inf)
            m = KD.Adam(p, KD.trained_parts(config), 0.05)
            for _ in range(4):
                g = KD.gradient(m.p, m.parts, x, y, train.astype(float), np.arange(60))[1]
                m.move({k: np.nan_to_num(v) / train.sum() for k, v in g.items()})
            for k in m.p:
                assert np.allclose(m.p[k], got.models[c][s][k]) and (again.models[c][s][k] == got.models[c][s][k]).all()


def test_kdm_loss_falls_hard_labels_stay_and_held_out_rows_are_told(spark, two_classes):
    x, y = two_classes
    configs = [KD.Config(y_train=True), KD.Config(y_train=True, eps=0.2)]
    roles = [[int(i % 5 == 0)] for i in range(60)]
    rows = rows_of(spark, x, y, roles)
    t = KD.fit(rows, configs, epochs=15, rate=0.05, prototypes=30)
    assert len(t.ids) == 30 and (t.losses[-1] < 0.98 * t.losses[0]).all()
    assert t.drift(0).max() < 1e-12 and t.drift(1).max() > 1e-4
    g = KD.grid(rows, configs, epochs=3, rate=0.05, prototypes=30).collect()
    assert len(g) == 2 and all(r.macro_f1 > 0.65 and 0 <= r.sensitivity <= 1 for r in g)
    scored = {r.id: r.p for r in KD.scored(rows, t).filter("config = 0 and split = 0").collect()}
    # Two votes under one prototype set: that of the scoring plan and that of the fit.
    sums = {r.q: r.sy / r.s for r in kernel_sums(rows.select("id", "v"), t.prototypes(spark), t.sigma(), leave_self_out=True).collect()}
    assert all(scored[i] == pytest.approx(sums[i], abs=1e-6) for i in range(60))
    assert (len(KD.GRID), len(KD.GRID_SMOOTHED)) == (32, 18) and len(set(KD.GRID)) == 32


def test_a_narrow_kernel_gives_back_each_prototypes_label(two_classes):
    x, y = two_classes
    for config in (KD.Config(), KD.Config(encoder="linear", eps=0.1)):
        p = KD.start(x, y, config)
        p["log_sigma"] = np.array(np.log(1e-3))
        assert np.abs(KD.shares(p, x, None)[2] @ KD.label(p) - KD.amplitudes(y, config.eps)[:, 1] ** 2).max() < 1e-4


def test_kdm_of_nothing(spark, two_classes):
    rows = rows_of(spark, *two_classes).limit(0)
    t = KD.fit(rows, [KD.Config()], epochs=2)
    assert t.ids == [] and KD.scored(rows, t).count() == 0


# The refiner


@pytest.mark.parametrize("name", sorted(N.LOSSES))
def test_loss_gradients(name):
    rng = np.random.default_rng(3)
    a, b, labels = rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), np.arange(9) % 3
    _, ga, gb = N.LOSSES[name](a, b, labels)
    loss = lambda q: N.LOSSES[name](q["a"], q["b"], labels)[0]
    for at in ((0, 1), (5, 3), (8, 0)):
        assert ga[at] == pytest.approx(nudged(loss, {"a": a, "b": b}, "a", at), rel=1e-4, abs=1e-8)
        assert gb[at] == pytest.approx(nudged(loss, {"a": a, "b": b}, "b", at), rel=1e-4, abs=1e-8)


@pytest.mark.parametrize("n_layers", [0, 1, 3])
def test_network_gradients(n_layers):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(12, 5)), rng.normal(size=(12, 5))
    p, state = N.start(5, 3, 16, n_layers, 1)

    def loss(q):
        (a, _), (b, _) = (N.forward(q, state, v, np.random.default_rng(7), 0.2) for v in (x, y))
        return N.combined([(1.0, "nt_xent"), (0.5, "align_uniform")], a, b)[0]

    (a, ka), (b, kb) = (N.forward(p, state, v, np.random.default_rng(7), 0.2) for v in (x, y))
    _, ga, gb = N.combined([(1.0, "nt_xent"), (0.5, "align_uniform")], a, b)
    g, h = N.backward(p, ka, ga), N.backward(p, kb, gb)
    for key in p:
        at = tuple(s // 2 for s in p[key].shape)
        assert g[key][at] + h[key][at] == pytest.approx(nudged(loss, p, key, at), rel=2e-3, abs=1e-6)


def test_schedules_and_optimizers():
    s = N.Schedule("cosine", 2, 5)
    s.step = 5
    assert s.now() == pytest.approx(0.5)
    s = N.Schedule("step", 6, 2)
    s.step = 4
    assert s.now() == pytest.approx(0.1)
    s = N.Schedule("plateau", 1, 1)
    for v in (1.0, *[1.0] * 6):
        s.evaluated(v)
    assert s.now() == pytest.approx(0.1)
    for name in ("adam", "sgd", "lars"):
        p, o = {"w": np.array([3.0])}, N.Optimizer(name, 0.02)
        for _ in range(300):
            o.move(p, {"w": 2 * p["w"]}, 1.0)
        assert abs(p["w"][0]) < 0.2
    with pytest.raises(ValueError):
        N.Optimizer("other", 0.1)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(30, 6)) + 3 * np.eye(6)[k] for k in range(4)])
    return spark.createDataFrame([(i, v.tolist(), i // 30) for i, v in enumerate(x)], "id long, v array<double>, y int").repartition(4)


def test_refiner_learns_stops_reloads_and_reruns_agree(spark, table):
    options = dict(hidden=16, n_layers=1, epochs=6, batch=24, replicas=2, rate=0.01, eval_every=1, losses=[(1.0, "supcon"), (0.5, "align_uniform")])
    r = Refiner(4, **options).fit(table)
    assert r.n_train + r.n_val == 120 and r.n_val > 2 and r.n_batches == r.n_train // 24
    assert r.history["loss"][-1] < 0.98 * r.history["loss"][0] and len(r.history["uniformity"]) == 6
    again = Refiner(4, **options).fit(table.repartition(2))
    assert all((again.params[k] == r.params[k]).all() for k in r.params)
    loaded = Refiner.load(json.loads(json.dumps(r.save())))
    a, b = (np.array([x.v for x in m.transform(table).orderBy("id").collect()]) for m in (r, loaded))
    assert np.allclose(a, b) and np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-6)
    # Rows of one label are nearer each other than before.
    s = a @ a.T
    same = np.arange(120)[:, None] // 30 == np.arange(120) // 30
    assert s[same].mean() > s[~same].mean() + 0.3
    stopped = Refiner(4, **options | {"patience": 1, "rate": 0.0, "decay": 0.0, "monitor": "isotropy", "epochs": 9}).fit(table)
    assert stopped.stopped_epoch < 9
    with pytest.raises(ValueError):
        Refiner(4, monitor="other")


def test_refiner_of_few_rows(spark, table):
    assert Refiner(2, hidden=4).fit(table.limit(0)).stopped_epoch == 0
    few = Refiner(2, hidden=4, epochs=1, eval_every=1, val_split=0.0).fit(table.filter("id < 5"))
    assert few.n_batches == 1 and few.transform(table.filter("id < 5")).count() == 5
    assert Refiner(**auto_config({"target": 12.0}, True)).losses[0] == (1.0, "supcon")


# Kernel Shapley values


def exact(vote, x):
    from itertools import combinations
    from math import factorial

    m = len(x)
    value = {}
    for n in range(m + 1):
        for own in combinations(range(m), n):
            mask = np.zeros((1, m), bool)
            mask[0, list(own)] = True
            value[own] = vote.of_coalitions(x, mask)[0]
    weight = [factorial(n) * factorial(m - n - 1) / factorial(m) for n in range(m)]
    return np.array([sum(weight[len(s)] * (value[tuple(sorted((*s, i)))] - v) for s, v in value.items() if i not in s) for i in range(m)])


@pytest.mark.parametrize("m", [3, 6, 8])
def test_all_coalitions_give_the_exact_values(m):
    rng = np.random.default_rng(m)
    memory, labels = rng.normal(size=(30, m)), rng.integers(0, 2, 30).astype(float)
    vote = SH.Vote(memory, labels, memory[:5])
    for x in rng.normal(size=(4, m)):
        got = SH.values_of(x, vote, 2**m, None, rng)
        assert got == pytest.approx(exact(vote, x), abs=1e-9)


def test_sampled_values_add_up_and_few_features_are_chosen(spark):
    rng = np.random.default_rng(8)
    memory, labels = rng.normal(size=(60, 64)), rng.integers(0, 2, 60).astype(float)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(12, 64)))] + [(20, None), (21, [None] * 64), (22, [1.0])]
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(3)
    vote = SH.Vote(memory, labels, memory[:5])
    got = {r.id: r for r in SH.kernel_shap(df, memory, labels, memory[:5]).collect()}
    again = {r.id: r["values"] for r in SH.kernel_shap(df.repartition(1), memory, labels, memory[:5]).collect()}
    for i, v in data[:12]:
        r = got[i]
        assert r.vote == vote.of_row(np.array(v)) and sum(r["values"]) == pytest.approx(r.vote - vote.base, abs=1e-9)
        assert sum(x != 0 for x in r["values"]) <= 10 and r["values"] == again[i]
    assert all(got[i]["values"] is None and got[i].vote is None for i in (20, 21, 22))
    fam = SH.by_family(SH.kernel_shap(df.limit(3), memory, labels, memory[:5]), ["a", "a__is_missing", *(f"f{k}" for k in range(62))])
    assert fam.filter("column = 'a'").count() <= 3 and fam.select("column").distinct().count() == 63


def test_many_coalitions_come_near_the_exact_values():
    rng = np.random.default_rng(9)
    memory, labels = rng.normal(size=(40, 8)), rng.integers(0, 2, 40).astype(float)
    vote = SH.Vote(memory, labels, memory[:5], 5)
    x = rng.normal(size=8)
    want = exact(vote, x)
    error = np.mean([np.abs(SH.values_of(x, vote, 120, None, np.random.default_rng(k)) - want).max() for k in range(20)])
    assert error < 0.12


def test_coalitions_weigh_alike_with_their_complements():
    for m, budget in ((2, 10), (5, 30), (7, 40), (64, 20), (64, 400)):
        masks, weights = SH.coalitions(m, budget, np.random.default_rng(1))
        assert len(masks) <= max(budget, 2**min(m, 20) - 2 if budget >= 2**m - 2 else budget) and weights.sum() == pytest.approx(1)
        assert len({x.tobytes() for x in masks}) == len(masks) and masks.any(1).all() and not masks.all(1).any()


def test_least_angles_take_the_columns_of_the_signal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 20))
    assert SH.least_angles(x, 3 * x[:, 4] - 2 * x[:, 11] + x[:, 7], 3) == [4, 11, 7]
