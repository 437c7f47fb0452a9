import numpy as np
from pyspark.sql import functions as F

from caseforge.operators import blocks as B
from caseforge.operators import dimension as D
from caseforge.operators import pair_sums as PS
from caseforge.operators import vectors as V


def test_rows_are_shuffled_once_whatever_the_number_of_blocks(spark):
    x = np.random.default_rng(4).normal(size=(120, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for block in (4, 50, 4096):
        own = B.packed(df, block)
        assert 1 <= own.rdd.getNumPartitions() <= -(-120 // B.block_rows(120, 3, block))
        plan = B.walked(own, own)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        held = [r.n for r in B.met(own, own, half=True).groupBy("qb", "bb").agg(F.count("*").alias("n")).collect()]
        n = own.count()
        assert held == [1] * (n * (n + 1) // 2)
        got = {(r.q, r.rk): (r.n, r.dist) for r in V.knn(df, 3, block=block).collect()}
        for q in range(120):
            near = np.argsort(d[q])[:3]
            assert [got[q, k + 1][0] for k in range(3)] == near.tolist() and np.allclose([got[q, k + 1][1] for k in range(3)], d[q, near])


def test_blocks_stay_bounded():
    for n in (1, 500, 10_000, 100_000, 600_000, 10_000_000):
        rows = B.block_rows(n, 64)
        assert rows <= 4 * B.BLOCK and (n > 64 * 4 * B.BLOCK or -(-n // rows) <= 64) and B.block_rows(n, 1 << 20) <= 64


def test_single_precision_stays_so_in_blocks_and_nothing_else_is_lost(spark):
    x = np.random.default_rng(5).normal(size=(200, 64))
    size = {}
    for kind in (np.float32, float):
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x.astype(kind))], "id long, v array<double>")
        own = B.packed(df)
        size[kind] = own.agg(F.sum(F.length("rows"))).first()[0]
        held = {i: v for _, t, _, _ in B.unpacked([b for b in B.met(own, own, half=True).filter("qb = bb").toArrow().to_batches()]) for i, v in zip(t["id"].to_pylist(), t["v"].to_pylist())}
        assert np.array_equal(np.array([held[i] for i in range(200)]), x.astype(kind))
    assert size[np.float32] < 0.6 * size[float]


def test_a_report_packs_its_rows_once(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(80, 5))
    df, times = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), []
    plain = B.packed
    for module in (V, PS, D):
        monkeypatch.setattr(module, "packed", lambda rows, *a: times.append(rows.columns) or plain(rows, *a))
    r = V.analysis(df).first()
    # The rows, those with their neighbours, on the sphere, whitened, and three times with noise.
    assert len(times) == 7 and r.input_rows == 80 and 0 < r.geometry.consistency <= 1
