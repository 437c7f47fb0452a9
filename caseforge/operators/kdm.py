"""Kernel density models trained over all rows: many configurations and splits at once, gradients summed in the tasks.

A model holds at most ``MAX_PROTOTYPES`` prototypes, the labelled rows with the least hashes (a documented bound on what is fitted;
training and scoring take all rows), each with a vector, a log weight and a pair of amplitudes whose squares are its
label. A row's probability is the mean label of the prototypes, weighted by their weight and kernel. Every epoch is one job:
the parameters of all models go out by broadcast, a task adds up the loss and the gradients of the rows it reads, tasks
are added up in ``GROUPS`` groups on the executors, and so many sums come to the driver, which takes one step of
Adam. What the driver holds goes by prototypes and models, never by rows. Sums are taken in the order of the partitions,
so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import kept
from .resampling import subsample

MAX_PROTOTYPES, GROUPS = 1000, 4
LEAST_P, LEAST_SIGMA = 1e-7, 1e-3
#: Width of a learned encoder.
ENCODED = 8


@dataclass(frozen=True)
class Config:
    """``sigma_mult`` scales the first bandwidth; ``x_train`` and ``y_train`` let prototypes and their labels move; ``eps`` smooths labels; the encoder is ``identity`` or ``linear``."""

    sigma_mult: float = 1.0
    x_train: bool = False
    y_train: bool = False
    encoder: str = "identity"
    eps: float = 0.0


#: The grids of the studies, 32 and 18 configurations.
GRID = [Config(s, x, y, e) for s in (0.25, 0.5, 1.0, 2.0) for x in (True, False) for y in (True, False) for e in ("identity", "linear")]
GRID_SMOOTHED = [Config(s, False, True, e, eps) for s in (0.5, 1.0, 2.0) for eps in (0.05, 0.10, 0.20) for e in ("identity", "linear")]


def amplitudes(y: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """Pairs of amplitudes of soft or hard labels; ``eps`` moves them towards a half."""
    soft = np.clip(y, 0, 1) * (1 - eps) + eps / 2
    return np.sqrt(np.stack([1 - soft, soft], 1))


def _distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def start(x: np.ndarray, y: np.ndarray, c: Config, seed: int = 42) -> dict[str, np.ndarray]:
    """A model's first parameters: the same for all configurations but for what these say."""
    rng = np.random.default_rng(seed)
    out = {"logits": rng.normal(0, 0.01, len(x)), "amplitude": amplitudes(y, c.eps), "x": x.copy()}
    if c.encoder == "linear":
        out["encoder"] = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], min(ENCODED, x.shape[1])))
        out["x"] = x @ out["encoder"]
    d2 = _distances2(out["x"], out["x"])[~np.eye(len(x), dtype=bool)]
    out["log_sigma"] = np.array(np.log(max(LEAST_SIGMA, c.sigma_mult * np.sqrt(np.median(d2) / 2) if len(d2) else c.sigma_mult)))
    return out


def trained_parts(c: Config) -> list[str]:
    return ["logits", "log_sigma", *["amplitude"] * c.y_train, *["x"] * c.x_train, *["encoder"] * (c.encoder == "linear")]


def shares(p: dict[str, np.ndarray], v: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encoded rows, scaled squared distances and each prototype's share in a row's vote; ``own`` names the prototype that a row is (-1: none), which has no vote on it."""
    q = v @ p["encoder"] if "encoder" in p else v
    z = _distances2(q, p["x"]) * np.exp(-2 * p["log_sigma"])
    s = p["logits"] - z
    if own is not None:
        at = np.flatnonzero(own >= 0)
        s[at, own[at]] = -np.inf
    top = s.max(1, keepdims=True)
    k = np.exp(s - np.where(np.isfinite(top), top, 0))
    return q, z, k / np.maximum(k.sum(1, keepdims=True), 1e-300)


def label(p: dict[str, np.ndarray]) -> np.ndarray:
    return p["amplitude"][:, 1] ** 2 / (p["amplitude"] ** 2).sum(1)


def gradient(p: dict[str, np.ndarray], parts: list[str], v: np.ndarray, t: np.ndarray, weight: np.ndarray, own: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Sum of the rows' weighted log losses and its gradient by each of ``parts``."""
    q, z, share = shares(p, v, own)
    lab = label(p)
    raw = share @ lab
    prob = np.clip(raw, LEAST_P, 1 - LEAST_P)
    loss = float(-(weight * (t * np.log(prob) + (1 - t) * np.log(1 - prob))).sum())
    g = np.where(raw == prob, weight * (prob - t) / (prob * (1 - prob)), 0.0)
    pull = g[:, None] * share * (lab - prob[:, None])
    out, s2 = {"logits": pull.sum(0), "log_sigma": np.array((pull * 2 * z).sum())}, np.exp(-2 * p["log_sigma"])
    if "amplitude" in parts:
        a = p["amplitude"]
        out["amplitude"] = (g @ share)[:, None] * 2 * np.stack([-a[:, 0] * a[:, 1] ** 2, a[:, 1] * a[:, 0] ** 2], 1) / ((a**2).sum(1)[:, None] ** 2)
    if "x" in parts:
        out["x"] = -2 * s2 * (pull.sum(0)[:, None] * p["x"] - pull.T @ q)
    if "encoder" in parts:
        out["encoder"] = v.T @ (-2 * s2 * (pull.sum(1)[:, None] * q - pull @ p["x"]))
    return loss, {k: out[k] for k in parts}


class Adam:
    """One model's parameters, moved by the usual rule with bias-corrected moments."""

    def __init__(self, p: dict[str, np.ndarray], parts: list[str], rate: float):
        self.p, self.parts, self.rate, self.step = p, parts, rate, 0
        self.m, self.v = ({k: np.zeros_like(p[k]) for k in parts} for _ in range(2))

    def move(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k in self.parts:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            self.p[k] = self.p[k] - self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)


@dataclass
class Trained:
    """Models by configuration and split, the ids of their prototypes, and each epoch's mean loss."""

    configs: list[Config]
    ids: list[int]
    models: list[list[dict[str, np.ndarray]]]
    first: list[list[dict[str, np.ndarray]]]
    losses: np.ndarray

    def sigma(self, config: int = 0, split: int = 0) -> float:
        return float(np.exp(self.models[config][split]["log_sigma"]))

    def drift(self, config: int = 0, split: int = 0) -> np.ndarray:
        """How far each prototype's amplitudes moved."""
        return np.abs(self.models[config][split]["amplitude"] - self.first[config][split]["amplitude"]).max(1)

    def prototypes(self, spark, config: int = 0, split: int = 0) -> DataFrame:
        """``id, v, w, y`` for ``vectors.kernel_sums``; of an identity encoder."""
        p = self.models[config][split]
        w = np.exp(p["logits"] - p["logits"].max())
        return spark.createDataFrame([(int(i), x.tolist(), float(a), float(b)) for i, x, a, b in zip(self.ids, p["x"], w / w.sum(), label(p))], "id long, v array<double>, w double, y double")


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = batch.column(1)
    ids, roles = batch.column(0).to_numpy(), batch.column(3)
    return ids, np.asarray(v.flatten()).reshape(len(v), -1), batch.column(2).to_numpy(), np.asarray(roles.flatten()).reshape(len(roles), -1)


def fit(rows: DataFrame, configs: list[Config], epochs: int = 300, rate: float = 1e-3, prototypes: int = MAX_PROTOTYPES, leave_self_out: bool = True, seed: int = 42) -> Trained:
    """Models for each of ``configs`` and each split of ``rows(id, v, y, roles)``: ``roles[s]`` is 0 where the row trains in split ``s``; ``y`` is hard or soft.

    A split's prototypes are those of the bounded sample that train in it; the others have no weight there.
    """
    spark = rows.sparkSession
    rows = kept(rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), F.col("y").cast("double"), F.col("roles").cast("array<int>")))
    sample = subsample(rows, "id", prototypes, seed).orderBy("id").collect()
    if not sample:
        return Trained(configs, [], [[] for _ in configs], [[] for _ in configs], np.zeros((0, len(configs), 0)))
    ids, x, y, roles = (np.array([r[c] for r in sample]) for c in ("id", "v", "y", "roles"))
    n_splits = roles.shape[1]
    states = []
    for c in configs:
        p = start(x, y, c, seed)
        states.append([Adam({**{k: a.copy() for k, a in p.items()}, "logits": np.where(roles[:, s] == 0, p["logits"], -np.inf)}, trained_parts(c), rate) for s in range(n_splits)])
    first = [[{k: a.copy() for k, a in m.p.items()} for m in of] for of in states]
    place = {int(i): k for k, i in enumerate(ids)}
    parts = [(trained_parts(c), m.p) for c, of in zip(configs, states) for m in of]
    sizes = [1 + sum(p[k].size for k in names) for names, p in parts]
    n_train = np.array([r["n"] for r in rows.select(F.posexplode("roles").alias("s", "role")).groupBy("s").agg(F.sum((F.col("role") == 0).cast("long")).alias("n")).orderBy("s").collect()])
    losses = np.zeros((epochs, len(configs), n_splits))

    def added(told):
        def add(batches):
            total = None
            for b in batches:
                own_ids, v, t, role = _rows(b)
                own = np.array([place.get(i, -1) for i in own_ids.tolist()]) if leave_self_out else None
                total = np.zeros(sum(sizes)) if total is None else total
                at = 0
                for k, (names, p) in enumerate(told.value):
                    loss, g = gradient(p, names, v, t, (role[:, k % n_splits] == 0).astype(float), own)
                    for piece in (np.array([loss]), *(g[n].reshape(-1) for n in names)):
                        total[at : at + piece.size] += np.nan_to_num(piece)
                        at += piece.size
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

        return add

    def together(table: pa.Table) -> pa.Table:
        order = np.argsort(table["part"].to_numpy())
        total = np.sum([np.frombuffer(table["g"][int(i)].as_py()) for i in order], 0)
        return pa.table([pa.array([int(table["part"][int(order[0])].as_py())], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "g"])

    for epoch in range(epochs):
        told = spark.sparkContext.broadcast([(names, m.p) for (names, _), m in zip(parts, (m for of in states for m in of))])
        of_task = rows.mapInArrow(added(told), "g binary").withColumn("part", F.spark_partition_id())
        grouped = of_task.groupBy(F.pmod("part", F.lit(GROUPS))).applyInArrow(together, "part int, g binary")
        total = np.sum([np.frombuffer(r["g"]) for r in sorted(grouped.collect(), key=lambda r: r["part"])], 0)
        told.destroy()
        at = 0
        for k, (m, size) in enumerate(zip((m for of in states for m in of), sizes)):
            piece, n = total[at : at + size], max(1, n_train[k % n_splits])
            losses[epoch, k // n_splits, k % n_splits] = piece[0] / n
            g, inner = {}, 1
            for name in m.parts:
                g[name] = (piece[inner : inner + m.p[name].size] / n).reshape(m.p[name].shape)
                inner += m.p[name].size
            m.move(g)
            m.p["log_sigma"] = np.maximum(m.p["log_sigma"], np.log(LEAST_SIGMA))
            at += size
    return Trained(configs, ids.tolist(), [[m.p for m in of] for of in states], first, losses)


def scored(rows: DataFrame, t: Trained, leave_self_out: bool = True) -> DataFrame:
    """``id, config, split, role, y, p`` of all rows under all models."""
    told, place = rows.sparkSession.sparkContext.broadcast(t.models), {int(i): k for k, i in enumerate(t.ids)}
    schema = pa.schema([("id", pa.int64()), ("config", pa.int32()), ("split", pa.int32()), ("role", pa.int32()), ("y", pa.float64()), ("p", pa.float64())])

    def score(batches):
        for b in batches:
            ids, v, y, role = _rows(b)
            own = np.array([place.get(i, -1) for i in ids.tolist()]) if leave_self_out else None
            for c, of in enumerate(told.value):
                for s, p in enumerate(of):
                    share = shares(p, v, own)[2]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.full(len(ids), k, np.int32)) for k in (c, s)), pa.array(role[:, s].astype(np.int32)), pa.array(y), pa.array(share @ label(p))], schema=schema)

    plain = rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), F.col("y").cast("double"), F.col("roles").cast("array<int>"))
    return plain.mapInArrow(score, "id long, config int, split int, role int, y double, p double")


def grid(rows: DataFrame, configs: list[Config] = GRID, **options) -> DataFrame:
    """Per configuration: its settings, and mean and deviation over the splits of macro F1, accuracy, sensitivity and specificity of the held-out rows."""
    t = fit(rows, configs, **options)
    said, truth = F.col("p") >= 0.5, F.col("y") >= 0.5
    n = lambda c: F.sum(c.cast("long"))
    c = scored(rows, t).filter("role = 1").groupBy("config", "split").agg(n(said & truth).alias("tp"), n(said & ~truth).alias("fp"), n(~said & truth).alias("fn"), n(~said & ~truth).alias("tn"))
    f1 = lambda a, b, d: F.coalesce(F.try_divide(2.0 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(d)), F.lit(0.0))
    m = c.select("config", ((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2).alias("macro_f1"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("sensitivity"), F.coalesce(F.try_divide("tn", F.col("tn") + F.col("fp")), F.lit(0.0)).alias("specificity"))
    told = rows.sparkSession.createDataFrame([(k, float(g.sigma_mult), g.x_train, g.y_train, g.encoder, float(g.eps)) for k, g in enumerate(configs)], "config int, sigma_mult double, x_train boolean, y_train boolean, encoder string, eps double")
    return m.groupBy("config").agg(F.avg("macro_f1").alias("macro_f1"), F.stddev_pop("macro_f1").alias("deviation"), *(F.avg(x).alias(x) for x in ("accuracy", "sensitivity", "specificity"))).join(F.broadcast(told), "config")
