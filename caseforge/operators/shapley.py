"""Kernel Shapley values of neighbour votes: weighted coalitions and a least-angle choice of features, solved in the tasks.

A coalition keeps some features of a row and takes the others from a background row; its value is the vote of the
model's nearest memory rows, averaged over the background. The values of sampled coalitions are explained by a weighted linear model
whose coefficients add up to the row's vote less the background's. Memory and background are a fitted model, of bounded size (``MAX_MEMORY``);
the rows explained may be any number, and a row's coalitions are drawn from its id, so reruns agree.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resampling import subsample

#: Rows that a model keeps, those with the least hashes: a documented bound on what is fitted. All rows are explained.
MAX_MEMORY, BACKGROUND = 1000, 5


def coalitions(m: int, budget: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Masks and weights of coalitions of ``m`` features that are neither empty nor whole: all of them where the budget holds them.

    Sizes are taken from the outside in (a coalition and its complement weigh alike, (m - 1) / (s (m - s)) for a size): a size is listed
    whole while its share of the budget covers it; what is left of the budget is drawn from the remaining sizes, in pairs of
    complements, repeats adding weight.
    """
    if m < 2:
        return np.zeros((0, m), bool), np.zeros(0)
    sizes = np.arange(1, m // 2 + 1)
    mass = (m - 1) / (sizes * (m - sizes)) * np.where(2 * sizes == m, 1, 2)
    mass /= mass.sum()
    number = np.array([comb(m, int(s)) * (1 if 2 * s == m else 2) for s in sizes], dtype=object)
    masks, weights, left, listed = [], [], budget, 0
    whole = budget >= 2**m - 2
    for s, n in zip(sizes.tolist(), number):
        if not whole and left * mass[listed] / mass[listed:].sum() < n:
            break
        for own in combinations(range(m), s):
            mask = np.zeros(m, bool)
            mask[list(own)] = True
            masks += [mask] if 2 * s == m else [mask, ~mask]
        weights += [mass[listed] / float(n)] * int(n)
        left -= int(n)
        listed += 1
    if listed < len(sizes) and left > 0:
        rest, drawn = mass[listed:] / mass[listed:].sum(), {}
        tries = 0
        while left > 0 and tries < 4 * budget:
            tries += 1
            mask = np.zeros(m, bool)
            mask[rng.choice(m, int(rng.choice(sizes[listed:], p=rest)), replace=False)] = True
            for own in (mask, ~mask):
                key = own.tobytes()
                if key in drawn:
                    drawn[key][1] += 1
                elif left > 0:
                    drawn[key] = [own, 1]
                    left -= 1
        total = sum(n for _, n in drawn.values())
        masks += [own for own, _ in drawn.values()]
        weights += [mass[listed:].sum() * n / total for _, n in drawn.values()]
    return np.array(masks).reshape(-1, m), np.array(weights)


def least_angles(x: np.ndarray, y: np.ndarray, steps: int) -> list[int]:
    """The columns that least-angle regression takes up in ``steps`` steps, in that order: the fit moves so that all of them stay equally correlated with what is left."""
    fitted, active = np.zeros(len(y)), []
    for _ in range(min(steps, x.shape[1])):
        c = x.T @ (y - fitted)
        others = np.setdiff1d(np.arange(x.shape[1]), active)
        j = others[np.argmax(np.abs(c[others]))]
        most = abs(c[j])
        if most < 1e-12:
            break
        active.append(int(j))
        signed = x[:, active] * np.sign(c[active])
        a = np.linalg.lstsq(signed.T @ signed, np.ones(len(active)), rcond=None)[0]
        size = 1 / np.sqrt(max(a.sum(), 1e-300))
        u = signed @ (size * a)
        others = np.setdiff1d(others, [j])
        step = most / size
        if len(others):
            along = x[:, others].T @ u
            with np.errstate(divide="ignore", invalid="ignore"):
                ahead = np.concatenate([(most - c[others]) / (size - along), (most + c[others]) / (size + along)])
            ahead = ahead[np.isfinite(ahead) & (ahead > 1e-12)]
            step = min(step, ahead.min()) if len(ahead) else step
        fitted = fitted + step * u
    return active


def solved(masks: np.ndarray, weights: np.ndarray, values: np.ndarray, base: float, whole: float, features: int | None) -> np.ndarray:
    """Coefficients that fit ``values`` and add up to ``whole - base``; at most ``features`` of them aren't 0."""
    m = masks.shape[1]
    z, gain, total = masks.astype(float), values - base, whole - base
    chosen = np.arange(m)
    if features is not None and features < m:
        # Each coalition and its complement's view of it, so the constraint takes part in the choice.
        size = z.sum(1)
        w = np.sqrt(np.concatenate([weights * (m - size), weights * size]))
        path = least_angles(w[:, None] * np.concatenate([z, z - 1]), w * np.concatenate([gain, gain - total]), features)
        chosen = np.array(sorted(path) or [0])
    out = np.zeros(m)
    if len(chosen) == 1:
        out[chosen] = total
        return out
    w = np.sqrt(weights)
    rest, last = chosen[:-1], chosen[-1]
    design = w[:, None] * (z[:, rest] - z[:, [last]])
    out[rest] = np.linalg.lstsq(design, w * (gain - z[:, last] * total), rcond=None)[0]
    out[last] = total - out[rest].sum()
    return out


class Vote:
    """Mean label of the k nearest memory rows, of mixed rows: squared distances add up over features, so a mixture is a product of masks."""

    def __init__(self, memory: np.ndarray, labels: np.ndarray, background: np.ndarray, k: int = 3):
        self.memory, self.labels, self.k = memory, labels, min(k, len(memory))
        self.background = [((b - memory) ** 2).T for b in background]
        self.base = float(np.mean([self._of(d.sum(0)[None])[0] for d in self.background]))

    def _of(self, d2: np.ndarray) -> np.ndarray:
        # The order of the memory settles ties.
        return self.labels[np.argsort(d2, 1, kind="stable")[:, : self.k]].mean(1)

    def of_row(self, x: np.ndarray) -> float:
        return float(self._of(((x - self.memory) ** 2).sum(1)[None])[0])

    def of_coalitions(self, x: np.ndarray, masks: np.ndarray) -> np.ndarray:
        own, z = ((x - self.memory) ** 2).T, masks.astype(float)
        return np.mean([self._of(z @ own + (1 - z) @ other) for other in self.background], 0)


def values_of(x: np.ndarray, vote: Vote, budget: int, features: int | None, rng: np.random.Generator) -> np.ndarray:
    masks, weights = coalitions(len(x), budget, rng)
    if not len(masks):
        return np.full(len(x), vote.of_row(x) - vote.base)
    return solved(masks, weights, vote.of_coalitions(x, masks), vote.base, vote.of_row(x), features)


def kernel_shap(rows: DataFrame, memory: np.ndarray, labels: np.ndarray, background: np.ndarray, k: int = 3, budget: int = 20, features: int | None = 10, seed: int = 42) -> DataFrame:
    """``id, vote, values``: each row's vote and what each feature adds to the background's. A row with null or missing components has nulls."""
    told = rows.sparkSession.sparkContext.broadcast(Vote(memory, labels, background, k))
    width = memory.shape[1]

    def explain(batches):
        for b in batches:
            votes, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fit = v is not None and len(v) == width and all(c is not None for c in v)
                x = np.array(v, float) if fit else None
                votes.append(told.value.of_row(x) if fit else None)
                out.append(values_of(x, told.value, budget, features, np.random.default_rng([seed, abs(i or 0)])).tolist() if fit else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.float64()), pa.array(out, pa.list_(pa.float64()))], names=["id", "vote", "values"])

    return rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(explain, "id long, vote double, values array<double>")


def fitted_memory(rows: DataFrame, most: int = MAX_MEMORY, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of at most ``most`` rows of ``rows(id, v, y)``, those with the least hashes, in the order of their ids."""
    got = subsample(rows.filter("v is not null and y is not null"), "id", most, seed).orderBy("id").collect()
    return np.array([r["v"] for r in got], float), np.array([r["y"] for r in got], float)


def by_family(explained: DataFrame, names: list[str]) -> DataFrame:
    """``q, column, value``: mean absolute value over the features of each name (``age``, ``age__is_missing`` are one); one name per feature."""
    x = explained.select(F.col("id").alias("q"), F.posexplode("values").alias("at", "x"))
    family = F.get(F.array(*(F.lit(n.split("__")[0]) for n in names)), F.col("at"))
    return x.groupBy("q", family.alias("column")).agg(F.avg(F.abs("x")).alias("value"))
