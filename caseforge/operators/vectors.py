"""Exact neighbours and diagnostics of embedding tables.

Vectors are packed into blocks of bounded size. A pair of blocks is one task's work: distances
by matrix product, and only what is asked for leaves it (k neighbours per row, or sums), so no
table of all pairs is shuffled. Callers that follow the reference cap n by a hash-ordered
subsample (``resampling.subsample``); the blocks themselves have no cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, met, packed, unpacked, walked
from .order import kept
from .pair_sums import AT_ONCE, COLUMNS, Near, of_rows

EDGES = "q long, n long, dist double"


def as_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def unit_rows(base: DataFrame) -> DataFrame:
    """``base(id, v)`` with rows of length 1."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)) + 1e-12
    return base.select("id", F.transform("v", lambda x: x / length).alias("v"))


def _matrix(t: pa.Table, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    v = t["v" + side].combine_chunks()
    return t["id" + side].to_numpy(), np.asarray(v.flatten()).astype(float, copy=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return _manhattan(a, np.ascontiguousarray(b.T))
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return np.clip(1 - (a @ b.T) / np.maximum(np.outer(na, nb), 1e-300), 0, 2)
    # Differences, not the expanded square: near vectors keep their digits.
    return np.sqrt(np.stack([((b - x) ** 2).sum(1) for x in a]))


def _by_difference(a: np.ndarray, row: np.ndarray, b: np.ndarray, col: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Distances of the pairs ``a[row], b[col]``, some at a time."""
    parts = [np.sqrt(((b[col[x : x + at_once]] - a[row[x : x + at_once]]) ** 2).sum(1)) for x in range(0, len(row), at_once)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _manhattan(a: np.ndarray, bt: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """Distances to the columns of ``bt``, dimension by dimension, some columns at a time so that they stay in the cache."""
    out = np.zeros((len(a), bt.shape[1]))
    for y in range(0, bt.shape[1], at_once):
        part = np.ascontiguousarray(bt[:, y : y + at_once])
        gap = np.empty(part.shape)
        for k, x in enumerate(a):
            np.subtract(part, x[:, None], out=gap)
            np.abs(gap, out=gap)
            out[k, y : y + at_once] = gap.sum(0)
    return out


def _same(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one id; ``others`` are sorted."""
    lo, hi = np.searchsorted(others, ids), np.searchsorted(others, ids, "right")
    row = np.repeat(np.arange(len(ids)), hi - lo)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[row]


def _pairwise(a: np.ndarray, row: np.ndarray, b: np.ndarray, col: np.ndarray, metric: str, at_once: int = 1 << 16) -> np.ndarray:
    """Distances of the pairs ``a[row], b[col]`` one by one, so rows that are alike are equally far."""
    if metric == "euclidean":
        return _by_difference(a, row, b, col, at_once)
    out = np.empty(len(row))
    for x in range(0, len(row), at_once):
        s = slice(x, x + at_once)
        p, q = a[row[s]], b[col[s]]
        if metric == "manhattan":
            out[s] = np.abs(q - p).sum(1)
        else:
            size = np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q))
            out[s] = np.clip(1 - np.einsum("ij,ij->i", p, q) / np.maximum(size, 1e-300), 0, 2)
    return out


class _Nearest:
    """The k nearest rows of the blocks seen so far, for each row of a block of queries; ties by id.

    Once each row has k, a block is screened: single precision, or small whole numbers, and their largest error tell which pairs can be among
    the k. Those, a few, are measured in full.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.k, self.metric = ids, q, k, metric
        self.size = (q * q).sum(1)
        self.reach = np.full(len(ids), np.inf)  # distance of the k-th so far
        self.found, self.new, self.waiting = None, [], 0
        if metric == "cosine":
            self.own = q / np.maximum(np.sqrt(self.size), 1e-300)[:, None]
        else:
            self.centre = q.mean(0) if len(q) else 0.0
            self.own = q - self.centre
        self.own_size = (self.own * self.own).sum(1)

    def look(self, others: np.ndarray, b: np.ndarray, code: np.ndarray | None = None) -> None:
        """Meet a block; the rows of ``code`` go along with those of the block that are found."""
        if not len(self.ids) or not len(others):
            return
        screen = None if np.isinf(self.reach).any() else self._screened(b)
        row, col = self._first(others, b) if screen is None else screen
        other = self.ids[row] != others[col]
        row, col = row[other], col[other]
        dist = _pairwise(self.q, row, b, col, self.metric)
        held = (dist <= self.reach[row]) & np.isfinite(dist)
        self.new.append((row[held], others[col[held]], dist[held], *(() if code is None else (code[col[held]],))))
        self.waiting += int(held.sum())
        if self.found is None or 2 * self.waiting > len(self.found[0]):
            self.settle()

    def _first(self, others: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are among the k nearest of the block, or within reach."""
        near, most, m = Near(b) if self.metric == "euclidean" else None, float((b * b).sum(1).max()), min(self.k, len(others)) - 1
        rows, cols = [], []
        for x in range(0, len(self.ids), AT_ONCE):
            s = slice(x, x + AT_ONCE)
            d = near.squared(self.q[s]) if near else distances(self.q[s], b, self.metric)
            d[_same(self.ids[s], others)] = np.inf
            reach = np.minimum(self.reach[s] ** 2 if near else self.reach[s], np.partition(d, m, 1)[:, m])
            # The product bounds the distances to its rounding. All within the k-th distance go on, so ties are settled by id.
            reach = reach + (1e-9 * (self.size[s] + most) if near else 1e-12 * (1 + np.abs(np.where(np.isfinite(reach), reach, 0))))
            row, col = np.nonzero(d <= reach[:, None])
            rows.append(x + row), cols.append(col)
        return np.concatenate(rows), np.concatenate(cols)

    def _screened(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The pairs that may be within reach; None if the numbers don't fit."""
        if self.metric == "manhattan":
            return self._in_whole_numbers(b)
        width = b.shape[1]
        b = b / np.maximum(np.sqrt((b * b).sum(1)), 1e-300)[:, None] if self.metric == "cosine" else b - self.centre
        size = (b * b).sum(1)
        most = float(size.max() + self.own_size.max())
        if not most < 1e30:
            return None
        # Each of the width + 2 products and sums errs by 2^-24 of them at most, as do the numbers put in.
        slack = 2 * (width + 8) * 2.0**-24 * (self.own_size + size.max())
        reach = 2 * self.reach + 1e-9 if self.metric == "cosine" else self.reach**2
        if self.metric == "cosine":  # a row of length 0 is at distance 1 from all
            reach = np.where((self.own_size == 0) | (self.reach >= 1), np.inf, reach)
        limit = np.nextafter((reach + slack).astype(np.float32), np.float32(np.inf))[:, None]
        sides = np.concatenate([-2 * b.T, np.ones((1, len(b))), size[None]]).astype(np.float32)
        own = np.concatenate([self.own, self.own_size[:, None], np.ones((len(self.own), 1))], 1).astype(np.float32)
        rows, cols = [], []
        for y in range(0, len(b), COLUMNS):
            side = np.ascontiguousarray(sides[:, y : y + COLUMNS])
            for x in range(0, len(own), AT_ONCE):
                hit = (own[x : x + AT_ONCE] @ side <= limit[x : x + AT_ONCE]).reshape(-1)
                if np.count_nonzero(hit):
                    row, col = np.divmod(np.flatnonzero(hit), side.shape[1])
                    if 8 * len(row) > len(hit):  # too near one another for single precision
                        d2 = Near(b[y : y + COLUMNS]).squared(self.own[x : x + AT_ONCE])
                        row, col = np.nonzero(d2 <= (reach + 1e-9 * (self.own_size + size.max()))[x : x + AT_ONCE, None])
                    rows.append(x + row), cols.append(y + col)
        return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _in_whole_numbers(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Values as whole numbers so small that a distance fits 16 bits: each pair of values errs by 1 at most."""
        width = b.shape[1]
        b = b - self.centre
        levels, most = 32767 // (2 * max(1, width)), max(np.abs(b).max(initial=0.0), np.abs(self.own).max(initial=0.0))
        if levels < 8 or not 0 < most < 1e30:
            return None
        scale = levels / most
        limit = np.minimum(np.floor(scale * self.reach * (1 + 1e-9) + width + 1), 32767).astype(np.int16)[:, None]
        own, other = np.rint(self.own * scale).astype(np.int16)[:, :, None], np.rint(b * scale).astype(np.int16).T
        rows, cols = [], []
        for y in range(0, len(b), COLUMNS):
            side = np.ascontiguousarray(other[:, y : y + COLUMNS])
            gap = np.empty_like(side)
            for x in range(0, len(own), AT_ONCE):
                part = own[x : x + AT_ONCE]
                d = np.empty((len(part), side.shape[1]), np.int16)
                for k in range(len(part)):
                    np.subtract(side, part[k], out=gap)
                    np.abs(gap, out=gap)
                    np.add.reduce(gap, 0, np.int16, d[k])
                row, col = np.divmod(np.flatnonzero(d <= limit[x : x + AT_ONCE]), side.shape[1])
                rows.append(x + row), cols.append(y + col)
        return np.concatenate(rows), np.concatenate(cols)

    def settle(self) -> None:
        parts = self.new if self.found is None else [self.found, *self.new]
        row, n, dist, *code = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((n, dist, row))
        row, n, dist = row[order], n[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = place == self.k - 1
        self.reach[row[kth]] = dist[kth]
        held = place < self.k
        self.found, self.new, self.waiting = (row[held], n[held], dist[held], *(c[order][held] for c in code)), [], 0

    def lists(self, own: np.ndarray) -> pa.RecordBatch:
        """``q, own, near``: a row for each query, with its code and the distances, ids (their bits) and codes of what was found, as bytes."""
        self.settle()
        row, n, dist, *code = self.found
        near = np.column_stack([dist, n.view(np.float64), *code])
        at = np.searchsorted(row, np.arange(len(self.ids) + 1))
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([near[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["q", "own", "near"])

    def edges(self) -> pa.RecordBatch:
        self.settle()
        row, n, dist = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row], pa.int64()), pa.array(n, pa.int64()), pa.array(dist, pa.float64())], names=["q", "n", "dist"])


def knn(base: DataFrame, k: int, metric: str = "euclidean", queries: DataFrame | None = None, block: int = BLOCK, own: DataFrame | None = None) -> DataFrame:
    """``q, n, dist, rk``: the k nearest other rows of ``base(id, v)``, or of its blocks ``own``, for each query; ties by id. A task walks a block of queries over blocks of the base and hands on k edges a query."""
    right = packed(base.select("id", "v"), block) if own is None else own
    left = right if queries is None else packed(queries.select("id", "v"), block)

    def near(batches):
        at, top = None, None
        for qb, qs, _, bs in unpacked(batches):
            if qb != at:
                if top is not None:
                    yield top.edges()
                at, top = qb, _Nearest(*_matrix(qs), k, metric)
            top.look(*_matrix(bs))
        if top is not None:
            yield top.edges()

    e = walked(left, right).mapInArrow(near, EDGES)
    at = F.row_number().over(Window.partitionBy("q").orderBy("dist", "n"))
    return e.withColumn("rk", at).filter(F.col("rk") <= k)


def knn_lists(rows: DataFrame, k: int, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """``q, own, near`` for ``unpacked_lists``: the k nearest of each of ``rows(id, v, code)``, whose codes, numbers of one length, are handed on by the walk, so neighbours needn't be joined.

    Kept in the shared folder, partitioned by query, a row each; what several walks over a query's block found is put together before.
    """

    def code(t: pa.Table) -> np.ndarray:
        return np.asarray(t["code"].combine_chunks().flatten(), dtype=float).reshape(len(t), -1)

    def near(batches):
        at, top, own = None, None, None
        for qb, qs, _, bs in unpacked(batches):
            if qb != at:
                if top is not None:
                    yield top.lists(own)
                at, top, own = qb, _Nearest(*_matrix(qs), k, metric), code(qs)
            top.look(*_matrix(bs), code(bs))
        if top is not None:
            yield top.lists(own)

    def put_together(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        whole = ((q, *_merged([*parts], k)) for q, parts in groupby(rows, itemgetter(0)))
        while some := list(islice(whole, 2000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int64(), pa.binary(), pa.binary()))], names=["q", "own", "near"])

    blocks, schema = packed(rows.select("id", "v", "code"), block), "q long, own binary, near binary"
    return kept(walked(blocks, blocks).mapInArrow(near, schema).repartition("q").sortWithinPartitions("q").mapInArrow(put_together, schema))


def _merged(parts: list[tuple[int, bytes, bytes]], k: int) -> tuple[bytes, bytes]:
    """A query's code, and the distances and codes of its k nearest in order; ties by id."""
    own = parts[0][1]
    near = np.concatenate([np.frombuffer(x).reshape(-1, 2 + len(own) // 8) for _, _, x in parts])
    order = np.lexsort((np.ascontiguousarray(near[:, 1]).view(np.int64), near[:, 0]))[:k]
    return own, np.delete(near[order], 1, 1).tobytes()


def unpacked_lists(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query of ``knn_lists``: its id, its code, and the distances and codes of its neighbours in order."""
    for b in batches:
        for q, own, near in zip(*(c.to_pylist() for c in b.columns)):
            own = np.frombuffer(own)
            near = np.frombuffer(near).reshape(-1, 1 + len(own))
            yield q, own, near[:, 0], near[:, 1:]


def wide_enough(k: int, share: float) -> int:
    """Neighbours to list so that, but for chance, k are among those that fall to a memory with this share of the rows."""
    return int(np.ceil((k + 6 * np.sqrt(k * (1 - share))) / share)) + 8


def knn_folds(rows: DataFrame, k: int, metric: str = "euclidean", block: int = BLOCK, wide: int | None = None) -> DataFrame:
    """``fold, q, n, dist, rk`` for all folds at once: ``rows(id, v, roles)``, where ``roles[f]`` is 0 if the row is in the memory of fold ``f``, 1 if it is a query there, else neither.

    Neighbours among all rows are found once, ``wide`` of them, so many that each fold's memory has its k among them but for chance; the k of every fold
    follow by their roles. A query that lacks some in a fold, where its list isn't all rows, is walked over that fold's memory itself: that is exact, whatever the roles.
    """
    spark, rows = rows.sparkSession, kept(rows.filter("v is not null").select("id", "v", "roles"))
    shares = rows.select(F.posexplode("roles").alias("fold", "role")).groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("role") == 0).cast("long")).alias("held")).filter("held > 0").collect()
    if not shares:
        return spark.createDataFrame([], "fold long, q long, n long, dist double, rk int")
    n = max(r["n"] for r in shares)
    p = min(r["held"] / r["n"] for r in shares)
    wide = wide or wide_enough(k, p)
    # Roles as text, a letter a fold: two of them go with each edge.
    letters = F.concat_ws("", F.transform("roles", lambda r: r.cast("string")))
    roles = rows.select(F.col("id").alias("n"), letters.alias("of_n"))
    asked = rows.select(F.col("id").alias("q"), letters.alias("of_q"))
    # Partitioned by query, and so are its folds: what groups by query after this needn't shuffle.
    e = kept(knn(rows, wide, metric, block=block).drop("rk")).join(roles, "n").join(asked, "q").repartition("q")
    folds = F.filter(F.sequence(F.lit(0), F.char_length("of_q") - 1), lambda f: (F.substring("of_q", f + 1, F.lit(1)) == "1") & (F.substring("of_n", f + 1, F.lit(1)) == "0"))
    found = e.select("q", F.explode(folds).alias("fold")).groupBy("q", "fold").agg(F.count("*").alias("found")).withColumn("fold", F.col("fold").cast("long"))
    e = e.select("q", "n", "dist", F.explode(folds).alias("fold")).withColumn("fold", F.col("fold").cast("long"))
    at = F.row_number().over(Window.partitionBy("fold", "q").orderBy("dist", "n"))
    e = e.withColumn("rk", at).filter(F.col("rk") <= k).select("fold", "q", "n", "dist", "rk")
    if wide >= n - 1:
        return e
    held = F.broadcast(spark.createDataFrame([(r["fold"], r["held"]) for r in shares], "fold long, held long"))
    every = rows.select(F.col("id").alias("q"), F.posexplode("roles").alias("fold", "role")).filter("role = 1").select("q", F.col("fold").cast("long").alias("fold"))
    few = every.join(held, "fold").join(found, ["fold", "q"], "left")
    few = kept(few.filter(F.coalesce("found", F.lit(0)) < F.least("held", F.lit(k))).select("fold", "q"))
    for r in few.select("fold").distinct().orderBy("fold").collect():
        lacking = few.filter(F.col("fold") == r["fold"])
        own = rows.join(lacking.select(F.col("q").alias("id")), "id", "left_semi")
        more = knn(rows.filter(F.get("roles", F.lit(r["fold"])) == 0), k, metric, own, block).select(F.lit(r["fold"]).cast("long").alias("fold"), "q", "n", "dist", "rk")
        e = e.join(lacking, ["fold", "q"], "left_anti").select(*more.columns).unionByName(more)
    return e


def kernel_sums(queries: DataFrame, prototypes: DataFrame, sigma: float, leave_self_out: bool = False, block: int = BLOCK) -> DataFrame:
    """Sums over all ``prototypes(id, v, w, y)`` for each query: no pair leaves a task.

    With ``k = w * exp(-d^2 / (2 sigma^2))^2`` and ``h`` the entropy of a prototype's label ``y``: sums ``s`` of k,
    ``sy`` of k y, ``s2`` of k^2, ``top`` (the largest k), ``klogk`` and ``kh``.
    """
    names = ["s", "sy", "s2", "top", "klogk", "kh"]

    def add(batches):
        at, own, total = None, None, None
        for qb, qs, _, bs in unpacked(batches):
            if qb != at:
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, total)], names=["q", *names])
                at, (own, q) = qb, _matrix(qs)
                total = np.zeros((6, len(own)))
            bi, b = _matrix(bs)
            w, y = bs["w"].to_numpy(), bs["y"].to_numpy()
            h = -sum(np.where(x > 0, x * np.log(np.where(x > 0, x, 1)), 0) for x in (y, 1 - y))
            sides = np.stack([np.ones(len(w)), y, h, np.log(np.where(w > 0, w, 1))], 1)
            for c in range(0, len(bi), COLUMNS):
                at_c = slice(c, c + COLUMNS)
                near, side, w_c = Near(b[at_c]), sides[at_c], w[at_c]
                for x in range(0, len(own), AT_ONCE):
                    s = slice(x, x + AT_ONCE)
                    power = near.squared(q[s])
                    power *= -1 / sigma**2
                    k = np.exp(power)
                    k *= w_c
                    if leave_self_out:
                        k[_same(own[s], bi[at_c])] = 0
                    sums = k @ side
                    total[0, s] += sums[:, 0]
                    total[1, s] += sums[:, 1]
                    total[5, s] += sums[:, 2]
                    total[2, s] += np.einsum("ij,ij->i", k, k)
                    total[3, s] = np.maximum(total[3, s], k.max(1, initial=0))
                    total[4, s] += np.einsum("ij,ij->i", k, power) + sums[:, 3]  # the log of k is the power and the log of w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, total)], names=["q", *names])

    left, right = packed(queries.select("id", "v"), block), packed(prototypes.select("id", "v", F.col("w").cast("double").alias("w"), F.col("y").cast("double").alias("y")), block)
    part = walked(left, right).mapInArrow(add, "q long, " + ", ".join(f"{c} double" for c in names))
    return part.groupBy("q").agg(*(F.sum(c).alias(c) for c in ("s", "sy", "s2", "klogk", "kh")), F.max("top").alias("top"))


def weighted_votes(base: DataFrame, weights: list[str], y: str, sigma: float, block: int = BLOCK) -> DataFrame:
    """``q`` and ``p``, an array: for each of the columns ``weights`` of ``base(id, v, y, *weights)`` the mean ``y`` of all other rows, by that weight and the kernel of ``kernel_sums``, which is taken once for all."""
    m = len(weights)

    def add(c) -> list[np.ndarray]:
        k = np.exp(c.d2 * (-1 / sigma**2))
        if not c.whole:
            k *= c.counts
        w, label = np.stack([c.more_b[x].astype(float) for x in weights], 1), c.more_b[y].astype(float)[:, None]
        return list((k @ np.concatenate([w, w * label], 1)).T)

    names = [f"s{i}" for i in range(2 * m)]
    own = packed(base.select("id", "v", y, *weights), block)
    t = of_rows(own, add, ", ".join(f"{n} double" for n in names), (np.add,) * (2 * m), (y, *weights))
    t = t.groupBy(F.col("id").alias("q")).agg(*(F.sum(n).alias(n) for n in names))
    return t.select("q", F.array(*(F.try_divide(f"s{m + i}", f"s{i}") for i in range(m))).alias("p"))


def pairs(base: DataFrame, metric: str = "euclidean", block: int = 1024) -> DataFrame:
    """``i, j, dist`` for all i < j: for capped tables and tests."""
    own = packed(base.select("id", "v"), block)

    def every(batches):
        for _, qs, _, bs in unpacked(batches):
            (qi, q), (bi, b) = _matrix(qs), _matrix(bs)
            for x in range(len(qi)):
                later = bi > qi[x]
                if later.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(later.sum(), qi[x])), pa.array(bi[later]), pa.array(distances(q[x : x + 1], b[later], metric)[0])], names=["i", "j", "dist"])

    return met(own, own).mapInArrow(every, "i long, j long, dist double")


def k_occurrence(edges: DataFrame, base: DataFrame) -> DataFrame:
    """How often each row is a neighbour, zeros too."""
    n = edges.groupBy(F.col("n").alias("id")).agg(F.count("*").alias("n_k"))
    return base.select("id").join(n, "id", "left").select("id", F.coalesce("n_k", F.lit(0)).alias("n_k"))


def hubness(occ: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: skewness of N_k, the Robin Hood index (minus Gini) and Gini, hubs, antihubs and contamination."""
    m = occ.agg(F.count("*").alias("n"), F.avg("n_k").alias("mean"), F.skewness("n_k").alias("skewness"), F.sum("n_k").alias("total"), F.max("n_k").alias("largest"))
    # Counts per value: the ordered window works on values of N_k, not on rows.
    v = occ.groupBy("n_k").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("n_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = v.select((F.col("n_k") * (F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)).alias("r")).agg(F.sum("r").alias("ranked"))
    hub = occ.crossJoin(F.broadcast(m.select("mean"))).select("id", (F.col("n_k") > 2 * F.col("mean")).alias("hub"), (F.col("n_k") == 0).alias("anti"))
    flags = hub.agg(F.sum(F.col("hub").cast("long")).alias("hubs"), F.sum(F.col("anti").cast("long")).alias("antihubs"))
    hubs = hub.filter("hub").select("id")
    of_hubs = edges.join(hubs.withColumnRenamed("id", "q"), "q", "left_semi").join(hubs.select(F.col("id").alias("n"), F.lit(1).alias("h")), "n", "left")
    mixed = of_hubs.agg(F.avg(F.coalesce("h", F.lit(0)).cast("double")).alias("contamination"))
    one = m.crossJoin(ranks).crossJoin(flags).crossJoin(mixed)
    robin = 1 - 2 * F.col("ranked") / (F.col("n") * F.col("total")) + 1 / F.col("n")
    return one.select("n", "mean", "skewness", "largest", robin.alias("robinhood"), (-robin).alias("gini"), "hubs", "antihubs", F.coalesce("contamination", F.lit(0.0)).alias("contamination"))


def moments(base: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and centred scatter matrix: one d x d matrix a task (by the width, not the rows), added up in groups on the executors; one comes here."""

    def part(batches):
        n, s, g = 0, None, None
        for b in batches:
            _, m = _matrix(pa.Table.from_batches([b]))
            if len(m):
                n, s, g = n + len(m), m.sum(0) if s is None else s + m.sum(0), m.T @ m if g is None else g + m.T @ m
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "g": [g.reshape(-1).tolist()]})

    entry = base.mapInArrow(part, "n long, s array<double>, g array<double>").select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "g")).alias("at", "x"))
    sums = entry.groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")["x"].to_numpy()
    if not len(sums):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = round((np.sqrt(4 * len(sums) - 3) - 1) / 2)  # 1 + d + d^2 numbers
    n, mean = int(sums[0]), sums[1 : d + 1] / sums[0]
    return n, mean, sums[d + 1 :].reshape(d, d) - n * np.outer(mean, mean)


def isotropy(base: DataFrame) -> dict[str, float]:
    """Participation ratio, effective rank and score from the sample covariance."""
    n, _, scatter = moments(base)
    lam = np.clip(np.linalg.eigvalsh(scatter / max(1, n - 1)), 0, None)
    p = lam[lam > 0] / lam.sum()
    rank = float(np.exp(-(p * np.log(p)).sum()))
    #: The local PCA estimate of the dimension on the whole table: eigenvalues above a twentieth of the largest.
    large = int((lam > 0.05 * lam.max()).sum())
    return {"l_pca": float(large), "dims": float(len(lam)), "participation_ratio": float(lam.sum() ** 2 / (lam**2).sum()), "effective_rank": rank, "score": float(np.clip(rank / len(lam), 0, 1))}


def pca(base: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and k components; of each the loading of largest size is positive."""
    _, mean, scatter = moments(base)
    w, v = np.linalg.eigh(scatter)
    comps = v[:, np.argsort(-w)[:k]].T
    return mean, comps * np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)])[:, None]


def projected(base: DataFrame, mean: np.ndarray, comps: np.ndarray) -> DataFrame:
    def project(batches):
        for b in batches:
            i, m = _matrix(pa.Table.from_batches([b]))
            z = (m - mean) @ comps.T if len(m) else np.zeros((0, len(comps)))
            yield pa.RecordBatch.from_pydict({"id": i, "z": pa.array(z.tolist(), pa.list_(pa.float64()))})

    return base.mapInArrow(project, "id long, z array<double>")


def concentration(p: DataFrame) -> DataFrame:
    return p.agg(((F.max("dist") - F.min("dist")) / F.avg("dist")).alias("relative_contrast"), (F.min("dist") / F.max("dist")).alias("min_max_ratio"), F.avg("dist").alias("mean"))


def uniformity(unit_pairs: DataFrame, t: float = 2.0, eps: float = 1e-10) -> DataFrame:
    return unit_pairs.agg(F.log(F.avg(F.exp(-t * F.col("dist") ** 2)) + eps).alias("uniformity"))


def median_sigma(p: DataFrame) -> DataFrame:
    return p.filter("dist > 0").agg(F.percentile("dist", 0.5).alias("sigma"))


def rbf(p: DataFrame, sigma: DataFrame) -> DataFrame:
    return p.crossJoin(F.broadcast(sigma)).select("i", "j", F.exp(-F.col("dist") ** 2 / (2 * F.col("sigma") ** 2)).alias("k"))


def kernel_rows(kernel: DataFrame, base: DataFrame) -> DataFrame:
    """Row sums of the kernel, the diagonal's 1 included."""
    both = kernel.select(F.col("i").alias("id"), "k").unionAll(kernel.select(F.col("j").alias("id"), "k"))
    return base.select("id", F.lit(1.0).alias("k")).unionAll(both).groupBy("id").agg(F.sum("k").alias("row_sum"))


def kernel_alignment(kernel: DataFrame, labels: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Alignment of the kernel with the indicator of equal labels ``(id, label)``."""
    lab = lambda a, b: labels.select(F.col("id").alias(a), F.col("label").alias(b))
    j = kernel.join(lab("i", "li"), "i").join(lab("j", "lj"), "j")
    same = (F.col("li") == F.col("lj")).cast("double")
    s = j.agg(F.sum(F.col("k") * same).alias("kl"), F.sum(F.col("k") ** 2).alias("kk"), F.sum(same).alias("ll"))
    n = labels.agg(F.count("*").alias("n"))
    full = lambda c: 2 * F.col(c) + F.col("n")
    return s.crossJoin(n).select((full("kl") / F.sqrt(full("kk") * full("ll") + eps)).alias("alignment"))


def intrinsic_dimension(edges: DataFrame, k: int = 10) -> DataFrame:
    """TwoNN, the maximum-likelihood and the moments estimate, and their median and deviation, from ranked edges. Zero distances are left out."""
    local = local_dimensions(edges, k)
    ratio = F.when(F.col("r2") > F.col("r1"), F.log(F.col("r2") / F.col("r1")))
    one = local.agg(F.try_divide(F.count(ratio).cast("double"), F.sum(ratio)).alias("two_nn"), F.avg("mle").alias("mle"), F.avg("mom").alias("mom"))
    return one.select("*", *consensus("two_nn", "mle", "mom"))


def local_dimensions(edges: DataFrame, k: int = 10) -> DataFrame:
    """Per row: its two least distances and the maximum-likelihood and moments estimates from its k neighbours."""
    by = edges.filter((F.col("rk") <= k) & (F.col("dist") > 0)).groupBy("q").agg(
        F.max(F.when(F.col("rk") == 1, F.col("dist"))).alias("r1"),
        F.max(F.when(F.col("rk") == 2, F.col("dist"))).alias("r2"),
        F.max("dist").alias("rmax"),
        F.sum(F.log("dist")).alias("logs"),
        F.avg("dist").alias("mean"),
        F.count("*").alias("m"),
    )
    mle = F.try_divide(F.col("m") - 1.0, F.col("m") * F.log("rmax") - F.col("logs"))
    return by.select("q", "r1", "r2", mle.alias("mle"), F.try_divide("mean", F.col("rmax") - F.col("mean")).alias("mom"))


def consensus(*estimates: str) -> tuple[Column, Column]:
    """Median and population deviation of the estimates that there are; null if there is none."""
    xs = F.filter(F.array(*(F.nanvl(F.col(c), F.lit(None).cast("double")) for c in estimates)), lambda x: x.isNotNull())
    n = F.size(xs)
    ordered = F.array_sort(xs)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    add = lambda f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    mean = F.try_divide(add(lambda x: x), n)
    return middle.alias("consensus"), F.sqrt(F.try_divide(add(lambda x: (x - mean) ** 2), n)).alias("uncertainty")


def correlation_dimension(pairs_: DataFrame, edges: DataFrame, near: int = 10, far: int = 20) -> DataFrame:
    """One row ``corr_int``: growth of the share of pairs between the median distances to the ``near``-th and the ``far``-th neighbour."""
    radii = edges.agg(F.percentile(F.when(F.col("rk") == near, F.col("dist")), 0.5).alias("a"), F.percentile(F.when(F.col("rk") == far, F.col("dist")), 0.5).alias("b"))
    n = lambda r: F.sum((F.col("dist") < F.col(r)).cast("double"))
    c = pairs_.crossJoin(F.broadcast(radii)).groupBy("a", "b").agg(n("a").alias("in_a"), n("b").alias("in_b"))
    return c.select(F.try_divide(F.log("in_b") - F.log("in_a"), F.log("b") - F.log("a")).alias("corr_int"))


def correlation_in_blocks(base: DataFrame, edges: DataFrame, near: int = 10, far: int = 20, own: DataFrame | None = None) -> float | None:
    """``correlation_dimension`` with the pairs counted in blocks; null if it isn't defined."""
    from .pair_sums import pairs_within

    r = edges.agg(F.percentile(F.when(F.col("rk") == near, F.col("dist")), 0.5).alias("a"), F.percentile(F.when(F.col("rk") == far, F.col("dist")), 0.5).alias("b")).first()
    if not r["a"] or not r["b"] or r["a"] == r["b"]:
        return None
    a, b = pairs_within(base, [r["a"], r["b"]], own)
    return float((np.log(b) - np.log(a)) / (np.log(r["b"]) - np.log(r["a"]))) if a else None


#: Rows of the kernel whose spectrum is taken, and eigenvalues kept.
SPECTRUM_ROWS, SPECTRUM = 2000, 50


def kernel_spectrum(base: DataFrame, sigma: float, rows: int = SPECTRUM_ROWS, components: int = SPECTRUM, seed: int = 42) -> dict[str, float]:
    """Effective rank, gap, condition and row-sum skewness of the kernel of a bounded sample (``rows``, those with the least hashes)."""
    from .resampling import subsample

    x = np.array([r["v"] for r in subsample(base, "id", rows, seed).collect()])
    d2 = np.stack([((x - r) ** 2).sum(1) for r in x])
    k = np.exp(-d2 / (2 * sigma**2 + 1e-10))
    lam = np.clip(np.sort(np.linalg.eigvalsh(k))[::-1][: min(components, len(x) - 1)], 0, None)
    p = lam / (lam.sum() + 1e-10) + 1e-10
    p /= p.sum()
    sums = k.sum(1)
    return {
        "effective_rank": float(np.exp(-(p * np.log(p)).sum())),
        "spectral_gap": float(lam[0] / (lam[1] + 1e-10)) if len(lam) > 1 else float("inf"),
        "condition_number": float(lam[0] / (lam[-1] + 1e-10)),
        "row_sum_skewness": float((((sums - sums.mean()) / (sums.std() + 1e-10)) ** 3).mean()),
    }


def vector_label_alignment(kernel: DataFrame, labels: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Alignment of the kernel with the cosines of vector labels ``(id, y)``."""
    lab = lambda a, b: labels.select(F.col("id").alias(a), F.col("y").cast("array<double>").alias(b))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    j = kernel.join(lab("i", "yi"), "i").join(lab("j", "yj"), "j")
    same = dot("yi", "yj") / ((F.sqrt(dot("yi", "yi")) + eps) * (F.sqrt(dot("yj", "yj")) + eps))
    s = j.withColumn("l", same).agg(F.sum(F.col("k") * F.col("l")).alias("kl"), F.sum(F.col("k") ** 2).alias("kk"), F.sum(F.col("l") ** 2).alias("ll"))
    n = labels.agg(F.count("*").alias("n"))
    full = lambda c: 2 * F.col(c) + F.col("n")
    return s.crossJoin(n).select((full("kl") / F.sqrt(full("kk") * full("ll") + eps)).alias("alignment"))


def neighbours_kept(base: DataFrame, k: int = 10, noise: float = 0.01, perturbations: int = 3, metric: str = "euclidean", edges: DataFrame | None = None) -> DataFrame:
    """One row ``consistency``: mean share of the k neighbours that stay after Gaussian noise of ``noise`` deviations of all values, from hashes. ``edges`` are the neighbours without noise, if they are known."""
    sd = base.select(F.explode("v").alias("x")).agg(F.stddev_pop("x").alias("sd"))
    unit = lambda i, s: (F.pmod(F.xxhash64("id", i, s), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def shaken(seed: int) -> DataFrame:
        normal = lambda i: F.sqrt(-2 * F.log(unit(i, F.lit(seed)))) * F.cos(2 * np.pi * unit(i, F.lit(seed + 1000)))
        return base.crossJoin(F.broadcast(sd)).select("id", F.transform("v", lambda x, i: x + noise * F.col("sd") * normal(i)).alias("v"))

    near = lambda e, c: e.groupBy("q").agg(F.collect_set("n").alias(c))
    own, out = kept(near(knn(base, k, metric) if edges is None else edges.filter(F.col("rk") <= k), "a")), None
    for seed in range(perturbations):
        one = own.join(near(knn(shaken(seed), k, metric), "b"), "q").select((F.size(F.array_intersect("a", "b")) / float(k)).alias("kept"))
        out = one if out is None else out.union(one)
    return out.agg(F.avg("kept").alias("consistency"))


def suggested_k(n: Column, n_max: int = 20_000) -> Column:
    return F.greatest(F.lit(5), F.bround(F.sqrt(F.least(n, F.lit(n_max))) / 2)).cast("long")


def suggested_dimension(estimate: Column, dims: Column) -> Column:
    """One and a half times the intrinsic dimension, at least 4 and its whole part, at most the dimensions there are; a quarter of those stands for a missing estimate."""
    e = F.coalesce(F.nanvl(estimate, F.lit(None).cast("double")), F.greatest(F.lit(2.0), F.floor(dims / 4).cast("double")))
    return F.least(dims.cast("long"), F.greatest(F.lit(4), F.floor(e), F.bround(1.5 * e)).cast("long"))


def severity(skewness: Column, antihub_ratio: Column, dimension: Column, dims: Column, participation: Column, concentration_ratio: Column, consistency: Column, uniformity_: Column) -> Column:
    """Struct of the score, its grade and the advice its seven groups of rules give."""
    ratio = F.when(dims > 0, F.nanvl(dimension, F.lit(None).cast("double")) / dims)
    rules = [
        (skewness > 5, 2, "strong hubness: reduce dimensions or rescale distances"),
        ((skewness > 2) & (skewness <= 5), 1, "some hubness: neighbours may mislead"),
        (antihub_ratio > 0.3, 1, "many rows are nobody's neighbour"),
        (ratio < 0.1, 2, "intrinsic dimension far below the width: reduce dimensions"),
        ((ratio >= 0.1) & (ratio < 0.3), 1, "intrinsic dimension below the width: reducing dimensions may help"),
        (participation < 0.1 * dims, 2, "very anisotropic: whiten or align"),
        ((participation >= 0.1 * dims) & (participation < 0.3 * dims), 1, "somewhat anisotropic: whitening may help"),
        (concentration_ratio > 0.8, 2, "distances concentrate: neighbours degrade"),
        (consistency < 0.5, 1, "neighbours change under small noise"),
        (uniformity_ > -1.0, 1, "rows cluster: spread them"),
    ]
    score = sum((F.when(c, w).otherwise(0) for c, w, _ in rules), F.lit(0))
    advice = F.array_compact(F.array(*(F.when(c, t) for c, _, t in rules)))
    return F.struct(score.alias("score"), F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low").alias("grade"), F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("nothing to mend"))).alias("advice"))


def analysis(base: DataFrame, n_max: int | None = None) -> DataFrame:
    """One row with all parts of the report on ``base(id, v)``: structs ``intrinsic``, ``hubness``, ``geometry``, ``kernel``, ``suggested``, ``severity``.

    All rows are analysed; ``n_max``, if given, takes the rows with the least hashes, and ``input_rows`` tells how many there are.
    Rows are packed once for all parts that take them as they are. Their neighbours are found once and kept in the shared folder; sums over pairs leave no pair behind.
    """
    from . import pair_sums as PS
    from .dimension import danco, fisher_separability
    from .resampling import subsample

    spark = base.sparkSession
    n = base.count()
    sample = base if n_max is None or n <= n_max else subsample(base, "id", n_max)
    rows = n if n_max is None else min(n, n_max)
    k = max(5, round(np.sqrt(min(rows, 20_000)) / 2))
    own = packed(sample.select("id", "v"))
    edges = kept(knn(sample, max(k, 20), own=own))
    near = edges.filter(F.col("rk") <= k)
    hub = hubness(k_occurrence(near, sample), near).withColumn("antihub_ratio", F.col("antihubs") / F.col("n"))
    iso = isotropy(sample)
    sigma = PS.distance_median(sample, own=own) or 0.0
    spectrum = kernel_spectrum(sample, sigma)
    corr = correlation_in_blocks(sample, edges, own=own)
    dims = intrinsic_dimension(edges, 20).drop("consensus", "uncertainty").select("*", F.lit(corr).cast("double").alias("corr_int"), F.lit(iso["l_pca"]).alias("l_pca"), F.lit(danco(sample, edges, own=own)).alias("danco"), F.lit(fisher_separability(sample)).alias("fisher_s"))
    dims = dims.select("*", *consensus("two_nn", "mle", "mom", "l_pca", "corr_int", "danco", "fisher_s"))
    geometry = PS.concentration(sample, own).withColumnRenamed("mean", "mean_distance").crossJoin(PS.uniformity(unit_rows(sample))).crossJoin(neighbours_kept(sample, k, edges=near))
    geometry = geometry.select("*", *(F.lit(iso[c]).alias(c) for c in ("participation_ratio", "effective_rank", "score")))
    struct = lambda d, name: d.select(F.struct(*d.columns).alias(name))
    one = struct(dims, "intrinsic").crossJoin(struct(hub, "hubness")).crossJoin(struct(geometry, "geometry"))
    one = one.crossJoin(struct(spark.createDataFrame([(float(sigma), *spectrum.values())], ", ".join(f"{c} double" for c in ("sigma", *spectrum))), "kernel"))
    width = F.lit(iso["dims"])
    suggested = F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(sigma)).alias("sigma"), suggested_dimension(F.col("intrinsic.consensus"), width).alias("dimension"))
    graded = severity(F.col("hubness.skewness"), F.col("hubness.antihub_ratio"), F.col("intrinsic.consensus"), width, F.col("geometry.participation_ratio"), F.col("geometry.min_max_ratio"), F.col("geometry.consistency"), F.col("geometry.uniformity"))
    return one.select(F.lit(n).cast("long").alias("input_rows"), width.cast("long").alias("width"), "*", suggested.alias("suggested"), graded.alias("severity"))


def tidy(one_row: DataFrame, category: str) -> DataFrame:
    """``category, metric, value`` of a one-row report."""
    cols = one_row.columns
    return one_row.select(*(F.col(c).cast("double").alias(c) for c in cols)).unpivot([], cols, "metric", "value").select(F.lit(category).alias("category"), "metric", "value")


def tidy_analysis(report: DataFrame) -> DataFrame:
    """The numbers of an ``analysis`` as ``category, metric, value``; its JSON is ``to_json(struct(*))``."""
    out = None
    for part in ("intrinsic", "hubness", "geometry", "kernel", "suggested"):
        one = tidy(report.select(f"{part}.*"), part)
        out = one if out is None else out.union(one)
    return out.union(tidy(report.select("severity.score"), "severity"))
