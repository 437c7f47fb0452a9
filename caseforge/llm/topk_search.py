"""Exact k largest inner products by columnar branch and bound.

The table is laid out vertically once: each task packs its rows into blocks of bounded size, a
block holding its dimensions one after the other, those of the largest mass in the table first,
and each row's length over the dimensions still to come after every step. No row is shuffled for
that, so neither a repeated vector nor a repeated id can fill a block.

The stated queries, packed likewise, meet every block. Scores grow by a step of dimensions at a
time. After a step a row's score lies within the product of both rests' lengths (Cauchy-Schwarz)
of what it has so far; a query's threshold is the k-th largest lower bound, or the k-th exact
score of the rows that lead after the first step, if that is more. Pairs whose upper bound stays
below the threshold go, and the surviving pairs alone, compacted, take the next step. A block
answers at most k rows a query; equal scores go by the smaller id there, as in the end.

Components are 64-bit whole numbers. Where all sums of two blocks stay below 2^53 the steps are products
in doubles, which are exact there; else all pairs of the two are summed as whole numbers of any size,
dimension by dimension, and a score beyond 64 bits becomes the largest or least of them.

Cases. Vectors that are null or hold a null or non-finite component take no part, neither as
queries nor as rows. Vectors of several lengths: what one lacks counts as zero. A query's own
row is the one with its id, so rows that repeat a query's id aren't its candidates; rows that
repeat another id are candidates each. A query id that repeats is answered for each of its rows.
A null id is no query; as a candidate it comes last among equal scores. Fewer than k candidates: all.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .words import pack, unpack

K, SCALE = 5, 256
#: Rows and queries of a block, and dimensions of a step.
ROWS, QUERIES, STEP = 8192, 1024, 8
#: Queries that a task takes at once, and the share of surviving pairs up to which they alone are computed.
AT_ONCE, FEW = 64, 0.05
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCK = "block long, ids array<long>, dims int, columns binary"
FOUND = "block long, at int, query_id long, vec_id long, score long"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("dims", pa.int32()), ("columns", pa.binary())])
_FOUND = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, v``: components ``floor(scale * x)``, without the vectors that take no part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(v.isNotNull() & fit).select(F.col(f"`{vec_id}`").try_cast("long").alias("id"), F.transform(v, lambda x: F.floor(scale * x)).alias("v"))


def _dense(v: pa.ListArray, width: int | None = None) -> np.ndarray:
    """The lists as rows of one width, zeros where a list is shorter."""
    sizes = np.diff(v.offsets.to_numpy())
    m = np.zeros((len(sizes), int(sizes.max(initial=0)) if width is None else width), np.int64)
    m[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy()
    return m


def mass(rows: DataFrame) -> list[int]:
    """The dimensions of ``rows(v)`` by their sum of squares, largest first: as many numbers as the vectors are wide."""

    def squares(batches):
        for b in batches:
            m = (_dense(b.column(0)).astype(np.float64) ** 2).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(m)], names=["dim", "m"])

    by = rows.select("v").mapInArrow(squares, "dim int, m double").groupBy("dim").agg(F.sum("m").alias("m"))
    return [r["dim"] for r in by.orderBy(F.col("m").desc(), "dim").collect()]


def columnar(rows: DataFrame, order: list[int], size: int) -> DataFrame:
    """Blocks of ``rows(id, v)`` in vertical layout, made by each task from the rows that it reads."""
    at = np.array(order, np.int64)

    def packed(batches):
        ids, parts, n = [], [], 0

        def block():
            i, m = pa.concat_arrays(ids), np.concatenate(parts, 1)
            of = [pa.array([secrets.randbits(62)]), pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), i), pa.array([len(m)], pa.int32()), pa.array([pack(m)], pa.binary())]
            return pa.RecordBatch.from_arrays(of, schema=_BLOCK)

        for b in batches:
            done = 0
            while done < b.num_rows:
                own = b.slice(done, size - n)
                ids.append(own.column(0))
                parts.append(np.ascontiguousarray(_dense(own.column(1), len(at))[:, at].T))
                n, done = n + own.num_rows, done + own.num_rows
                if n == size:
                    yield block()
                    ids, parts, n = [], [], 0
        if n:
            yield block()

    return rows.select("id", "v").mapInArrow(packed, BLOCK)


class Columns:
    """A block: ids and which are known, its numbers dimension by dimension, and each row's length over the dimensions from each step on."""

    def __init__(self, block: int, ids: list, dims: int, columns: bytes, step: int = STEP):
        ids = pa.array(ids, pa.int64())
        self.block, self.known = block, ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        n = len(self.ids)
        self.whole = unpack(columns).reshape(dims, n)
        self.largest = max(abs(int(self.whole.max(initial=0))), abs(int(self.whole.min(initial=0))))
        self.x = self.whole.astype(np.float64)
        self.rests = np.stack([np.sqrt((self.x[lo:] ** 2).sum(0)) for lo in range(step, dims, step)]) if dims > step else np.zeros((0, n))
        self.place = np.empty(n, np.int64)  # among equal scores
        self.place[np.lexsort((self.ids, ~self.known))] = np.arange(n)


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th largest."""
    return np.partition(x, x.shape[1] - k, 1)[:, x.shape[1] - k]


def survivors(q: Columns, c: Columns, own: slice, k: int, step: int = STEP, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact score of the pairs that no bound rules out; ``seen`` gets the number of pairs before each step."""
    x, y = c.x, q.x[:, own]
    dims, n = x.shape
    score = y[:step].T @ x[:step]
    open_ = ~(q.known[own][:, None] & c.known & (q.ids[own][:, None] == c.ids))
    floor_ = np.full((y.shape[1], 1), -np.inf)
    if dims > step and n > k:
        lead = np.argpartition(np.where(open_, score, -np.inf), n - k, 1)[:, n - k :]
        full = np.stack([y[:, i] @ x[:, at] for i, at in enumerate(lead)])
        floor_ = np.where(np.take_along_axis(open_, lead, 1), full, -np.inf).min(1)[:, None]
    # Bounds are widened by more than the rounding of the lengths.
    reach = (q.rests[0][own][:, None] * c.rests[0]) * (1 + 1e-9) + 1e-3 if dims > step else np.zeros(score.shape)
    if dims > step and n > k:
        floor_ = np.maximum(floor_, _kth(np.where(open_, score - reach, -np.inf), k)[:, None])
    if seen is not None:
        seen.append(score.size)
    row, col = np.nonzero(open_ & (score + reach >= floor_))
    part, floor_ = score[row, col], floor_[:, 0]
    for s, lo in enumerate(range(step, dims, step)):
        if s:
            keep = part + (q.rests[s][own][row] * c.rests[s][col]) * (1 + 1e-9) + 1e-3 >= floor_[row]
            row, col, part = row[keep], col[keep], part[keep]
        if seen is not None:
            seen.append(len(row))
        hi = min(lo + step, dims)
        if len(row) > FEW * score.size:
            part = part + (y[lo:hi].T @ x[lo:hi])[row, col]
        else:
            for d in range(lo, hi):
                part = part + y[d][row] * x[d][col]
    return row, col, part.astype(np.int64)


def _all_pairs(q: Columns, c: Columns, own: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``survivors`` for numbers whose sums leave the exact doubles."""
    row, col = np.nonzero(~(q.known[own][:, None] & c.known & (q.ids[own][:, None] == c.ids)))
    kind = np.int64 if len(c.whole) * q.largest * c.largest < 1 << 62 else object
    score = np.zeros((q.x[:, own].shape[1], c.x.shape[1]), kind)
    for d in range(len(c.whole)):
        score = score + q.whole[d, own].astype(kind)[:, None] * c.whole[d].astype(kind)
    return row, col, np.array([min(max(int(v), LEAST), MOST) for v in score[row, col]], np.int64)


def best(q: Columns, c: Columns, k: int = K, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of each query's k best rows in ``c``."""
    dims, exact = len(c.whole), len(c.whole) * q.largest * c.largest < EXACT
    out = []
    for a in range(0, q.x.shape[1], AT_ONCE):
        own = slice(a, a + AT_ONCE)
        row, col, score = survivors(q, c, own, k, step) if exact and dims else _all_pairs(q, c, own)
        order = np.lexsort((c.place[col], -1 - score, row))  # -1 - score: the least number has no negative
        row, col, score = row[order], col[order], score[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        first = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row))) < k
        out.append((row[first] + a, col[first], score[first]))
    return tuple(np.concatenate(o) for o in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def nearest(table: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, rows: int = ROWS, at_once: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``table`` with the largest inner products for each row of ``queries``.

    Each block of queries meets each block of rows; of the two, blocks of queries are copied, and what leaves a task
    is at most k rows for each query and block.
    """
    base, asked = whole(table, vec_id, vector, scale), whole(queries, vec_id, vector, scale)
    order = mass(base.unionAll(asked))
    c, q = saved(columnar(base, order, rows), let_go=False), saved(columnar(asked, order, at_once), let_go=False)
    n_rows, n_queries = (max(1, d.count()) for d in (c, q))
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", own(n_queries)).withColumn("cb", every(n_rows))
    right = c.withColumn("cb", own(n_rows)).withColumn("qb", every(n_queries))

    def meet(asked_blocks, row_blocks):
        parts = []
        blocks = [Columns(*r) for r in zip(*(row_blocks[x].to_pylist() for x in ("block", "ids", "dims", "columns")))]
        for r in zip(*(asked_blocks[x].to_pylist() for x in ("block", "ids", "dims", "columns"))):
            one = Columns(*r)
            for block in blocks:
                at, col, score = best(one, block, k)
                ids = pa.array(block.ids[col], pa.int64(), mask=~block.known[col])
                parts.append(pa.table([np.full(len(at), one.block), at.astype(np.int32), one.ids[at], ids, score], schema=_FOUND))
        return pa.concat_tables(parts) if parts else _FOUND.empty_table()

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, FOUND)
    by = Window.partitionBy("block", "at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
