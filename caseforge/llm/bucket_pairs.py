"""Links between the classes of buckets of any size: every pair of different classes is compared, exactly.

A bucket is cut into chunks of bounded members and bytes. A class that fills half a chunk has chunks of its own, which need not meet each
other; the rest share chunks. Each pair of chunks is a row of work: the common shingles of all its pairs of texts at once, by matrix product for
shingles that many hold and by adding up the holders of the others. Of the links found only as many leave as join classes, so
neither copies nor pairs are written out. Time goes with the square of a bucket, memory with a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved
from .words import pack, pack_sorted, unpack, unpack_sorted

#: Members and packed bytes of a chunk.
CHUNK, CHUNK_BYTES = 512, 4 << 20
#: Shingles of a matrix product, sums of two holders at once, and pairs of chunks a task takes.
COLUMNS, HOLDERS, PAIRS = 1024, 1 << 21, 8


class _Chunk:
    """Texts by number, their sizes and classes; the holders of shingle ``k`` of the sorted ``keys`` are ``text`` from ``at[k]`` to ``at[k + 1]``, with the times they hold it, ``tf``."""

    def __init__(self, arrays: list[bytes]):
        self.root, self.weight, self.terms, self.idf, sizes, place, tf = map(unpack, arrays[:-1])
        self.keys = unpack_sorted(arrays[-1])
        text = np.repeat(np.arange(len(self.root)), sizes)
        order = np.argsort(place, kind="stable")
        self.text, self.tf = text[order], tf[order].astype(float)
        self.at = np.searchsorted(place[order], np.arange(len(self.keys) + 1))

    def holders(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the shingles ``keys``, one after the other: the place among them, and the place in ``text``."""
        n = self.at[keys + 1] - self.at[keys]
        of = np.repeat(np.arange(len(keys)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.at[keys][of]

    def dense(self, keys: np.ndarray) -> np.ndarray:
        of, at = self.holders(keys)
        out = np.zeros((len(self.root), len(keys)))
        out[self.text[at], of] = 1
        return out


def _packed(t: pa.Table) -> list[bytes]:
    keys, idf, tf = ([read(x) for x in t[c].to_pylist()] for c, read in (("keys", unpack_sorted), ("idf", unpack), ("tf", unpack)))
    distinct, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    own = [t[c].to_numpy() for c in ("root", "weight", "terms")]
    sizes = np.array([len(k) for k in keys], np.uint32)
    return [*map(pack, (*own, np.concatenate(idf)[first], sizes, place.astype(np.uint32), np.concatenate(tf))), pack_sorted(distinct)]


def common(a: _Chunk, b: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """For each text of ``a`` with each of ``b``, the number of common shingles, with repeats, and their weight."""
    shape = len(a.root), len(b.root)
    terms, weight = np.zeros(shape), np.zeros(shape)
    _, ka, kb = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)
    idf, sums = a.idf[ka].astype(float), (a.at[ka + 1] - a.at[ka]) * (b.at[kb + 1] - b.at[kb])
    many = sums > terms.size // 64
    for x in range(0, int(many.sum()), COLUMNS):
        s = np.flatnonzero(many)[x : x + COLUMNS]
        left, right = a.dense(ka[s]), b.dense(kb[s]).T
        terms += left @ right
        left *= idf[s]
        weight += left @ right
    few = np.flatnonzero(~many)
    cuts = np.searchsorted(np.cumsum(sums[few]), np.arange(HOLDERS, sums[few].sum() + HOLDERS, HOLDERS), "right")
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(few)]):
        if x == y:
            continue
        s = few[x:y]
        of, at = a.holders(ka[s])
        n = (b.at[kb + 1] - b.at[kb])[s][of]
        row, key = np.repeat(a.text[at], n), np.repeat(of, n)
        col = b.text[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + b.at[kb[s]][key]]
        code = row * shape[1] + col
        terms += np.bincount(code, minlength=terms.size).reshape(shape)
        weight += np.bincount(code, idf[s][key], minlength=terms.size).reshape(shape)
    # So far each is taken as held once. Held more often by both, it counts for more.
    often = lambda c, k: np.add.reduceat(np.append(c.tf > 1, False), c.at[:-1])[k] > 0 if len(c.keys) else np.zeros(0, bool)
    for k in np.flatnonzero(often(a, ka) & often(b, kb)).tolist():
        i, j = (slice(c.at[m], c.at[m + 1]) for c, m in ((a, ka[k]), (b, kb[k])))
        more = np.minimum.outer(a.tf[i], b.tf[j]) - 1
        at = np.ix_(a.text[i], b.text[j])
        terms[at] += more
        weight[at] += more * idf[k]
    return terms, weight


def _joining(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links of classes ``a, b`` those that join what the ones before leave apart."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        if (p := top(x)) != (q := top(y)):
            parent[q] = p
            left.append(x), right.append(y)
    return left, right


def class_links(members: DataFrame, vecs: DataFrame, threshold: float, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Links ``a, b`` that join the classes ``root`` of ``members(band, node, root)`` wherever a pair of a bucket reaches the threshold."""
    m = members.select("band", "node", "root").join(vecs.select("node", (F.length("keys") + F.length("tf") + F.length("idf")).alias("bytes")), "node")
    m = saved(m, let_go=False)
    share = F.greatest(F.count("*") / chunk, F.sum("bytes") / chunk_bytes)
    of_class = m.groupBy("band", "root").agg(share.alias("share")).withColumn("lone", F.col("share") >= 0.5)
    rest = of_class.filter("not lone").groupBy("band").agg(F.sum("share").alias("rest"))
    parts = of_class.join(rest, "band", "left").select("band", "root", "lone", F.ceil(F.when(F.col("lone"), F.col("share")).otherwise(F.col("rest"))).alias("parts"))
    part = F.pmod(F.xxhash64(F.when(F.col("lone"), F.col("node")).otherwise(F.col("root"))), "parts")
    placed = m.join(parts, ["band", "root"]).select("band", "node", "root", F.when(F.col("lone"), F.col("root")).alias("whole"), part.alias("part"))
    # Saved, so that the list of chunks and their contents are of one mind.
    placed = saved(placed.withColumn("chunk", F.xxhash64("band", F.col("whole").isNull(), F.coalesce("whole", F.lit(0)), "part")), let_go=False)

    def packed(key, t):
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([_packed(t)], pa.list_(pa.binary()))], names=["chunk", "arrays"])

    chunks = placed.select("chunk", "node", "root").join(vecs.select("node", "weight", "terms", "keys", "tf", "idf"), "node")
    chunks = saved(chunks.groupBy("chunk").applyInArrow(packed, "chunk long, arrays array<binary>"), let_go=False)
    one = placed.select("band", "chunk", "whole").distinct()
    two = one.select(*(F.col(c).alias(f"{c}_b") for c in one.columns))
    apart = F.col("whole").isNull() | F.col("whole_b").isNull() | (F.col("whole") != F.col("whole_b"))
    pairs = saved(one.join(two, (F.col("band") == F.col("band_b")) & (F.col("chunk") <= F.col("chunk_b")) & apart).select("chunk", "chunk_b"), let_go=False)

    def meet(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = _Chunk(batch["arrays"][k].as_py()), _Chunk(batch["arrays_b"][k].as_py())
                terms, weight = common(a, b)
                terms /= a.terms[:, None] + b.terms - terms
                weight /= a.weight[:, None] + b.weight - weight
                row, col = np.nonzero((np.maximum(terms, weight) >= threshold - 1e-9) & (a.root[:, None] != b.root))
                left, right = _joining(a.root[row], b.root[col])
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    tasks = max(1, -(-pairs.count() // PAIRS))
    work = pairs.join(chunks, "chunk").repartition(tasks, "chunk_b").join(chunks.select(F.col("chunk").alias("chunk_b"), F.col("arrays").alias("arrays_b")), "chunk_b")
    return work.select("arrays", "arrays_b").mapInArrow(meet, "a long, b long").distinct()
