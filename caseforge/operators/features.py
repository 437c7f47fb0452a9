"""Featurisation fitted on the training rows of each fold and applied to the rest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import average_ranks, kept
from .vectors import as_vectors, moments, pca, projected


def with_indicators(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``<column>__is_missing`` for each column; missing numbers become 0 and categories ``"0"``."""
    flags = {f"{c}__is_missing": F.col(c).isNull().cast("int") for c in (*numeric, *categorical)}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in categorical}
    return df.withColumns(flags).withColumns(filled)


def one_hot(df: DataFrame, split: str, role: str, key: str, column: str) -> DataFrame:
    """Long one-hot ``split, key, category, value`` with the categories of each split's training rows; unknown ones are 0 throughout."""
    known = df.filter(F.col(role) == 0).select(split, F.col(column).alias("category")).distinct()
    return df.join(known, split).select(split, key, "category", (F.col(column).eqNullSafe(F.col("category"))).cast("int").alias("value"))


def one_hot_fixed(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    return df.select("*", *((F.coalesce(F.col(column) == c, F.lit(False))).cast("int").alias(f"{column}_{c}") for c in categories))


def minmax(df: DataFrame, split: str, role: str, columns: list[str]) -> DataFrame:
    """Scaled by the range of each split's training rows; not clipped; a constant column keeps its distance from the constant."""
    fit = df.filter(F.col(role) == 0).groupBy(split).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    width = lambda c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).otherwise(1.0)
    out = df.join(F.broadcast(fit), split)
    return out.withColumns({c: (F.col(c) - F.col(f"_lo_{c}")) / width(c) for c in columns}).drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


def standard_scaled(df: DataFrame, split: str, role: str, key: str, vector: str) -> DataFrame:
    """Long ``split, key, dim, z`` by the training rows' mean and population deviation; a constant dimension is centred only."""
    long = df.select(split, role, key, F.posexplode(vector).alias("dim", "x"))
    fit = long.filter(F.col(role) == 0).groupBy(split, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return long.join(F.broadcast(fit), [split, "dim"]).select(split, key, "dim", ((F.col("x") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)).alias("z"))


def tfidf(tokens: DataFrame, key: str, words: str, max_features: int | None = None, fit: Column | None = None) -> DataFrame:
    """``key, term, weight``: counts times ``ln((1 + n) / (1 + df)) + 1``, rows of length 1.

    Terms of two word characters or more; the ``max_features`` most frequent in the rows that
    ``fit`` selects (all, if none is given).
    """
    # Words are computed once: ``explode`` would have them twice, for Spark first filters the rows that have any, and both uses of
    # ``tf`` read one shuffle only if they read the same columns.
    long = tokens.select(key, F.explode_outer(words).alias("term"), (F.lit(True) if fit is None else fit).alias("_fit")).filter(F.char_length("term") >= 2)
    tf = long.groupBy(key, "term", "_fit").agg(F.count("*").alias("tf"))
    n = tokens.filter(F.lit(True) if fit is None else fit).count()
    df_ = tf.filter("_fit").groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"), F.sum("tf").alias("total"))
    if max_features is not None:
        df_ = df_.orderBy(F.col("total").desc(), "term").limit(max_features)
    w = tf.join(df_, "term").select(key, "term", (F.col("tf") * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    length = F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / length).alias("weight"))


#: Directions sampled beyond those wanted, and turns of the range finder.
OVERSAMPLED, TURNS = 10, 3
#: Terms whose drawn numbers a task keeps at once.
KNOWN_TERMS = 100_000


def _per_task(rows: DataFrame, width: int, f) -> DataFrame:
    """``f(terms, weights, y)`` of each row of ``rows(key, terms, weights[, y])`` is a list of numbers of ``width``."""
    key = rows.schema.fields[0]
    schema = T.StructType([key, *(rows.schema[c] for c in ("terms", "weights")), T.StructField("y", T.ArrayType(T.DoubleType()))])

    def each(batches):
        for b in batches:
            t = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("terms", "weights")]
            y = b.column(b.schema.get_field_index("y")).to_pylist() if "y" in b.schema.names else [None] * b.num_rows
            out = [f(*x).tolist() for x in zip(*t, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.float64()))], names=[key.name, "terms", "weights", "y"])

    return rows.mapInArrow(each, schema)


def _gram(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """Sum of the outer products of a column of short vectors: one width x width matrix comes here."""

    def part(batches):
        g = np.zeros((width, width))
        for b in batches:
            m = np.asarray(b.column(0).flatten()).reshape(-1, width)
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([g.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["g"])

    sums = rows.select(column).mapInArrow(part, "g array<double>").select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for r in sums:
        out[r["at"]] = r["x"]
    return out.reshape(width, width)


def _triangles(rows: DataFrame, column: str, width: int, groups: int = 16) -> np.ndarray:
    """R of the tall matrix whose rows are a column of short vectors: each task's block has its own R, and these are stacked and decomposed again in groups, last on the driver."""
    of = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("r", T.ArrayType(T.DoubleType()))])

    def own(batches):
        r = np.zeros((0, width))
        for b in batches:
            r = np.linalg.qr(np.concatenate([r, np.asarray(b.column(0).flatten()).reshape(-1, width)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.pad(r, ((0, width - len(r)), (0, 0))).reshape(-1).tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    def stacked(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        r = np.linalg.qr(np.asarray(table["r"].combine_chunks().flatten()).reshape(-1, width), mode="r")
        return pa.table([pa.array([table["part"][0].as_py()], pa.int32()), pa.array([r.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    blocks = rows.select(column).mapInArrow(own, of).withColumn("part", F.spark_partition_id())
    top = blocks.groupBy(F.pmod("part", F.lit(groups))).applyInArrow(stacked, of).collect()
    r = np.linalg.qr(np.array([x["r"] for x in sorted(top, key=lambda x: x["part"])]).reshape(-1, width), mode="r")
    return np.pad(r, ((0, width - len(r)), (0, 0)))


def _drawn(term: str, seed: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")]).normal(size=width)


def svd_parts(tfidf_rows: DataFrame, key: str, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Randomised singular value decomposition of ``tfidf_rows(key, term, weight)``: scores ``(key, z)``, loadings ``(term, v)`` and the singular values.

    A row's first image is by Gaussian numbers drawn from the hashes of its terms, so nothing as wide as the terms is sent. Each turn makes the
    images orthonormal by a tree of triangles (TSQR) and takes them through the table and back; terms are summed and joined by shuffles, whatever their
    number. The driver holds matrices of k + ``OVERSAMPLED`` columns and rows. Of each component the loading of largest size is positive.
    """
    rows = kept(tfidf_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("x")).select(key, F.col("x.term").alias("terms"), F.col("x.weight").alias("weights")))
    n_rows, n_terms = rows.count(), rows.select(F.explode("terms").alias("term")).distinct().count()
    k = max(0, min(k, n_terms - 1, n_rows))
    width = min(k + OVERSAMPLED, n_terms, max(1, n_rows))

    known: dict[str, np.ndarray] = {}  # of the task: a generator for each occurrence would cost far more than its numbers

    def drawn(terms, weights, _):
        out = np.zeros(width)
        for t, w in zip(terms, weights):
            if (x := known.get(t)) is None:
                if len(known) >= KNOWN_TERMS:
                    known.clear()
                x = known[t] = _drawn(t, seed, width)
            out += w * x
        return out

    def through(images: DataFrame, turn: np.ndarray) -> DataFrame:
        """``term, b``: the table's transpose times the images times ``turn``."""

        def summed(batches):
            total: dict[str, np.ndarray] = {}
            for b in batches:
                q = np.asarray(b.column(2).flatten()).reshape(-1, width) @ turn
                for terms, weights, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), q):
                    for t, w in zip(terms, weights):
                        total[t] = total[t] + w * v if t in total else w * v
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["term", "b"])

        part = images.select("terms", "weights", "y").mapInArrow(summed, "term string, b array<double>")
        return part.groupBy("term").agg(*(F.sum(F.get("b", i)).alias(f"b{i}") for i in range(width))).select("term", F.array(*(F.col(f"b{i}") for i in range(width))).alias("b"))

    def back(loads: DataFrame) -> DataFrame:
        """The table times the loadings, row by row."""
        long = rows.select(key, F.explode(F.arrays_zip("terms", "weights")).alias("x")).select(key, F.col("x.terms").alias("term"), F.col("x.weights").alias("w"))
        y = long.join(loads, "term").groupBy(key).agg(*(F.sum(F.col("w") * F.get("b", i)).alias(f"y{i}") for i in range(width)))
        return rows.join(y.select(key, F.array(*(F.col(f"y{i}") for i in range(width))).alias("y")), key)

    images = kept(_per_task(rows, width, drawn))
    for turn in range(TURNS + 1):
        r = _triangles(images, "y", width)
        loads = kept(through(images, np.linalg.pinv(r)))
        if turn < TURNS:
            images = kept(back(loads.select("term", "b")))
    # The table is Q B^T with Q the last orthonormal images: the values and turns are those of B's small Gram matrix.
    lam, w = np.linalg.eigh(_gram(loads, "b", width))
    order = np.argsort(-lam)[:k]
    sigma, w = np.sqrt(np.maximum(lam[order], 0)), w[:, order]
    inverse = w / np.where(sigma > 0, sigma, 1)
    load = loads.select("term", F.array(*(sum((F.get("b", i) * float(inverse[i, j]) for i in range(width)), F.lit(0.0)) for j in range(k))).alias("v"))
    top = load.agg(*(F.max_by(F.get("v", j), F.struct(F.abs(F.get("v", j)), "term")).alias(f"s{j}") for j in range(k))).first() if k else []
    sign = np.array([1.0 if x is None or x >= 0 else -1.0 for x in top])
    scores = np.linalg.pinv(r) @ w * (sigma * sign)
    z = images.select(key, F.array(*(sum((F.get("y", i) * float(scores[i, j]) for i in range(width)), F.lit(0.0)) for j in range(k))).alias("z"))
    return z, load.select("term", F.array(*(F.get("v", j) * float(sign[j]) for j in range(k))).alias("v")), sigma


def svd(tfidf_rows: DataFrame, key: str, k: int) -> DataFrame:
    """``key, dim, z``: the k leading right-singular projections (one fewer than the terms at most), rows of length 1."""
    z = svd_parts(tfidf_rows, key, k)[0]
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    return z.select(key, F.posexplode("z").alias("dim", "x"), length.alias("_l")).select(key, "dim", F.try_divide("x", "_l").alias("z"))


def ranked(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Long ``key, column, rank`` with average ranks; nulls have no rank."""
    long = df.unpivot([key], columns, "column", "x").filter("x is not null")
    rank = F.rank().over(Window.partitionBy("column").orderBy("x")) + (F.count("*").over(Window.partitionBy("column", "x")) - 1) / 2
    return long.select(key, "column", rank.alias("rank"))


def spearman_pairs(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``a, b, rho`` (absolute) for each pair of columns, on columns without nulls: one pass over the ranks of a row at a time."""
    wide = ranked(df, columns, key).groupBy(key).pivot("column", columns).agg(F.first("rank"))
    stats = wide.agg(*(F.struct(F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("x"), F.stddev_pop(b).alias("y")).alias(f"{a}|{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]))
    names = stats.columns
    long = stats.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"`{n}`").alias("s")) for n in names))).alias("r"))
    return long.select(F.split("r.n", r"\|")[0].alias("a"), F.split("r.n", r"\|")[1].alias("b"), F.abs(F.try_divide(F.col("r.s.c"), F.col("r.s.x") * F.col("r.s.y"))).alias("rho"))


def dummies(df: DataFrame, categorical: list[str], least: int = 5) -> tuple[DataFrame, dict[str, list[str]]]:
    """0/1 columns of the categories with enough rows; the fill category "0" has none. Categories are bounded by ``rows / least`` and few in practice."""
    of: dict[str, list[str]] = {}
    for c in categorical:
        counts = df.groupBy(c).count().filter(F.col("count") >= least).orderBy(c).collect()
        of[c] = [r[c] for r in counts if r[c] not in (None, "0")]
    cols = {f"{c}={v}": (F.col(c) == v).cast("double") for c, vs in of.items() for v in vs}
    return df.withColumns(cols), {c: [f"{c}={v}" for v in vs] for c, vs in of.items()}


def associations(df: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Absolute rank correlation of each pair of columns; a categorical one counts as the largest over its dummies."""
    wide, of = dummies(df, categorical)
    parts = {**{c: [c] for c in numeric}, **of}
    owner = F.create_map(*(F.lit(x) for own, cols in parts.items() for c in cols for x in (c, own)))
    p = spearman_pairs(wide.select(key, *(F.col(f"`{c}`").cast("double").alias(c.replace("=", "__eq__")) for cols in parts.values() for c in cols)), [c.replace("=", "__eq__") for cols in parts.values() for c in cols], key)
    back = lambda c: F.replace(F.col(c), F.lit("__eq__"), F.lit("="))
    p = p.select(owner[back("a")].alias("a"), owner[back("b")].alias("b"), "rho").filter("a <> b")
    return p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("rho").alias("rho"))


def spearman_matrix(df: DataFrame, key: str, vector: str) -> np.ndarray:
    """Absolute rank correlations of all dimensions of a vector column, a width x width matrix; ranks are average ones, ordered in ranges of all dimensions together. A dimension that doesn't vary has no correlation (NaN)."""
    long = df.select(F.col(key).cast("long").alias("id"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    ranked_ = average_ranks(long, F.col("x"), ("dim",))
    rows = ranked_.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "rank"))), lambda r: r["rank"].cast("double")).alias("v"))
    _, _, scatter = moments(rows)
    sd = np.sqrt(np.diag(scatter))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.abs(scatter / np.outer(sd, sd))


def complete_linkage(names: list[str], rho: dict[tuple[str, str], float], tau: float) -> dict[str, int]:
    """Clusters of columns by complete linkage on ``1 - rho``, cut at ``1 - tau``. Columns are the width of a table, not its rows; a pair without ``rho`` is at distance 1."""
    n, at = len(names), {c: i for i, c in enumerate(names)}
    d = np.ones((n, n))
    for (a, b), r in rho.items():
        d[at[a], at[b]] = d[at[b], at[a]] = 1 - r
    d[np.tril_indices(n)] = np.inf  # each pair once, the first of equals by its place
    members = {i: [i] for i in range(n)}
    while len(members) > 1:
        i, j = divmod(int(d.argmin()), n)
        if d[i, j] > 1 - tau:
            break
        members[i] += members.pop(j)
        for k in members:
            if k != i:
                x, y = (min(i, k), max(i, k)), (min(j, k), max(j, k))
                d[x] = max(d[x], d[y])
        d[j, :] = d[:, j] = np.inf
    return {names[x]: k for k, own in enumerate(members.values()) for x in own}


def representatives(clusters: dict[str, int], rho: dict[tuple[str, str], float], essential: set[str] = frozenset()) -> list[str]:
    """Of each cluster its essential columns, else the medoid, the first among equals."""
    out = []
    d = lambda a, b: 0.0 if a == b else 1 - rho.get((a, b), rho.get((b, a), 0.0))
    for k in sorted(set(clusters.values())):
        own = [n for n, c in clusters.items() if c == k]
        out += [n for n in own if n in essential] or [min(own, key=lambda n: (sum(d(n, m) for m in own), own.index(n)))]
    return out


def pca_scores(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    base = as_vectors(df, key, vector)
    mean, comps = pca(base, k)
    return projected(base, mean, comps)


#: The signals of each family of the confidence head.
FAMILIES = {"ici_only": ("ici",), "p_only": ("p_t", "p_m", "p_x"), "ici_plus_p": ("ici", "p_t", "p_m", "p_x")}


def family(df: DataFrame, name: str, into: str = "features") -> DataFrame:
    """``df`` with the signals of a family as one vector, in their frozen order."""
    if name not in FAMILIES:
        raise ValueError(f"unknown family {name}")
    return df.withColumn(into, F.array(*(F.col(c).cast("double") for c in FAMILIES[name])))
