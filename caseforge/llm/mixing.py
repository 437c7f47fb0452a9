"""Mixing sources to target weights by pivotal dependent rounding.

Sources, in the order of their code points and null last, get the weights in turn; their
targets share ``share`` of all words by weight, none above ``most_copies`` times what the
source has (the excess goes to the others by weight). A document is to be taken target / size
times: that many whole copies for sure, and one more with the fractional probability.

Rounding. A source's documents are dealt to cells of at most a few thousand by hash. In a
cell, by size, two documents with fractions are paired and words move from one to the other,
either way by chance such that expectations hold, until one fraction is 0 or 1. That keeps the
pair's words, so what a cell takes differs from its share by its last, unresolved document at
most. The unresolved ones of many cells meet in a cell of the next level, until each source has
one, which is drawn alone. Chance is a hash of ids and a seed: reruns agree.

Each row is a document of its own, whatever ids repeat or are null. Rows alike in all plain columns
can't be told apart by a hash: together they get the whole number of their fractional copies for
sure and round the rest like one document.

Cases. Null, empty and blank texts have size 0 and are never taken. A null id is an id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh, row_number, saved

WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2.0
CELL, SEED = 4096, 17


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows: the water level at which capped shares sum to the whole.

    Works on one row per source, after the sums.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = by.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    filled = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    # Were this source and all that fill up later to share what is left, the level would be:
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", F.when(level <= F.col("full_at"), level))
    # The first such source fixes the level; if there is none, all are full.
    by = by.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct("full_at", F.coalesce("source", F.lit("")), F.col("source").isNull()))).over(everything))
    return by.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _chance(seed: int, a: int, b: int) -> float:
    return xxhash.xxh3_64_intdigest(b"%d,%d,%d" % (seed, a, b)) / 2.0**64


def pivot(unit: np.ndarray, size: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounds fractions ``p`` of units with sizes; the place of the one left unresolved, or -1."""
    p, held = p.copy(), -1
    for k in range(len(p)):
        if not 1e-12 < p[k] < 1 - 1e-12:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        i, j = held, k
        si, sj = float(size[i]), float(size[j])
        up = min((1 - p[i]) * si, p[j] * sj)  # words from j to i
        down = min(p[i] * si, (1 - p[j]) * sj)  # words from i to j
        move = up if _chance(seed, int(unit[i]), int(unit[j])) < down / (up + down) else -down
        p[i] += move / si
        p[j] -= move / sj
        left = [x for x in (i, j) if 1e-9 < p[x] < 1 - 1e-9]
        for x in (i, j):
            if x not in left:
                p[x] = round(p[x])
        held = left[0] if left else -1
    return p, held


def rounded(units: DataFrame, cell: int = CELL, seed: int = SEED) -> DataFrame:
    """``source, unit, extra`` (0 or 1) for ``source, unit, size, p``; ``p`` is the fraction to round."""
    schema = "source string, unit long, size long, p double, done boolean"

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for source, own in pdf.groupby("source", dropna=False, sort=False):
            # Large ones first, so that what stays unresolved, and is settled by a last draw, is small.
            own = own.sort_values(["size", "unit"], ascending=[False, True], kind="stable")
            p, held = pivot(own["unit"].to_numpy(), own["size"].to_numpy(), own["p"].to_numpy(), seed)
            out.append(pd.DataFrame({"source": own["source"], "unit": own["unit"], "size": own["size"], "p": p, "done": np.arange(len(p)) != held}))
        return pd.concat(out)

    counts = units.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("_n"))
    rows, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    rows, largest, cells = rows or 0, largest or 0, 1
    while largest > cells * cell // 4:
        cells *= 1024 if cells > 1 else max(2, min(1024, -(-largest // (cell // 4))))
    left, out = units.select("source", "unit", "size", "p"), None
    while True:
        # A large source has cells of its own; many small ones share one, each still rounded by itself.
        n = left.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("_n"))
        parts = F.least(F.lit(cells), F.greatest(F.lit(1), F.ceil(F.col("_n") / (cell // 4)))).cast("long")
        dealt = left.join(n, F.col("source").eqNullSafe(F.col("_of"))).withColumn("_parts", parts)
        shared = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(max(1, rows // cell)))
        own = F.xxhash64("source", F.pmod(F.xxhash64("unit", F.lit(seed)), F.col("_parts")))
        dealt = dealt.withColumn("_cell", F.when(F.col("_parts") > 1, own).otherwise(shared)).select("source", "unit", "size", "p", "_cell")
        level = saved(dealt.groupBy("_cell").applyInPandas(lambda pdf: resolve(pdf.drop(columns="_cell")), schema), let_go=False)
        done = level.filter("done").select("source", "unit", F.col("p").cast("int").alias("extra"))
        out = done if out is None else out.union(done)
        left = level.filter("not done").select("source", "unit", "size", "p")
        if cells == 1:
            break
        cells = max(1, cells // 1024)
    last = left.select("source", "unit", (F.pmod(F.xxhash64("unit", F.lit(seed), F.lit("last")), F.lit(1 << 30)) / float(1 << 30) < F.col("p")).cast("int").alias("extra"))
    return out.union(last)


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, cell: int = CELL, seed: int = SEED) -> DataFrame:
    """One row for each ``unit``, the rows alike in their plain columns: ``n_rows, size`` (of one), ``source_size, target, whole`` copies of each, and ``extra`` copies of all together."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), row_number(docs).alias("unit"))
    units = saved(d.groupBy("source", "unit").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count("*").alias("n_rows")), let_go=False)
    aim = targets(units.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights, share, most)
    aim = F.broadcast(aim) if units.select("source").distinct().count() < 100_000 else aim
    told = units.join(aim.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    told = told.withColumn("ratio", F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0))
    told = told.withColumn("whole", F.floor(F.col("ratio") + 1e-12)).withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)) * F.col("n_rows"))
    told = told.withColumn("sure", F.floor(F.col("p") + 1e-12)).withColumn("p", F.greatest(F.col("p") - F.col("sure"), F.lit(0.0)))
    drawn = rounded(told.filter("p > 1e-12"), cell, seed).select(F.col("source").alias("_s"), F.col("unit").alias("_u"), "extra")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("unit") == F.col("_u"))
    extra = (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("long")
    return told.join(drawn, same, "left").select("doc_id", "source", "unit", "n_rows", "size", "source_size", "target", F.col("whole").cast("long").alias("whole"), extra.alias("extra"))


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: its words, its source's words and target, and the words taken."""
    c = copies(docs, doc_id, text, source, **options)
    # Of rows alike, as many as there are extra copies are taken once more.
    kinds = F.array(F.struct((F.col("whole") + 1).alias("copies"), F.col("extra").alias("times")), F.struct(F.col("whole").alias("copies"), (F.col("n_rows") - F.col("extra")).alias("times")))
    each = c.select("*", F.explode(kinds).alias("k")).select("*", F.explode(F.expr("if(k.times > 0, sequence(1, k.times), array())")).alias("_row"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("k.copies")).alias("taken"), "source", F.col("k.copies").cast("int").alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns as they were."""
    unit, at, times, copy = fresh(docs, "_mix_unit", "_mix_at", "_mix_times", "_mix_copy")
    c = saved(copies(docs, doc_id, text, source, **options).select(F.col("unit").alias(at), "n_rows", "whole", "extra"), let_go=False)
    marked = docs.withColumn(unit, row_number(docs))

    def taken(rows: DataFrame, n: DataFrame, once: bool) -> DataFrame:
        joined = rows.join(n.filter(F.col(times) > 0), F.col(unit) == F.col(at))
        joined = joined.dropDuplicates([unit]) if once else joined
        return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)

    out = taken(marked, c.select(at, F.expr("whole + if(n_rows = 1, extra, 0)").alias(times)), False)
    alike = c.filter("n_rows > 1 and extra > 0")
    if alike.isEmpty():
        return out
    # Rows alike are taken ``whole`` times each above; their extra copies come from one of them.
    return out.union(taken(marked, alike.select(at, F.col("extra").alias(times)), True))
