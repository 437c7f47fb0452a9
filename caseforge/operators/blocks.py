"""Blocks of rows, each met with each: the work on pairs of rows.

The rows of a block are one value, an Arrow stream in the order of their ids, and the blocks of a table lie in the shared checkpoint folder, a partition
each. They are joined without a key, so a task reads its two blocks from there: the table is shuffled once, not once for each block it meets.
The number of blocks stays between ``TASKS`` and 64 as a table grows, up to four times the usual rows in a block; a block's bytes are bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import kept

BLOCK, MOST_BYTES = 4096, 16 << 20
#: Tasks that a walk over all blocks is cut into, at least, if there are blocks enough.
TASKS = 48


def block_rows(n: int, width: int, block: int = BLOCK) -> int:
    each = min(4 * block, -(-n // 64)) if n > 64 * block else max(block // 4, min(block, -(-n // TASKS)))
    return max(1, min(each, max(64, MOST_BYTES // (8 * max(1, width)))))


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``b, rows``: the blocks of ``rows(id, v, ...)``, by the hash of the id. Rows with a null vector take no part."""
    rows = rows.filter("v is not null").withColumn("v", F.col("v").cast("array<double>"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n = max(1, -(-size["n"] // block_rows(size["n"], size["width"] or 1, block)))

    def pack(key, t):
        t = t.drop_columns(["b"]).sort_by("id").combine_chunks()
        single = t["v"].cast(pa.list_(pa.float32()))
        if single.cast(t["v"].type).equals(t["v"]):  # nothing is lost: half the bytes for each pair of blocks
            t = t.set_column(t.column_names.index("v"), "v", single)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b", "rows"])

    of_block = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("b").applyInArrow(pack, "b int, rows binary")
    return kept(of_block.repartitionByRange(n, "b"))


def met(left: DataFrame, right: DataFrame, half: bool = False) -> DataFrame:
    """Each block of ``left`` with each of ``right``; with ``half``, of one table, unordered pairs once, shared out evenly: the first of a pair is the lesser if both are odd or both even, else the larger."""
    both = left.select(F.col("b").alias("qb"), F.col("rows").alias("q")).crossJoin(right.select(F.col("b").alias("bb"), F.col("rows").alias("base")).hint("shuffle_replicate_nl"))
    return both.filter("qb = bb or (qb < bb) = ((qb + bb) % 2 = 0)") if half else both


def walked(left: DataFrame, right: DataFrame, half: bool = False) -> DataFrame:
    """``met`` in few partitions, in which one block of ``left`` follows those of ``right``. What is gathered along the way needn't leave the task, but a block may be walked by several."""
    n, each = left.rdd.getNumPartitions(), right.rdd.getNumPartitions()
    return met(left, right, half).coalesce(n * min(each, -(-TASKS // n)))


def whole_walks(left: DataFrame, right: DataFrame) -> DataFrame:
    """``walked`` with a task for each block of ``left``, where Spark doesn't go by the places of the files: what a walk gathers is then mostly whole."""
    return met(left, right).coalesce(left.rdd.getNumPartitions())


#: Just below the largest size that the C library's allocator learns to keep.
KEPT_BYTES = 31 << 20


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, int, pa.Table]]:
    # The allocator gives large arrays back to the system until it has seen a larger one freed. Without this, fetching pages for
    # the arrays of a piece of pairs takes several times as long as the arithmetic on them.
    np.empty(KEPT_BYTES, np.uint8)
    at, own = None, None
    for b in batches:
        for k in range(b.num_rows):
            if (qb := b.column(0)[k].as_py()) != at:
                at, own = qb, pa.ipc.open_stream(b.column(1)[k].as_buffer()).read_all()
            yield qb, own, b.column(2)[k].as_py(), pa.ipc.open_stream(b.column(3)[k].as_buffer()).read_all()
