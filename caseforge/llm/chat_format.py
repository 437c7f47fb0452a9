"""Conversations for training: cumulative snapshots collapsed, then rendered.

A log may hold a conversation many times, each time with more turns. A turn's hash covers its
position, role and text; two 64-bit hashes run along a conversation as the exclusive or of its
turns' hashes up to there. A conversation whose whole hash is the running hash of a longer
one is a prefix of it and goes (anti-join on distinct prefixes, so a hot first turn is one
row); of equal ones the least id stays. The others are rendered turn by turn.

Cases. Turns are ordered by ``turn`` (null last), ties by role and text; the numbers themselves don't
matter. Null roles and texts read as empty. A null id is an id. Repeated rows of a turn are turns.
Marks of the template within a text are broken by a space, so a text can't open a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per turn: ``conv_id``, its place from 1, role, text and the hashes of the conversation up to it."""
    d = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    d = d.withColumn("place", F.row_number().over(order))
    d = d.withColumn("a", F.xxhash64("place", "role", "text")).withColumn("b", F.xxhash64(F.lit("b"), "text", "role", "place"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("a", F.expr("bit_xor(a)").over(so_far)).withColumn("b", F.expr("bit_xor(b)").over(so_far))


def collapsed(conversations: DataFrame, **columns: str) -> DataFrame:
    """The turns of the maximal conversations, with ``n_turns`` and ``n_same`` (how many were logged with just these turns)."""
    t = saved(turns(conversations, **columns))
    ends = t.groupBy("conv_id").agg(F.max_by(F.struct("place", "a", "b"), "place").alias("end")).select("conv_id", F.col("end.place").alias("n_turns"), "end.a", "end.b")
    whole = ends.groupBy("n_turns", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id")).alias("first"), F.count("*").alias("n_same"))
    longer = t.join(ends.select(F.col("conv_id").alias("c"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("c"))).filter("place < n_turns").select(F.col("place").alias("n_turns"), "a", "b").distinct()
    kept = whole.join(longer, ["n_turns", "a", "b"], "left_anti").select(F.col("first.conv_id").alias("c"), "n_turns", "n_same")
    return t.join(kept, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "place", "role", "text", "n_turns", "n_same")


def _safe(c):
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rendered(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row per maximal conversation, rendered as ``<|im_start|>role\\ntext<|im_end|>`` lines."""
    line = F.concat(F.lit(START), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit(END + "\n"))
    by = collapsed(conversations, **columns).groupBy("conv_id", "n_turns", "n_same").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return by.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_same", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat"))
