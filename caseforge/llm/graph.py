"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of ``links(a, b)``; the root is the least node it is linked with.

    Each round takes the least root among a node and its neighbours, then follows roots one
    step further, so chains halve; rounds end when nothing changes. No row leaves the executors.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), let_go=False)
    roots = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), let_go=False)
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("lower"))
        up = roots.select(F.col("node").alias("lower"), F.col("root").alias("up"))
        step = saved(lower.join(up, "lower", "left").select("node", F.col("root").alias("was"), F.least("lower", F.coalesce("up", "lower")).alias("root")), let_go=False)
        roots = step.select("node", "root")
        if step.filter("was <> root").isEmpty():
            return roots
