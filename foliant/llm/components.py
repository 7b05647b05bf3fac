"""Connected components of a graph of longs, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no task or driver holds a component: a hub
is spread by partial aggregation on one side and by Spark's skew join on the other. The
edges of each round are cut from their lineage by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.storage import cut


def dealt_anew(column: str | Column) -> Column:
    """The long ``column``, in a form that hides from the planner how its rows already lie.

    A join on it gets an exchange of its own on that side, which lets adaptive execution
    split the partition of a hot key on the other side.
    """
    return (F.col(column) if isinstance(column, str) else column).bitwiseXOR(F.lit(0).cast("long"))


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` in as many tasks as there are cores at most: most graphs are small beside the tables they come from."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each end of ``edges``: root is the smallest node that can be reached.

    Loops and repeated edges do no harm; edges with a null end are left out. No edges: no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    start = edges.where(x.isNotNull() & y.isNotNull())
    ends = start.select(x.alias("node")).union(start.select(y.alias("node"))).distinct()
    now = cut(_few(start.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()))
    state = _state(now)
    while state[0]:
        least = _few(now.groupBy("u").agg(F.min("v").alias("m"))).select(dealt_anew("u").alias("v"), "m")
        large = _few(now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")))
        large = _few(large.union(least.select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        least = _few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.select(dealt_anew("u").alias("u"), "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(_few(small.union(least.select("u", F.col("m").alias("v"))).distinct()))
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(dealt_anew("u").alias("node"), F.col("v").alias("root"))
    return ends.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
