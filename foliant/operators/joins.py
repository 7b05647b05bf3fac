"""Joins with small sides: a side is broadcast only after its rows were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

#: Rows of narrow tables (rules, terms, questions) up to which a side is broadcast.
MOST_ROWS = 100_000


def small(side: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it has ``most`` rows or fewer; else left to the planner."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the files that hold them make fewer parts; many files stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, width: float | None = None) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` of the same ``by`` whose ``on`` is at most its own; null if there is none.

    Of right rows of one place the greatest value counts. Both sides go through one order, so nothing is paired.
    ``width``: stretches of ``on`` (numbers) that a key's rows are dealt to, so that a key with a large part of all rows
    is read by many tasks; what a stretch begins with comes from the last value of each one before it. Rows whose ``on`` is
    null meet nothing; null keys meet null keys.
    """
    if value in left.columns:
        raise ValueError(f"column {value} is on both sides")
    own = [F.col(c) for c in left.columns]
    stretch = F.floor(F.col(on) / width) if width else F.lit(0)
    lefts = left.select(*by, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), stretch.alias("_s"))
    rights = right.where(F.col(on).isNotNull() & F.col(value).isNotNull()).groupBy(*by, on).agg(F.max(value).alias(value))
    rights = rights.select(*by, F.col(on).alias("_on"), F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), stretch.alias("_s"))
    last = Window.partitionBy(*by, "_s").orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = lefts.unionByName(rights).withColumn("_value", F.last("_value", ignorenulls=True).over(last)).where("_side = 1")
    if width:
        ends = rights.groupBy(*by, "_s").agg(F.max_by("_value", "_on").alias("_end"))
        stretches = met.select(*by, "_s").distinct().withColumn("_end", F.lit(None).cast(right.schema[value].dataType)).withColumn("_asked", F.lit(1))
        before = Window.partitionBy(*by).orderBy("_s", "_asked").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_asked", F.lit(2)).unionByName(stretches).withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_asked = 1")
        names = [f"_k{i}" for i in range(len(by))]
        carried = carried.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_s").alias("_t"), "_carried")
        same = F.col("_s").eqNullSafe(F.col("_t"))
        for c, n in zip(by, names):
            same = same & F.col(c).eqNullSafe(F.col(n))
        met = met.join(carried, same, "left").withColumn("_value", F.coalesce("_value", "_carried"))
    return met.select("_row.*", F.when(F.col("_on").isNotNull(), F.col("_value")).alias(value))
