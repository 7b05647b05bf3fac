"""Summaries of a section tree from the leaves up, level by level, kept by what they were made of.

A short leaf is its own summary; a longer text, and what a holder's own words and its children's
summaries make together, goes to a function of the caller. What that returns is kept in a folder under
the fingerprint of its input, each level as it is done: a run that was lost goes on where it ended,
and after a change only the changed leaves and what holds them are made anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.text import squeezed
from foliant.sources.staging import written
from foliant.sources.store import Folder

#: Characters up to which a leaf's text is its summary.
SHORT = 800
KNOWN = "fingerprint string, summary string"


def fingerprint(source: str) -> Column:
    return F.sha2(F.col(source), 256)


def known(spark, folder: str) -> DataFrame:
    """``fingerprint, summary`` of what is kept; one row each, the least if runs that met made two."""
    names = [n for n in Folder(spark, folder).names("") if n.startswith("level-")]
    complete = [n for n in names if "_SUCCESS" in Folder(spark, folder).names(n)]
    if not complete:
        return spark.createDataFrame([], KNOWN)
    rows = spark.read.schema(KNOWN).parquet(*(f"{folder.rstrip('/')}/{n}" for n in complete))
    return rows.groupBy("fingerprint").agg(F.min("summary").alias("summary"))


def inputs(level: DataFrame, below: DataFrame | None) -> DataFrame:
    """``level`` with ``source``: a leaf's text, or a holder's title, own text and its children's titles and summaries in order."""
    own = squeezed(F.coalesce("text", F.lit("")))
    rows = level.withColumn("_own", own)
    if below is None:
        return rows.withColumns({"source": F.col("_own"), "leaf": F.lit(True)}).drop("_own")
    item = F.concat(F.col("title"), F.lit(": "), F.col("summary"))
    parts = below.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]), "\n").alias("_below"))
    rows = rows.join(parts, ["doc_id", "node_id"], "left")
    whole = F.concat_ws("\n", F.col("title"), F.when(F.col("_own") != "", F.col("_own")), F.col("_below"))
    return rows.withColumns({"leaf": F.col("_below").isNull(), "source": F.when(F.col("_below").isNull(), F.col("_own")).otherwise(whole)}).drop("_own", "_below")


def summarized(nodes: DataFrame, texts: DataFrame, call: Callable[[DataFrame], DataFrame], folder: str, short: int = SHORT) -> DataFrame:
    """``doc_id, node_id, parent_id, ord, title, summary, fingerprint`` of every node.

    ``nodes(doc_id, node_id, parent_id, depth, ord, title)``, ``texts(doc_id, node_id, text)``: a node's own text,
    without its children's. ``call`` takes ``fingerprint, source`` and returns ``fingerprint, summary``; it gets
    each input once, however many nodes share it. What it returns no summary for is an error. Nodes without a
    text count as empty; no nodes: no rows.
    """
    spark = nodes.sparkSession
    rows = nodes.select("doc_id", "node_id", "parent_id", "depth", "ord", F.coalesce("title", F.lit("")).alias("title")).join(texts.select("doc_id", "node_id", "text"), ["doc_id", "node_id"], "left")
    rows = written(rows, "summary-nodes")
    out = below = None
    for depth in range(rows.agg(F.max("depth")).first()[0] or 0, 0, -1):
        level = inputs(rows.where(F.col("depth") == depth), below).withColumn("fingerprint", fingerprint("source"))
        level = written(level, "summary-level")
        asks = ~F.col("leaf") | (F.length("source") > short)
        asked = level.where(asks).groupBy("fingerprint").agg(F.min("source").alias("source"))
        fresh = asked.join(known(spark, folder).select("fingerprint"), "fingerprint", "left_anti")
        if fresh.limit(1).count():
            number = len(Folder(spark, folder).names(""))
            call(fresh).select("fingerprint", F.col("summary").cast("string").alias("summary")).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/level-{number:06d}")
        made = level.join(known(spark, folder), "fingerprint", "left")
        summary = F.when(~asks, F.col("source")).when(F.col("summary").isNotNull(), F.col("summary")).otherwise(F.raise_error(F.concat(F.lit("no summary for node "), F.col("node_id"))).cast("string"))
        below = written(made.select("doc_id", "node_id", "parent_id", "ord", "title", summary.alias("summary"), "fingerprint"), "summary-done")
        out = below if out is None else out.unionByName(below)
    return out if out is not None else rows.select("doc_id", "node_id", "parent_id", "ord", "title", F.lit("").alias("summary"), F.lit("").alias("fingerprint"))
