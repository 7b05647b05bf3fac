"""Headers and footers in three passes over the blocks of a document's pages.

1. From each edge of a page inwards, blocks are candidates until the first that is body.
2. Candidates of pages up to three apart are compared, by an equi-join on the page they are looked for on:
   like text at the same place, or page numbers that rise with the pages.
3. The texts that recur most in a document mark others of their kind: those that stand as far out as most
   of what was found, and are at least half the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

ZONE, REACH, NEAR = 0.2, 3, 10.0
#: A block of so many characters, or lines, is body and ends the walk from the edge.
BODY_CHARS, BODY_LINES = 200, 4
#: The recurring texts of the last pass, and the share of the found ones that stand further in than its cut.
RECURRING, CUT = 3, 0.2
KEY = ["doc_id", "page", "column", "block"]


def masked(text: str) -> Column:
    """A text with every number as ``#``: what a page number leaves alike."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), "[0-9]+", "#")


def closer(a: Column, b: Column, part: int) -> Column:
    """Whether two texts differ in less than a ``part``-th of the shorter one; the limit bounds the work."""
    limit = F.floor(F.least(F.length(a), F.length(b)) / part).cast("int")
    found = F.call_function("levenshtein", a, b, limit)
    return (limit > 0) & (found >= 0) & (found < limit)


def edge_candidates(blocks_: DataFrame, pages: DataFrame) -> DataFrame:
    """``KEY, zone, text, left, top, height``: the blocks of the outer fifths that no body block stands outside of."""
    rows = blocks_.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    body = ((F.length("text") >= BODY_CHARS) | (F.col("n_lines") >= BODY_LINES)).cast("int")
    rows = rows.select(*KEY, "text", "left", "top", "bottom", "height", body.alias("body"))

    def walk(zone: str, order: Column, inside: Column) -> DataFrame:
        seen = F.sum("body").over(Window.partitionBy("doc_id", "page").orderBy(order, "left", "block").rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("seen", seen).where((F.col("seen") == 0) & inside).select(*KEY, F.lit(zone).alias("zone"), "text", "left", "top", "height")

    above = walk("header", F.desc("top"), F.col("bottom") >= (1 - ZONE) * F.col("height"))
    return above.unionByName(walk("footer", F.asc("bottom"), F.col("top") <= ZONE * F.col("height")))


def matched(candidates: DataFrame) -> DataFrame:
    """The candidates that another page within ``REACH`` repeats: ``KEY, zone``."""
    last = F.try_to_number(F.regexp_extract("text", r"(?:^|\D)([0-9]{1,4})\s*$", 1), F.lit("9999"))
    own = candidates.select(*KEY, "zone", "text", "left", "top", last.alias("number"))
    steps = [d for d in range(-REACH - 1, REACH + 2) if d]
    other = own.select("doc_id", "zone", F.explode(F.array(*map(F.lit, steps))).alias("step"), F.col("page").alias("p2"), F.col("text").alias("t2"), F.col("left").alias("l2"), F.col("top").alias("y2"), F.col("number").alias("n2"))
    other = other.withColumn("page", F.col("p2") + F.col("step")).drop("p2")
    pairs = own.join(other, ["doc_id", "zone", "page"])
    at = (F.col("left") - F.col("l2")) ** 2 + (F.col("top") - F.col("y2")) ** 2 < NEAR**2
    alike = at & (F.abs("step") <= REACH) & ((F.col("text") == F.col("t2")) | closer(F.col("text"), F.col("t2"), 5))
    level = F.abs(F.col("top") - F.col("y2")) < NEAR  # numbers may change sides
    rises = level & F.abs("step").isin(1, 2, 4) & (F.col("number") - F.col("n2") == F.col("step")) & (F.length("text") <= 40)
    return pairs.where(alike | F.coalesce(rises, F.lit(False))).select(*KEY, "zone").distinct()


def recurring(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates like one of a document's most recurring texts, as far out as most of what was found: ``KEY, zone``."""
    known = candidates.join(found, [*KEY, "zone"], "left_semi").withColumn("form", masked("text"))
    first = Window.partitionBy("doc_id", "zone").orderBy(F.desc("n"), "form")
    forms = known.groupBy("doc_id", "zone", "form").agg(F.count_distinct("page").alias("n")).where("n >= 2").withColumn("r", F.row_number().over(first)).where(F.col("r") <= RECURRING)
    share = F.col("top") / F.col("height")
    cut = known.withColumn("y", share).groupBy("doc_id", "zone").agg(F.percentile("y", F.lit(CUT)).alias("low"), F.percentile("y", F.lit(1 - CUT)).alias("high"))
    rest = candidates.join(found, [*KEY, "zone"], "left_anti").withColumns({"own": masked("text"), "y": share})
    outer = F.when(F.col("zone") == "header", F.col("y") >= F.col("low")).otherwise(F.col("y") <= F.col("high"))
    rest = rest.join(cut, ["doc_id", "zone"]).where(outer).join(forms.select("doc_id", "zone", "form"), ["doc_id", "zone"])
    return rest.where((F.col("own") == F.col("form")) | closer(F.col("own"), F.col("form"), 2)).select(*KEY, "zone").distinct()


def furniture(blocks_: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page, column, block, zone`` of running headers and footers.

    ``blocks_(doc_id, page, column, block, left, top, bottom, n_lines, text)``, ``pages(doc_id, page, height)``.
    A document of one page has none.
    """
    candidates = edge_candidates(blocks_, pages)
    found = matched(candidates)
    return found.unionByName(recurring(candidates, found)).distinct()
