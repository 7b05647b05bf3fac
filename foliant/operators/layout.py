"""Layout: positioned spans to lines, columns, blocks, furniture, headings and an outline.

Input is ``spans(doc_id, page, left, right, top, bottom, text, font, font_size, bold)`` with y
growing upwards, as PDF readers give it; decoding files is left to a reader (``sources``).
Rules that need neighbours within a page are windows over its spans or lines; rules that need
one block and statistics of its page or document are predicates. Columns, running headers and footers,
heading detectors and the assembly of outlines are in ``gutters``, ``furniture``, ``detectors`` and
``assembly``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from foliant.functions.text import script_of
from foliant.operators.furniture import furniture
from foliant.operators.gutters import columns
from foliant.operators.statistics import weighted_percentile

__all__ = ["columns", "furniture"]


def lines(spans: DataFrame) -> DataFrame:
    """``line`` numbers for spans: a span goes on with a line if its centre is inside and the gap is small."""
    height = F.col("top") - F.col("bottom")
    centre = (F.col("top") + F.col("bottom")) / 2
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("_row"), "left")
    rows = spans.withColumn("_row", F.round(centre / F.greatest(F.expr("percentile(top - bottom, 0.5) over (partition by doc_id, page)"), F.lit(1.0)), 0))
    width = (F.col("right") - F.col("left")) / F.greatest(F.length("text"), F.lit(1))
    reach = F.least(F.greatest(width, F.lit(0.1)), F.lit(5.0))
    prev = lambda c: F.lag(c).over(order)
    ends_sentence = prev("text").rlike(r"[.!?。！？]\s*$")
    back = F.when(ends_sentence, 4 * reach).otherwise(2 * reach)
    inside = (prev("_row") == F.col("_row")) & (F.col("left") >= prev("right") - back) & (F.col("left") <= prev("right") + reach + F.least(height, F.lit(5.0)))
    begins = F.when(F.coalesce(inside, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_b", begins).withColumn("line", F.sum("_b").over(order)).drop("_b", "_row")


def text_lines(spans: DataFrame) -> DataFrame:
    """One row for each line: box, text, size, share of bold characters."""
    n = F.length("text")
    one = lines(spans).groupBy("doc_id", "page", "line").agg(
        F.min("left").alias("left"), F.max("right").alias("right"), F.max("top").alias("top"), F.min("bottom").alias("bottom"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda s: s["text"]), " ").alias("text"),
        (F.sum(F.col("font_size") * n) / F.greatest(F.sum(n), F.lit(1))).alias("font_size"), (F.sum(F.when(F.col("bold"), n).otherwise(0)) / F.greatest(F.sum(n), F.lit(1))).alias("bold"),
    )
    return one.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


def blocks(lines_: DataFrame) -> DataFrame:
    """Lines joined to blocks: same column, like size and weight, close below each other."""
    order = Window.partitionBy("doc_id", "page", "column").orderBy(F.desc("top"), "left")
    prev = lambda c: F.lag(c).over(order)
    gap = prev("bottom") - F.col("top")
    alike = (F.abs(prev("font_size") - F.col("font_size")) <= 1) & ((prev("bold") > 0.5) == (F.col("bold") > 0.5))
    near = gap <= 0.65 * F.greatest("font_size", prev("font_size"))
    begins = F.when(F.coalesce(alike & near, F.lit(False)), 0).otherwise(1)
    rows = lines_.withColumn("_b", begins).withColumn("block", F.sum("_b").over(order))
    return rows.groupBy("doc_id", "page", "column", "block").agg(
        F.min("left").alias("left"), F.max("right").alias("right"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("y"), "left", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.avg("font_size").alias("font_size"), F.avg("bold").alias("bold"),
    )


def reading_order(blocks_: DataFrame) -> DataFrame:
    """``ord`` of blocks on a page: columns from the left, from the top down."""
    return blocks_.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("column", F.desc("top"), "left")))


def without_line_numbers(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines without margin numbers: integers in the left 15 % that rise by one on five lines or more."""
    joined = lines_.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"])
    n = F.when((F.col("right") <= 0.15 * F.col("width")) & F.col("text").rlike("^[0-9]{1,4}$"), F.col("text").cast("int"))
    numbered = joined.withColumn("n", n)
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.col("n").isNull(), F.desc("top")))
    numbered = numbered.withColumn("run", F.when(F.col("n").isNotNull(), F.col("n") - rank))
    size = F.count("*").over(Window.partitionBy("doc_id", "page", "run"))
    return numbered.withColumn("size", size).where(F.col("run").isNull() | (F.col("size") < 5)).drop("n", "run", "size", "width")


def page_statistics(lines_: DataFrame) -> DataFrame:
    """``doc_id, page, body_size, p80_size, characters``: sizes weighted by characters."""
    rows = lines_.withColumn("n", F.length("text").cast("double"))
    body = weighted_percentile(rows, ["doc_id", "page"], "font_size", "n", 0.5).withColumnRenamed("percentile", "body_size")
    high = weighted_percentile(rows, ["doc_id", "page"], "font_size", "n", 0.8).withColumnRenamed("percentile", "p80_size")
    return body.join(high, ["doc_id", "page"]).join(rows.groupBy("doc_id", "page").agg(F.sum("n").cast("long").alias("characters")), ["doc_id", "page"])


def watermarks(blocks_: DataFrame) -> DataFrame:
    """Rotated blocks of five letters or more whose text stands on three pages or more."""
    rows = blocks_.where((F.col("rotation") != 0) & (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) >= 5))
    often = rows.groupBy("doc_id", "text").agg(F.count_distinct("page").alias("n")).where("n >= 3")
    return rows.join(often.select("doc_id", "text"), ["doc_id", "text"], "left_semi")


def contents_pages(lines_: DataFrame) -> DataFrame:
    """``doc_id, page``: five lines or more with dot leaders (three after such a page), or ten rising page numbers."""
    dots = F.col("text").rlike(r"(?:\.\s*){4,}[0-9]+\s*$")
    last = F.try_to_number(F.regexp_extract("text", r"([0-9]{1,4})\s*$", 1), F.lit("9999"))
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("top"))
    rows = lines_.withColumns({"dots": dots.cast("int"), "n": last}).withColumn("up", (F.col("n") >= F.lag("n").over(order)).cast("int"))
    facts = rows.groupBy("doc_id", "page").agg(F.sum("dots").alias("dots"), F.sum("up").alias("up"))
    before = F.lag("dots").over(Window.partitionBy("doc_id").orderBy("page"))
    return facts.withColumn("before", before).where((F.col("dots") >= 5) | ((F.col("dots") >= 3) & (F.col("before") >= 3)) | (F.col("up") >= 10)).select("doc_id", "page")


def body_paragraphs(blocks_: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks that are body text: long, wide, of letters, not much smaller than the body."""
    rows = blocks_.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).join(documents.select("doc_id", "body_size"), "doc_id")
    n = F.length("text")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.greatest(n, F.lit(1))
    long = (n >= 250) & (F.col("n_lines") >= 4)
    plain = (n / F.col("n_lines") >= 15) & (F.col("right") - F.col("left") >= F.col("width") / 7) & (n >= 40) & (letters >= 0.1) & (F.col("font_size") >= F.col("body_size") - 2)
    return rows.where(long | plain).drop("width", "body_size")


def heading_candidates(blocks_: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks of a heading's shape, with ``numbering`` (figures of its number, 0 for none)."""
    rows = blocks_.join(documents.select("doc_id", "body_size", "body_bold"), "doc_id")
    n, gain = F.length("text"), F.col("font_size") / F.greatest("body_size", F.lit(0.001))
    mark = F.regexp_extract("text", r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})[.)]?\s+\p{L}", 1)
    numbering = F.when(mark == "", 0).otherwise(F.size(F.split(mark, r"\.")))
    capitals = F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) >= 0.7 * F.greatest(F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.lit(1))
    shape = n.between(2, 200) & (F.col("n_lines") <= 6) & ~F.col("text").rlike(r"(?:\.\s*){4,}$|^(?i:fig(?:ure)?|table|chart)\s*\.?\s*[0-9]") & F.col("text").rlike(r"\p{L}")
    proof = (gain >= 1.08) | ((F.col("bold") > 0.5) & ~F.col("body_bold") & (gain >= 0.95)) | ((numbering > 0) & (n <= 120) & ((F.col("bold") > 0.3) | (gain >= 1))) | (capitals & (n <= 80) & (gain >= 1))
    return rows.withColumn("numbering", numbering).where(shape & proof)


def outline(headings: DataFrame) -> DataFrame:
    """Levels by the rank of (size, weight) among a document's headings, six at most; a number's depth can lower one."""
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("s"), F.desc("b")))
    rows = headings.withColumns({"s": F.round("font_size", 1), "b": F.col("bold") > 0.5}).withColumn("style", F.least(rank, F.lit(6)))
    level = F.when(F.col("numbering") > 0, F.greatest(F.col("style"), F.col("numbering"))).otherwise(F.col("style"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "column", F.desc("top")))
    return rows.withColumns({"level": F.least(level, F.lit(6)), "ord": ord_}).drop("s", "b", "style")


def title(blocks_: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, title``: on the first two pages the best of size, length, width and height on the page."""
    rows = blocks_.where("page <= 2").join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).join(documents.select("doc_id", "body_size"), "doc_id")
    n = F.length("text")
    score = (F.col("font_size") / F.greatest("body_size", F.lit(1.0))) ** 2 * F.least(n / 20, F.lit(1.0)) * F.when(n > 250, 0.2).otherwise(1.0)
    score = score * F.pow((F.col("right") - F.col("left")) / F.col("width"), 0.5) * (0.5 + 0.5 * F.col("top") / F.col("height")) / F.col("page")
    score = score * F.when(F.col("text").rlike(r"\S@\S"), 0.1).otherwise(1.0) * F.when(F.col("text").rlike("(?i)^title:"), 3.0).otherwise(1.0)
    return rows.withColumn("score", score).groupBy("doc_id").agg(F.max_by("text", F.struct("score", -F.col("page"), "top")).alias("title"))


def captions(blocks_: DataFrame) -> DataFrame:
    """``kind, number`` of blocks that label a figure, table or chart; the first of each label."""
    kind = F.lower(F.regexp_extract("text", r"(?i)^\s*(fig(?:ure)?|table|chart|exhibit|图|表)", 1))
    number = F.regexp_extract("text", r"(?i)^\s*(?:fig(?:ure)?|table|chart|exhibit|图|表)\s*\.?\s*([0-9]+(?:[.-][0-9]+)*|[IVX]+)", 1)
    rows = blocks_.withColumns({"kind": F.when(kind.isin("fig", "图"), "figure").when(kind == "表", "table").otherwise(kind), "number": number}).where("kind != '' and number != ''")
    first = F.row_number().over(Window.partitionBy("doc_id", "kind", "number").orderBy("page", F.desc("top")))
    return rows.withColumn("r", first).where("r = 1").drop("r")


def outline_is_valid(headings: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``doc_id, valid``: three top headings, and five or no gap of over half the pages."""
    top = headings.where("level = 1").select("doc_id", "page").join(page_counts.select("doc_id", "pages"), "doc_id")
    gap = F.col("page") - F.coalesce(F.lag("page").over(Window.partitionBy("doc_id").orderBy("page")), F.lit(1))
    facts = top.withColumn("gap", gap).groupBy("doc_id", "pages").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.max("page").alias("last"))
    widest = F.greatest("gap", F.col("pages") - F.col("last"))
    return facts.select("doc_id", ((F.col("n") >= 5) | ((F.col("n") >= 3) & (widest <= 0.5 * F.col("pages")))).alias("valid"))


def document_statistics(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """A row of facts for each document of ``pages(doc_id, page, width, height)``.

    ``pages, landscape`` (pages wider than high), ``width, height`` (medians), ``line_width, line_left`` (medians over lines),
    ``body_size, p80_size`` (by characters) and ``script`` (the family that most of its lines are in).
    """
    sheets = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum((F.col("width") > F.col("height")).cast("long")).alias("landscape"), F.percentile("width", F.lit(0.5)).alias("width"), F.percentile("height", F.lit(0.5)).alias("height"))
    rows = lines_.withColumns({"n": F.length("text").cast("double"), "script": script_of("text")})
    boxes = rows.groupBy("doc_id").agg(F.percentile(F.col("right") - F.col("left"), F.lit(0.5)).alias("line_width"), F.percentile("left", F.lit(0.5)).alias("line_left"))
    body = weighted_percentile(rows, ["doc_id"], "font_size", "n", 0.5).withColumnRenamed("percentile", "body_size")
    high = weighted_percentile(rows, ["doc_id"], "font_size", "n", 0.8).withColumnRenamed("percentile", "p80_size")
    most = rows.where("script is not null").groupBy("doc_id", "script").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("script", F.struct("n", "script")).alias("script"))
    for more in (boxes, body, high, most):
        sheets = sheets.join(more, "doc_id", "left")
    return sheets
