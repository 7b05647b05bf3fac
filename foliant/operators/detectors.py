"""Heading detectors that compete for a block, and a filter that looks at the series on a page and in a document.

A detector reads a form at the start of a block (a number, a Roman number, a letter, a chapter's label,
a fixed name) and says what proof of style it needs; a block without a form needs a stronger
proof. Detectors are columns in order of precedence; the filter is windows over what they found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

#: The gates of a heading, in lines, characters, and shares of the page's height.
MOST_LINES, PLAIN_LINES, MOST_CHARS, TOP_STRIP = 4, 2, 200, 0.05
#: Points by which a heading's size passes the body's, from a strong proof to a weak one.
STRONG, LARGE, SLIGHT = 2.0, 1.5, 0.5
#: A page of so many candidates has none, and one of so many single numbers has a list.
CROWDED, LISTED, PAGE_FACTOR = 20, 5, 3
ROMAN = r"(?=[IVXivx])(?:X{0,3}(?:IX|IV|V?I{0,3})|x{0,3}(?:ix|iv|v?i{0,3}))"
CJK_NUMERAL = "一二三四五六七八九十"


@dataclass(frozen=True)
class Detector:
    """A form at a block's start; its groups hold the mark that numbers it."""

    kind: str
    pattern: str
    #: How much of a proof of style it needs: 2 as much as a plain heading, 1 any, 0 none.
    proof: int


#: In order of precedence.
DETECTORS = [
    Detector("chapter", r"(?i)^(?:chapter|part)\s+([0-9]{1,3}|[IVXivx]{1,6})\b|^第\s*([0-9]{1,3}|[一二三四五六七八九十]{1,4})\s*[章部篇]", 0),
    Detector("appendix", r"(?i)^(?:appendix|annex)\s+([A-Z]|[0-9]{1,2}|[IVX]{1,5})\b|^附录\s*([A-Z0-9一二三四五六七八九十]{1,3})", 0),
    Detector("abstract", r"(?i)^(?:abstract|summary|executive summary|摘要)\s*[:.：—-]?\s*$", 0),
    Detector("introduction", r"(?i)^(?:introduction|引言|前言)\s*$", 0),
    Detector("references", r"(?i)^(?:references|bibliography|works cited|literature|参考文献)\s*$", 0),
    Detector("keyword", r"(?i)^(?:key\s?words|acknowledge?ments?|conclusions?|glossary|index|preface|foreword|contents|关键词|致谢|结论)\s*[:：]?\s*$", 1),
    Detector("labelled", r"(?i)^(?:section|article|schedule|exhibit|item|note)\s+([0-9]{1,3}(?:\.[0-9]{1,2})*|[A-Z]|[IVX]{1,5})\b", 1),
    Detector("numbered", r"^((?:1[0-9]|[1-9])(?:\.(?:1[0-9]|[1-9])){0,3})[.)]?\s+(?=\p{Lu}|\p{Lo}|\p{Lt})", 1),
    Detector("roman", rf"^({ROMAN})[.)]\s+(?=\p{{L}})", 1),
    Detector("cjk", rf"^([{CJK_NUMERAL}]{{1,3}})\s*[、．.]|^[（(]\s*([{CJK_NUMERAL}]{{1,3}})\s*[)）]", 1),
    Detector("letter", r"^\(?([A-Za-z])[.)]\s+(?=\p{L})", 1),
]


def _mark(d: Detector) -> Column:
    """The number or letter that a form carries; empty for none."""
    groups = re.compile(re.sub(r"\\[pP]\{\w+\}", "x", d.pattern)).groups
    found = F.regexp_extract("text", d.pattern, 1) if groups else F.lit("")
    return F.when(found != "", found).otherwise(F.regexp_extract("text", d.pattern, 2)) if groups > 1 else found


def _roman(mark: Column) -> Column:
    """The value of a Roman number under 40."""
    t = F.upper(mark)
    for part, figures in (("IX", "VIIII"), ("IV", "IIII")):
        t = F.replace(t, F.lit(part), F.lit(figures))
    return sum((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) * v for c, v in (("X", 10), ("V", 5), ("I", 1))).cast("int")


def _cjk(mark: Column) -> Column:
    """The value of a Chinese numeral under 100."""
    tens = F.when(~F.contains(mark, F.lit("十")), 0).when(F.startswith(mark, F.lit("十")), 10).otherwise(digit_of(F.substring(mark, 1, 1)) * 10)
    ones = F.when(F.endswith(mark, F.lit("十")), 0).otherwise(digit_of(F.substring(mark, -1, 1)))
    return (tens + ones).cast("int")


def digit_of(sign: Column) -> Column:
    """1 to 10 for a Chinese figure, 0 for another sign."""
    return F.aggregate(F.transform(F.array(*[F.lit(c) for c in CJK_NUMERAL]), lambda c, i: F.when(c == sign, i + 1).otherwise(0)), F.lit(0), lambda a, x: a + x)


def numbers_of(kind: Column, mark: Column) -> Column:
    """The figures of a mark, outermost first: ``2.1`` as [2, 1], ``iv`` as [4], ``C`` as [3]; empty for none."""
    figures = F.transform(F.split(mark, r"\."), lambda x: x.cast("int"))
    one = F.when(mark.rlike("^[0-9]"), figures).when(mark.rlike(f"^[{CJK_NUMERAL}]"), F.array(_cjk(mark)))
    roman = (kind != "letter") & mark.rlike("^(?:[IVX]+|[ivx]+)$") & ~((kind == "appendix") & (F.length(mark) == 1) & ~mark.isin("I"))
    one = one.when(roman, F.array(_roman(mark))).when(F.length(mark) == 1, F.array(F.ascii(F.upper(mark)) - 64))
    return F.coalesce(F.when(mark != "", one), F.array().cast("array<int>"))


def candidates(blocks_: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``blocks_`` that may be headings, with ``kind``, ``numbers``, ``depth``, ``proof`` (3 strong to 0 none), ``capitals`` and ``opens_page``.

    ``blocks_(doc_id, page, column, block, left, right, top, bottom, n_lines, text, font_size, bold)``, ``pages(doc_id,
    page, width, height)``, ``documents(doc_id, body_size, body_bold)``. A block passes the gates of any
    heading first, then takes the first detector whose need of proof it meets; a plain heading needs a strong proof.
    """
    rows = blocks_.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).join(documents.select("doc_id", "body_size", "body_bold"), "doc_id")
    order = Window.partitionBy("doc_id", "page", "column").orderBy(F.desc("top"), "left")
    pitch = F.greatest("body_size", F.lit(1.0))
    above = F.coalesce((F.lag("bottom").over(order) - F.col("top")) / pitch, F.lit(9.0))
    below = F.coalesce((F.col("bottom") - F.lead("top").over(order)) / pitch, F.lit(9.0))
    rows = rows.withColumns({"above": above, "below": below, "gain": F.col("font_size") - F.col("body_size"), "opens_page": F.col("top") >= F.max("top").over(Window.partitionBy("doc_id", "page"))})
    n = F.length("text")
    placed = (F.col("n_lines") <= MOST_LINES) & (n < MOST_CHARS) & (F.col("bottom") <= (1 - TOP_STRIP) * F.col("height")) & (F.col("left") <= 0.8 * F.col("width"))
    rows = rows.where(placed)  # long texts are not looked into
    letters, upper = F.length(F.regexp_replace("text", r"\P{L}+", "")), F.length(F.regexp_replace("text", r"\P{Lu}+", ""))
    rows = rows.withColumn("_letters", letters).withColumn("capitals", (F.col("_letters") >= 3) & (upper >= 0.7 * F.col("_letters")))

    strong_style = F.col("capitals") | (F.col("gain") >= LARGE)
    gates = (
        (F.col("n_lines") <= F.when(strong_style, MOST_LINES).otherwise(PLAIN_LINES)) & (F.col("_letters") > 0)
        & ~F.col("text").rlike(r"(?:\.\s*){4,}[0-9]*\s*$|(?i)^(?:fig(?:ure)?|table|chart|图|表)\s*\.?\s*[0-9]") & ~F.col("text").rlike(r"[,;]\s*$")
    )
    centred = (F.abs((F.col("left") + F.col("right") - F.col("width")) / 2) < 0.03 * F.col("width")) & (F.col("right") - F.col("left") < 0.6 * F.col("width"))
    heavy = (F.col("bold") > 0.5) & ~F.col("body_bold")
    free = (F.col("above") >= 0.8) & (F.col("above") >= F.col("below"))
    proof = (
        F.when((F.col("gain") >= STRONG) | ((F.col("gain") >= LARGE) & (heavy | free)), 3)
        .when((F.col("gain") >= SLIGHT) & (heavy | free), 3).when(heavy & free & (F.col("n_lines") == 1), 2).when(F.col("capitals") & free & (n <= 80), 2)
        .when((F.col("gain") >= SLIGHT) | heavy | (centred & free) | (F.col("above") >= 1.5), 1).otherwise(0)
    )
    rows = rows.where(gates).withColumn("proof", F.when(F.col("gain") < -SLIGHT, F.least(proof, F.lit(1))).otherwise(proof))
    found = F.array(*[F.when(F.col("text").rlike(d.pattern) & (F.col("proof") >= d.proof), F.struct(F.lit(d.kind).alias("kind"), _mark(d).alias("mark"))) for d in DETECTORS])
    plain = F.when((F.col("proof") >= 2) & ~F.col("text").rlike(r"[.!?。！？]\s*$"), F.struct(F.lit("plain").alias("kind"), F.lit("").alias("mark")))
    best = F.coalesce(F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1)), plain)
    rows = rows.withColumn("_best", F.explode(F.filter(F.array(best), lambda x: x.isNotNull()))).withColumns({"kind": F.col("_best.kind"), "numbers": numbers_of(F.col("_best.kind"), F.col("_best.mark"))})
    depth = F.when(F.col("kind").isin("numbered", "labelled"), F.greatest(F.size("numbers"), F.lit(1))).when(F.col("kind") == "plain", 0).otherwise(1)
    return rows.withColumn("depth", depth).drop("_best", "_letters", "width", "height", "body_size", "body_bold", "above", "below")


def filtered(found: DataFrame) -> DataFrame:
    """``candidates`` without what their series speaks against.

    A page of ``CROWDED`` or more has none. ``LISTED`` or more single numbers on a page are a list. A series of
    Roman numbers or letters begins with the first and goes on by one. A first number is at most
    ``PAGE_FACTOR`` times its page.
    """
    page = Window.partitionBy("doc_id", "page")
    single = ((F.col("kind") == "numbered") & (F.size("numbers") == 1)).cast("int")
    rows = found.withColumns({"_n": F.count("*").over(page), "_listed": F.sum(single).over(page), "_single": single}).where(F.col("_n") < CROWDED)
    rows = rows.where((F.col("_single") == 0) | (F.col("_listed") < LISTED))
    first = F.try_element_at("numbers", F.lit(1))
    rows = rows.where((F.col("kind") != "numbered") | (first <= PAGE_FACTOR * F.col("page")))
    series = Window.partitionBy("doc_id", "kind").orderBy("page", "column", F.desc("top"), "left")
    # A run is numbered from 1 without a gap: the place where it would have begun is the same for all of it.
    begun = rows.withColumn("_first", first).withColumn("_run", F.sum((F.col("_first") == 1).cast("int")).over(series))
    run = Window.partitionBy("doc_id", "kind", "_run").orderBy("page", "column", F.desc("top"), "left")
    broken = F.when(F.col("_first") != F.row_number().over(run), 1).otherwise(0)
    begun = begun.withColumn("_broken", F.sum(broken).over(run))
    kept = ~F.col("kind").isin("roman", "letter", "cjk") | ((F.col("_run") > 0) & (F.col("_broken") == 0))
    return begun.where(kept).drop("_n", "_listed", "_single", "_first", "_run", "_broken")


def headings(blocks_: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``candidates`` that ``filtered`` keeps."""
    return filtered(candidates(blocks_, pages, documents))
