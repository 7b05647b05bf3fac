"""An outline from a document's headings: styles in clusters, ranks of what may share a level, a stack, a gate.

Headings of one size (about), weight and case are a style. Two kinds of headings (a form at a style)
may share a level if their forms do not say otherwise and their styles are close; a level is a clique of
such kinds, the largest first. Levels are put in order by a comparator (forms first, then size,
weight and case), and headings are hung by a stack that is popped until the comparator says deeper.
Headings whose numbers go back, jump or repeat, or whose style fits none of their kind, are refused.

Style clusters and refusals are windows; cliques and the stack take a document's headings, which are
few, as arrays in Arrow batches of documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Points between sizes of one style, and between those of what may share a level.
CLOSE, SHARED = 0.9, 0.5
#: Forms from the outermost; kinds that are not here have no form, and their style decides.
OUTER = {"chapter": 0, "appendix": 0, "abstract": 0, "introduction": 0, "references": 0}


def styled(headings: DataFrame) -> DataFrame:
    """``headings`` with ``style``: a number for sizes that lie ``CLOSE`` to each other, of one weight and case, the largest first."""
    heavy, case = (F.col("bold") > 0.5).cast("int"), F.col("capitals").cast("int")
    rows = headings.withColumns({"_b": heavy, "_c": case})
    order = Window.partitionBy("doc_id", "_b", "_c").orderBy(F.desc("font_size"), "page", "block")
    step = F.coalesce((F.lag("font_size").over(order) - F.col("font_size") > CLOSE).cast("int"), F.lit(0))
    rows = rows.withColumn("_step", step).withColumn("_s", F.sum("_step").over(order))
    size = Window.partitionBy("doc_id", "_b", "_c", "_s")
    rows = rows.withColumn("style_size", F.round(F.avg("font_size").over(size), 2))
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("style_size"), F.desc("_b"), F.desc("_c"), "_s"))
    return rows.withColumn("style", rank).drop("_b", "_c", "_step", "_s")


def accepted(headings: DataFrame) -> DataFrame:
    """``headings`` (``styled``) that are not refused.

    Of a numbered or labelled kind those within ``CLOSE`` of the kind's commonest style at their depth stay, of
    one mark the first; a number goes on from the one before it at its depth under the same outer numbers, or
    begins with 1 (a document's first may begin anywhere). A plain heading that repeats a chapter's title goes.
    """
    formed = F.col("kind").isin("numbered", "labelled", "chapter", "appendix") & (F.size("numbers") > 0)
    votes = headings.where(formed).groupBy("doc_id", "kind", "depth", "style_size").agg(F.count("*").alias("n"))
    first = Window.partitionBy("doc_id", "kind", "depth").orderBy(F.desc("n"), F.desc("style_size"))
    usual = votes.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", "kind", "depth", F.col("style_size").alias("usual"))
    rows = headings.join(usual, ["doc_id", "kind", "depth"], "left").where(F.col("usual").isNull() | (F.abs(F.col("style_size") - F.col("usual")) <= CLOSE)).drop("usual")

    place = ["page", "column", F.desc("top"), "left"]
    outer, last = F.slice("numbers", 1, F.greatest(F.size("numbers") - 1, F.lit(0))), F.try_element_at("numbers", F.lit(-1))
    rows = rows.withColumns({"_formed": formed, "_mark": F.when(formed, F.concat_ws(".", F.col("numbers").cast("array<string>"))), "_outer": F.concat_ws(".", outer.cast("array<string>")), "_last": last})
    again = F.row_number().over(Window.partitionBy("doc_id", "kind", "_mark").orderBy(*place))
    rows = rows.withColumn("_again", again).where(~F.col("_formed") | (F.col("_again") == 1))
    series = Window.partitionBy("doc_id", "kind", "depth", "_outer").orderBy(*place)
    before = F.max(F.when(F.col("_formed"), F.col("_last"))).over(series.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.when(before.isNull(), (F.col("_last") == 1) | (F.col("depth") == 1)).otherwise((F.col("_last") > before) & (F.col("_last") <= before + 2))  # one may have been missed
    rows = rows.withColumn("_on", F.coalesce(goes_on, F.lit(True))).where(~F.col("_formed") | F.col("_on"))

    bare = F.lower(F.regexp_replace(F.regexp_replace("text", r"(?i)^(?:chapter|part)?\s*[0-9IVXivx.]*[.):：]?\s*", ""), r"\s+", " "))
    rows = rows.withColumn("_bare", bare)
    titles = rows.where((F.col("kind") == "chapter") & (F.col("_bare") != "")).select("doc_id", "_bare", F.lit(True).alias("_chapter")).distinct()
    rows = rows.join(titles, ["doc_id", "_bare"], "left").where((F.col("kind") != "plain") | F.col("_chapter").isNull())
    return rows.drop("_formed", "_mark", "_outer", "_last", "_again", "_on", "_bare", "_chapter")


@dataclass(frozen=True)
class Kind:
    """What headings have in common that stand for one thing: a form and its depth, and a style."""

    form: str
    depth: int
    style: int
    size: float
    bold: bool
    capitals: bool

    def may_share(self, other: Kind) -> bool:
        """Whether headings of both kinds can be of one level."""
        if self.depth and other.depth:  # both are numbered or named
            same = self.depth == other.depth and (self.form in OUTER) == (other.form in OUTER)
            return same and (self.form == other.form or self.near(other))
        return self.near(other) and self.bold == other.bold and self.capitals == other.capitals

    def near(self, other: Kind) -> bool:
        return abs(self.size - other.size) <= SHARED


def compared(a: Kind, b: Kind) -> int:
    """Below 0 if ``a`` is outside of ``b``. Numbers decide between themselves, outer forms before others of about a size, else the style."""
    if a.depth and b.depth and a.depth != b.depth and a.form == b.form:
        return a.depth - b.depth
    if not a.near(b):
        return -1 if a.size > b.size else 1
    ranks = [(0 if k.form in OUTER else 1, k.depth, not k.bold, not k.capitals, k.style) for k in (a, b)]
    return (ranks[0] > ranks[1]) - (ranks[0] < ranks[1])


def cliques(kinds: dict[Kind, int]) -> list[list[Kind]]:
    """Kinds in cliques of those that may share a level; the commonest that is left begins one, and takes in what fits all of it."""
    left = sorted(kinds, key=lambda k: (-kinds[k], k.style, k.depth, k.form))
    out = []
    while left:
        one = [left.pop(0)]
        for k in list(left):
            if all(k.may_share(x) for x in one):
                one.append(k)
                left.remove(k)
        out.append(one)
    return out


def levels(kinds: dict[Kind, int]) -> dict[Kind, int]:
    """A rank for each kind, equal ones for a clique, the outermost first."""
    ordered = sorted(cliques(kinds), key=cmp_to_key(lambda a, b: compared(a[0], b[0])))
    return {k: rank for rank, one in enumerate(ordered) for k in one}


def placed(kinds: list[Kind], numbers: list[tuple], pages: list[int], opens: list[bool], last: int) -> tuple[list[int | None], list[int], list[int]]:
    """``parent, depth, end`` of each of one document's headings, in reading order."""
    rank = levels(Counter(kinds))
    stack: list[int] = []
    parent: list[int | None] = []
    depth: list[int] = []
    for i in range(len(kinds)):
        while stack and not _deeper(i, stack[-1], kinds, numbers, rank):
            stack.pop()
        parent.append(stack[-1] if stack else None)
        depth.append(len(stack) + 1)
        stack.append(i)
    # A node ends where the next one begins; then holders take in what hangs under them.
    end = [max(page, after - 1 if opened else after) for page, after, opened in zip(pages, pages[1:], opens[1:])] + [max(pages[-1], last)]
    for i in reversed(range(len(kinds))):
        if parent[i] is not None:
            end[parent[i]] = max(end[parent[i]], end[i])
    return parent, depth, end


@F.pandas_udf(StructType([StructField(c, ArrayType(IntegerType())) for c in ("parent", "depth", "end")]))
def _placed(kind: pd.Series, depth: pd.Series, style: pd.Series, size: pd.Series, bold: pd.Series, capitals: pd.Series, numbers: pd.Series, pages: pd.Series, opens: pd.Series, last: pd.Series) -> pd.DataFrame:
    out = []
    for k, d, s, z, b, c, n, p, o, end in zip(kind, depth, style, size, bold, capitals, numbers, pages, opens, last):
        kinds = [Kind(form if level else "plain", int(level), int(st), float(points), bool(heavy), bool(caps)) for form, level, st, points, heavy, caps in zip(k, d, s, z, b, c)]
        out.append(placed(kinds, [tuple(x) for x in n], [int(x) for x in p], [bool(x) for x in o], int(end)))
    return pd.DataFrame(out, columns=["parent", "depth", "end"])


def _deeper(i: int, holder: int, kinds: list[Kind], numbers: list[tuple], rank: dict[Kind, int]) -> bool:
    """Whether heading ``i`` hangs below ``holder``: numbers that go on from its own do, and else the levels say."""
    a, b = kinds[i], kinds[holder]
    if a.form == b.form and a.depth and b.depth:
        return len(numbers[i]) > len(numbers[holder]) and numbers[i][: len(numbers[holder])] == numbers[holder] if a.depth != b.depth else False
    return rank[a] > rank[b]


def assembled(headings: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``doc_id, ord, parent_ord, depth, title, page, end``: the outline of each document, in reading order.

    ``headings`` are those of ``detectors.headings``, ``page_counts(doc_id, pages)``. A node ends before the
    page that the next one opens, or on the page where that one begins further down; a holder's pages
    take in all below it. A document without headings has no rows.
    """
    fit = accepted(styled(headings)).join(page_counts.select("doc_id", "pages"), "doc_id")
    rows = fit.withColumn("opens", F.col("opens_page") & (F.col("column") == 0))
    heading = F.struct("page", "column", (-F.col("top")).alias("y"), "left", "block", "text", "kind", "numbers", "depth", "style", "style_size", (F.col("bold") > 0.5).alias("heavy"), "capitals", "opens")
    one = rows.groupBy("doc_id", "pages").agg(F.array_sort(F.collect_list(heading)).alias("h"))
    of = lambda c: F.transform("h", lambda x: x[c])
    one = one.withColumn("n", _placed(of("kind"), of("depth"), of("style"), of("style_size"), of("heavy"), of("capitals"), of("numbers"), of("page"), of("opens"), F.col("pages")))
    each = one.select("doc_id", F.posexplode(F.arrays_zip("h", "n.parent", "n.depth", "n.end")).alias("ord", "x"))
    return each.select("doc_id", "ord", F.col("x.parent").alias("parent_ord"), F.col("x.depth").alias("depth"), F.col("x.h.text").alias("title"), F.col("x.h.page").alias("page"), F.col("x.end").alias("end"))


def valid(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``doc_id, valid``: whether an outline may stand for its document.

    Three top nodes at least; five are enough, fewer must leave no gap of over half the pages before, between or after them.
    """
    top = nodes.where("depth = 1").select("doc_id", "page").join(page_counts.select("doc_id", "pages"), "doc_id")
    before = F.coalesce(F.lag("page").over(Window.partitionBy("doc_id").orderBy("page")), F.lit(1))
    facts = top.withColumn("gap", F.col("page") - before).groupBy("doc_id", "pages").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.max("page").alias("last"))
    widest = F.greatest(F.col("gap"), F.col("pages") - F.col("last"))
    good = (F.col("n") >= 5) | ((F.col("n") >= 3) & (2 * widest <= F.col("pages")))
    return page_counts.select("doc_id").join(facts.select("doc_id", good.alias("valid")), "doc_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def outline(headings: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``assembled`` outlines that are ``valid``."""
    nodes = assembled(headings, page_counts)
    return nodes.join(valid(nodes, page_counts).where("valid").select("doc_id"), "doc_id", "left_semi")
