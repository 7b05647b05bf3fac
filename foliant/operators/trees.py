"""Heading trees as tables: a row for each node, in document order.

``nodes(doc_id, ord, node_id, parent_id, depth, title, start, end)``: ``ord`` counts from 0 in
preorder, ``depth`` from 1, ranges are pages and include both ends; a parent's range covers
its subtree. A document's headings fit in a row, so folds over them are arrays in the JVM;
everything across documents is a join or a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from foliant.functions.arrays import scan
from foliant.functions.text import col, title_key

ROUTING_COST = 1
TITLE_CHARS = 200
LEAF_PAGES, CHUNK_PAGES = 20, 10
NODES_PER_PAGE, FAKE_SHARE, FLAT_PAGES = 3, 0.25, 10
BOLD = 9
HEADINGS = "array<struct<line:int,level:int,title:string>>"
#: Figures, periods, units and column heads that make no title.
PERIOD = r"(?:[12]H|H[12]|FY|Q[1-4]|[1-4]Q)\s?'?[0-9]{2,4}"
FIGURE = r"[+\-−–]?\(?(?:US|HK|S|A|NT|RMB|USD|HKD)?[$¥€£]?[0-9][0-9.,]*\)?(?:%|x|bps|pps|ppts|pp|m|mn|bn|b|k|亿|万|百万|千)?(?:元|港元|美元)?"
FAKE = rf"(?i)^(?:{FIGURE}|{PERIOD}|bps|pps|ppts|pp|x|%|US\$|HK\$|RMB|USD|HKD|YoY|CER|HoH|AER|[+\-−–/|·•:])$"
KPI = r"(?i)(?<![A-Za-z])(?:YoY|CER|HoH)\s*[:：]?\s*[+\-−–]?\(?[0-9][0-9.,]*\)?\s*%?\s*$"
#: Numbering styles of headings, the outermost first.
NUMBERING = [r"^[一二三四五六七八九十百]+\s*[、．.]", r"^[0-9]{1,3}(?:\s*[.、．](?![0-9])|\s+)(?!\s*(?:年|月|日|个|%))", r"^[（(]\s*(?:[一二三四五六七八九十]+|[0-9]{1,3}|[A-Za-z])\s*[)）]"]


def headings(lines: DataFrame, bold: bool = True, flat_bold: bool = False) -> DataFrame:
    """``doc_id, last_line, found``: the headings of each document of ``lines(doc_id, line_no, text)``.

    A line that is bold as a whole (of 80 characters at most) counts as level ``BOLD``;
    ``flat_bold``: as level 1, of any length. Fenced code has no headings.
    """
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    fence = F.startswith(bare, F.lit("```"))
    rows = lines.select("doc_id", "line_no", bare.alias("s"), fence.alias("fence"))
    rows = rows.withColumn("fences", F.sum(F.col("fence").cast("int")).over(order)).where("not fence and fences % 2 = 0")
    marks, title = F.length(F.regexp_extract("s", r"^(#{1,6})\s+\S", 1)), F.trim(F.regexp_extract("s", r"^#{1,6}\s+(.*?)\s*#*$", 1))
    strong = F.regexp_extract("s", r"^\*\*([^*].*?)\*\*$", 1)
    is_bold = F.lit(bold) & (F.length(strong) > 0) & (F.lit(flat_bold) | (F.length(strong) <= 80))
    level = F.when(marks > 0, marks).when(is_bold, 1 if flat_bold else BOLD)
    rows = rows.select("doc_id", F.col("line_no").cast("int").alias("line"), level.cast("int").alias("level"), F.when(marks > 0, title).otherwise(F.trim(strong)).alias("title")).where("level is not null")
    found = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "level", "title"))).alias("found"))
    return lines.groupBy("doc_id").agg(F.max("line_no").alias("last_line")).join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast(HEADINGS)))


def heading_nodes(lines: DataFrame, bold: bool = True, flat_bold: bool = False) -> DataFrame:
    """``doc_id, ord, level, depth, title, start, end, parent_ord, path`` (ranges of lines).

    A bold line is one level below the heading before it, and ends before the next heading of
    its level or above; levels of later bold lines are read as from the heading that asks.
    """
    docs = headings(lines, bold, flat_bold)
    of_bold = lambda last: F.when(last > 0, F.least(last + 1, F.lit(6))).otherwise(1)

    def down(done: Column, h: Column) -> tuple[Column, Column]:
        """From the first heading on: what holds it. Titles of the way go with the stack."""
        is_bold = h["level"] == BOLD
        level = F.when(is_bold, of_bold(done["last"])).otherwise(h["level"])
        stack = F.filter(done["stack"], lambda s: s["level"] < level)
        node = F.struct(level.alias("level"), done["ord"].alias("ord"), F.try_element_at(stack, F.lit(-1))["ord"].alias("parent_ord"), F.array_append(F.transform(stack, lambda s: s["title"]), h["title"]).alias("path"))
        pushed = F.array_append(stack, F.struct(level.alias("level"), done["ord"].alias("ord"), h["title"].alias("title")))
        return F.struct(F.when(is_bold, done["last"]).otherwise(h["level"]).alias("last"), (done["ord"] + 1).alias("ord"), pushed.alias("stack")), node

    def up(after: Column, x: Column) -> tuple[Column, Column]:
        """From the last one back: the lines where the nearest later heading of each level, and the nearest bold one, begin."""
        own, level = x["h"], x["n"]["level"]
        bold_too = (own["level"] == BOLD) | (level == 6)  # a bold line is below the heading before it, but no deeper than 6
        nearest = F.array_min(F.concat(F.slice(after, 1, level), F.when(bold_too, F.slice(after, 7, 1)).otherwise(F.slice(after, 1, 0))))
        place = F.when(own["level"] == BOLD, 6).otherwise(own["level"] - 1)
        return F.transform(after, lambda a, i: F.when(i == place, own["line"]).otherwise(a)), F.coalesce(nearest - 1, F.col("last_line")).cast("int")

    node = "struct<level:int,ord:int,parent_ord:int,path:array<string>>"
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("ord"), F.array().cast("array<struct<level:int,ord:int,title:string>>").alias("stack"))
    docs = docs.withColumn("nodes", scan(F.col("found"), start, down, node))
    both = F.reverse(F.zip_with("found", "nodes", lambda h, n: F.struct(h.alias("h"), n.alias("n"))))
    docs = docs.withColumn("ends", F.reverse(scan(both, F.array_repeat(F.lit(None).cast("int"), 7), up, "int")))
    each = docs.select("doc_id", F.explode(F.arrays_zip("found", "nodes", "ends")).alias("x"))
    n = lambda c: F.col(f"x.nodes.{c}").alias(c)
    return each.select("doc_id", n("ord"), n("level"), F.size("x.nodes.path").alias("depth"), F.col("x.found.title").alias("title"), F.col("x.found.line").alias("start"), F.col("x.ends").alias("end"), n("parent_ord"), n("path"))


def with_ids(nodes: DataFrame) -> DataFrame:
    """``node_id`` and ``parent_id``: the preorder number, four figures."""
    return nodes.withColumn("node_id", F.lpad(F.col("ord").cast("string"), 4, "0")).withColumn("parent_id", F.lpad(F.col("parent_ord").cast("string"), 4, "0"))


def page_tree(lines: DataFrame, titles: DataFrame | None = None, bold: bool = True) -> DataFrame:
    """Nodes with page ranges from ``lines(doc_id, line_no, text, page)``.

    Text before the first heading becomes a node "Preface". A document without headings gets
    one node named as ``titles(doc_id, title)`` says and, if it has several pages, one for each.
    """
    nodes = heading_nodes(lines, bold)
    bare = F.trim("text") != ""
    first = nodes.groupBy("doc_id").agg(F.min("start").alias("first"))
    preface = lines.join(first, "doc_id").where((F.col("line_no") < F.col("first")) & bare).groupBy("doc_id").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    inside = lines.select("doc_id", "line_no", "text", "page").alias("l")
    spans = nodes.alias("n").join(inside, "doc_id").where("l.line_no between n.start and n.end").groupBy("doc_id", "ord").agg(
        F.coalesce(F.min(F.when(bare, F.col("page"))), F.min_by("page", "line_no")).alias("start_page"), F.coalesce(F.max(F.when(bare, F.col("page"))), F.min_by("page", "line_no")).alias("end_page"))
    shift = preface.select("doc_id", F.lit(1).alias("shift"))
    headed = nodes.drop("start", "end").join(spans, ["doc_id", "ord"]).join(shift, "doc_id", "left").withColumn("shift", F.coalesce("shift", F.lit(0)))
    headed = headed.select("doc_id", (F.col("ord") + F.col("shift")).alias("ord"), (F.col("parent_ord") + F.col("shift")).alias("parent_ord"), "depth", "title", "path", F.col("start_page").alias("start"), F.col("end_page").alias("end"))
    fronts = preface.select("doc_id", F.lit(0).alias("ord"), F.lit(None).cast("int").alias("parent_ord"), F.lit(1).alias("depth"), F.lit("Preface").alias("title"), F.array(F.lit("Preface")).alias("path"), F.col("start_page").alias("start"), F.col("end_page").alias("end"))
    bare_docs = lines.groupBy("doc_id").agg(F.max("page").alias("pages")).join(first, "doc_id", "left_anti")
    bare_docs = bare_docs.join(titles, "doc_id", "left") if titles is not None else bare_docs.withColumn("title", F.col("doc_id").cast("string"))
    roots = bare_docs.select("doc_id", F.lit(0).alias("ord"), F.lit(None).cast("int").alias("parent_ord"), F.lit(1).alias("depth"), "title", F.array("title").alias("path"), F.lit(1).alias("start"), F.col("pages").alias("end"))
    each = bare_docs.where("pages > 1").select("doc_id", "title", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("p"))
    name = F.concat(F.lit("Page "), F.col("p").cast("string"))
    leaves = each.select("doc_id", F.col("p").alias("ord"), F.lit(0).alias("parent_ord"), F.lit(2).alias("depth"), name.alias("title"), F.array(F.col("title"), name).alias("path"), F.col("p").alias("start"), F.col("p").alias("end"))
    return with_ids(headed.unionByName(fronts).unionByName(roots).unionByName(leaves))


def dotted_tree(items: DataFrame) -> DataFrame:
    """``items(doc_id, code, title, page)`` with ``parent_code`` (null for orphans), ``depth`` and ``end``.

    The item after it ends an item: the page before if ``appear_start`` says that one opens its page.
    """
    parent = F.when(F.contains("code", F.lit(".")), F.regexp_replace("code", r"\.[^.]+$", ""))
    known = items.select("doc_id", F.col("code").alias("parent_code"), F.lit(True).alias("known"))
    order = Window.partitionBy("doc_id").orderBy("page", "code")
    out = items.withColumn("parent_code", parent).join(known, ["doc_id", "parent_code"], "left").withColumn("parent_code", F.when(F.col("known"), F.col("parent_code"))).drop("known")
    opens = F.col("appear_start") if "appear_start" in items.columns else F.lit(True)
    following = F.lead(F.col("page") - F.when(opens, 1).otherwise(0)).over(order)
    return out.withColumn("depth", F.size(F.split("code", r"\."))).withColumn("end", F.greatest(F.coalesce(following, F.col("page")), F.col("page")))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    return nodes.join(nodes.select("doc_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), ["doc_id", "node_id"], "left_anti")


def add_preface(items: DataFrame) -> DataFrame:
    """``items(doc_id, title, page)`` and a Preface on page 1 for documents whose first starts later."""
    late = items.groupBy("doc_id").agg(F.min("page").alias("first")).where("first > 1")
    return items.unionByName(late.select("doc_id", F.lit("Preface").alias("title"), F.lit(1).cast(items.schema["page"].dataType).alias("page")))


def own_text(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id, ord, text``: from a heading to the next of any level; ``nodes`` as of ``heading_nodes``."""
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start"))
    spans = nodes.select("doc_id", "ord", "start", after.alias("stop"))
    inside = (F.col("line_no") >= F.col("start")) & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
    each = spans.join(lines.select("doc_id", "line_no", "text"), "doc_id").where(inside)
    return each.groupBy("doc_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def own_text_at_titles(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, node_id, text`` for trees of page ranges: from a node's title to the title of the next node in order.

    ``pages(doc_id, page, markdown)``. A title is looked for on the first page of its node, whatever white
    space it is set in; one that is not found there counts as standing at the page's head. The last
    node runs to its last page.
    """
    signs = F.filter(F.split(title_key("title"), ""), lambda c: c != "")
    pattern = F.concat(F.lit("(?iu)"), F.array_join(F.transform(signs, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), r"\s*"))
    first = pages.select("doc_id", F.col("page").alias("start"), "markdown")
    found = nodes.select("doc_id", "node_id", "ord", "title", "start", "end").join(first, ["doc_id", "start"], "left")
    at = F.when(F.size(signs) > 0, F.regexp_instr("markdown", pattern))
    found = found.select("doc_id", "node_id", "ord", "start", "end", F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)).alias("at"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    spans = found.withColumns({"stop": F.greatest("start", F.coalesce(F.lead("start").over(order), "end")), "stop_at": F.lead("at").over(order), "next": F.lead("start").over(order)})
    each = spans.select("doc_id", "node_id", "start", "at", "stop", "stop_at", "next", F.explode(F.sequence("start", "stop")).alias("page")).join(pages.select("doc_id", "page", "markdown"), ["doc_id", "page"])
    begin = F.when(F.col("page") == F.col("start"), F.col("at")).otherwise(1)
    until = F.when((F.col("page") == F.col("next")) & F.col("stop_at").isNotNull(), F.col("stop_at")).otherwise(F.length("markdown") + 1)
    piece = F.substr("markdown", begin, F.greatest(until - begin, F.lit(0)))
    each = each.select("doc_id", "node_id", "page", piece.alias("piece")).where("piece != ''")
    text = each.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "piece"))), lambda x: x["piece"]), "\n").alias("text"))
    return nodes.select("doc_id", "node_id").join(text, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce(F.trim("text"), F.lit("")).alias("text"))


def page_thinned(nodes: DataFrame, large: int = 20, least_pages: int = 3) -> DataFrame:
    """Nodes without what lies below a node of one page, or, in a tree of over ``large`` nodes, of fewer than ``least_pages``.

    A node's pages reach to the end of the last node below it. ``nodes`` need ``path_ids``.
    """
    last = nodes.select("doc_id", F.explode("path_ids").alias("node_id"), F.struct("ord", "end").alias("x")).groupBy("doc_id", "node_id").agg(F.max("x")["end"].alias("last"))
    counts = nodes.groupBy("doc_id").agg(F.count("*").alias("n"))
    parents = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    span = F.col("last") - F.col("start") + 1
    thin = nodes.select("doc_id", "node_id", "start").join(parents, ["doc_id", "node_id"]).join(last, ["doc_id", "node_id"]).join(counts, "doc_id")
    thin = thin.where((span == 1) | ((F.col("n") > large) & (span < least_pages))).select("doc_id", F.col("node_id").alias("top"), "last")
    gone = nodes.select("doc_id", "node_id", F.explode("path_ids").alias("top")).where("node_id != top").join(thin, ["doc_id", "top"]).select("doc_id", "node_id").distinct()
    kept = nodes.join(gone, ["doc_id", "node_id"], "left_anti").join(thin.withColumnRenamed("top", "node_id"), ["doc_id", "node_id"], "left")
    return kept.withColumn("end", F.coalesce("last", "end")).drop("last")


def is_fake_title(title: str | Column) -> Column:
    """A heading that is body text: one character, figures and units alone, or a figure card."""
    text = F.trim(F.regexp_replace(F.coalesce(col(title), F.lit("")), r"\s+", " "))
    return (F.length(title_key(text)) <= 1) | text.rlike(KPI) | F.forall(F.split(text, " "), lambda t: t.rlike(FAKE))


def union_name(items: Column, start: Column, end: Column) -> Column:
    """A name for merged siblings: the titles joined, or the pages if that is empty or too long."""
    joined = F.array_join(F.filter(items, lambda t: t != ""), "; ")
    pages = F.when(start == end, F.concat(F.lit("p."), start.cast("string"))).otherwise(F.concat(F.lit("p."), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.when((joined == "") | (F.length(joined) > TITLE_CHARS), pages).otherwise(joined)


def short_union_name(items: Column) -> Column:
    """``A + 2 more``, or in Chinese ``A 等 3 项``; null for fewer than two titles."""
    n = F.size(items)
    chinese = F.array_join(items, "").rlike("[㐀-鿿]")
    return F.when(n >= 2, F.when(chinese, F.concat(items[0], F.lit(" 等 "), n.cast("string"), F.lit(" 项"))).otherwise(F.concat(items[0], F.lit(" + "), (n - 1).cast("string"), F.lit(" more"))))


def split_long_leaves(nodes: DataFrame, most: int = LEAF_PAGES, chunk: int = CHUNK_PAGES) -> DataFrame:
    """Children for leaves of more than ``most`` pages: ``doc_id, node_id, nth, title, start, end``."""
    long = leaves(nodes).where(F.col("end") - F.col("start") + 1 > most)
    each = long.select("doc_id", "node_id", "title", F.col("end").alias("last"), F.posexplode(F.sequence("start", "end", F.lit(chunk))).alias("nth", "start"))
    end = F.least(F.col("start") + chunk - 1, F.col("last"))
    name = F.concat(F.col("title"), F.lit(" (p."), F.col("start").cast("string"), F.lit("–"), end.cast("string"), F.lit(")"))
    return each.select("doc_id", "node_id", "nth", name.alias("title"), "start", end.alias("end"))


def numbering_rank(title: str | Column) -> Column:
    """Numbering style of a heading, 0 outermost; null if it has none."""
    text = F.trim(col(title))
    out = F.when(text.rlike(NUMBERING[0]), 0)
    for rank, pattern in enumerate(NUMBERING[1:], 1):
        out = out.when(text.rlike(pattern), rank)
    return out


def group_by_numbering(siblings: DataFrame) -> DataFrame:
    """``holder_ord`` for each of ``siblings(doc_id, parent_id, ord, title)``: the node it hangs under.

    Where siblings have two styles or more, a numbered one goes under the nearest before it of
    an outer style, an unnumbered one where the node before it went.
    """
    ranked = siblings.withColumn("rank", numbering_rank("title"))
    one = ranked.groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("ord", "rank"))).alias("items"), F.count_distinct("rank").alias("styles"))

    def step(done: Column, x: Column) -> tuple[Column, Column]:
        stack = F.when(x["rank"].isNull(), done["stack"]).otherwise(F.filter(done["stack"], lambda s: s["rank"] < x["rank"]))
        holder = F.when(x["rank"].isNull(), done["holder"]).otherwise(F.try_element_at(stack, F.lit(-1))["ord"])
        pushed = F.when(x["rank"].isNull(), stack).otherwise(F.array_append(stack, x))
        return F.struct(pushed.alias("stack"), holder.alias("holder")), F.struct(x["ord"].alias("ord"), holder.alias("holder_ord"))

    kind = "array<struct<ord:int,rank:int>>"
    one = one.withColumn("items", F.col("items").cast(kind))
    zero = F.struct(F.array().cast(kind).alias("stack"), F.lit(None).cast("int").alias("holder"))
    placed = one.select("doc_id", "parent_id", "styles", F.explode(scan(F.col("items"), zero, step, "struct<ord:int,holder_ord:int>")).alias("x"))
    return placed.select("doc_id", "parent_id", "x.ord", F.when(F.col("styles") >= 2, F.col("x.holder_ord")).alias("holder_ord"))


def flat_top(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``doc_id, top, flat``: whether the top level is too wide and not one node a page."""
    top = nodes.groupBy("doc_id").agg(F.sum((F.col("depth") == 1).cast("int")).alias("top")).join(page_counts, "doc_id")
    flat = (F.col("top") > F.greatest(F.lit(15.0), F.col("pages") / 3)) & (F.col("top") < 0.8 * F.col("pages"))
    return top.select("doc_id", "top", flat.alias("flat"))


def bad_tree_reason(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``doc_id, reason`` (null: a good tree) for ``page_counts(doc_id, pages, toc_source)``."""
    facts = nodes.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(is_fake_title("title").cast("int")).alias("fake"))
    facts = page_counts.join(facts, "doc_id", "left")
    return facts.select("doc_id", _reason().alias("reason"))


def _reason() -> Column:
    """What is wrong with a tree of ``n`` nodes over ``pages``, of which a share is ``fake``; null for nothing."""
    return (
        F.when(F.col("n").isNull(), "no structure").when((F.col("toc_source") == "pages") & (F.col("pages") > FLAT_PAGES), "one node per page")
        .when(F.col("n") > NODES_PER_PAGE * F.greatest("pages", F.lit(1)), "too many nodes").when(F.col("fake") > FAKE_SHARE, "too many fake titles")
    )


def clamped(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Ranges within 1 and the page count; nodes that start past it go."""
    joined = nodes.join(page_counts.select("doc_id", "pages"), "doc_id").where(F.col("start") <= F.col("pages"))
    start = F.greatest("start", F.lit(1))
    return joined.withColumn("start", start).withColumn("end", F.greatest(F.least("end", "pages"), F.col("start"))).drop("pages")


def merge_same_page(nodes: DataFrame) -> DataFrame:
    """Leaves of one parent and equal range as one: ``doc_id, parent_id, start, end, ord, title, key_items``."""
    one = leaves(nodes).groupBy("doc_id", F.col("parent_id"), "start", "end").agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("x"))
    titles = F.transform("x", lambda t: t["title"])
    name = F.when(F.size("x") == 1, titles[0]).otherwise(union_name(titles, F.col("start"), F.col("end")))
    return one.select("doc_id", "parent_id", "start", "end", F.col("x")[0]["ord"].alias("ord"), name.alias("title"), F.when(F.size("x") > 1, titles).alias("key_items"))


def frontier(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, depth, pages, kind``: what a search may have to scan.

    A leaf is scanned whole at its depth. A parent's pages that no child covers are one more
    stop below it.
    """
    leaf = leaves(nodes).select("doc_id", "node_id", "depth", (F.col("end") - F.col("start") + 1).alias("pages"), F.lit("leaf").alias("kind"))
    parents = nodes.join(leaf.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
    page = parents.select("doc_id", "node_id", "depth", F.explode(F.sequence("start", "end")).alias("page"))
    held = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id"), F.explode(F.sequence("start", "end")).alias("page"))
    rest = page.join(held.distinct(), ["doc_id", "node_id", "page"], "left_anti").groupBy("doc_id", "node_id", "depth").agg(F.count("*").cast("int").alias("pages"))
    return leaf.unionByName(rest.select("doc_id", "node_id", (F.col("depth") + 1).alias("depth"), "pages", F.lit("rest").alias("kind")))


def tree_metrics(nodes: DataFrame, page_counts: DataFrame, routing: int = ROUTING_COST) -> DataFrame:
    """Search complexity of each document's tree: worst case, average, depths, probability mass.

    Sums are of whole numbers and divided once; ties of rounding go up.
    """
    f = frontier(nodes).join(page_counts.select("doc_id", F.col("pages").cast("long").alias("total")), "doc_id")
    cost = F.col("depth") * routing + F.col("pages")
    total = F.max("total")
    return f.groupBy("doc_id").agg(
        F.max(F.col("total").cast("int")).alias("total_pages"), F.count("*").alias("frontier_nodes"), F.max(cost).alias("worst_case"),
        quotient(F.sum((F.col("depth") * 2 * routing + F.col("pages") + 1) * F.col("pages").cast("long")), 2 * total, 3).alias("average_case"),
        quotient(F.max(cost).cast("long"), total, 4).alias("normalized_worst_case"), F.max("depth").alias("max_depth"),
        quotient(F.sum("depth"), F.count("*"), 2).alias("mean_depth"), quotient(F.sum("pages"), total, 4).alias("probability_mass"),
    )


def quotient(n: Column, d: Column, places: int) -> Column:
    """``n / d`` of whole numbers, not negative, to ``places``; exact ties go up."""
    unit = 10**places
    return F.call_function("div", 2 * n * unit + d, 2 * d) / F.lit(float(unit))


def tree_costs(nodes: DataFrame, routing: int = ROUTING_COST) -> DataFrame:
    """``doc_id, node_id, span, cost``: a node's pages, and the worst case of searching its subtree.

    The subtree's frontier is found by paths, ``path_ids`` being a node's ancestors and itself.
    """
    up = nodes.select("doc_id", "node_id", F.explode("path_ids").alias("top"))
    f = frontier(nodes).join(up, ["doc_id", "node_id"])
    tops = nodes.select("doc_id", F.col("node_id").alias("top"), F.col("depth").alias("top_depth"), (F.col("end") - F.col("start") + 1).alias("span"))
    costs = f.join(tops, ["doc_id", "top"]).groupBy("doc_id", F.col("top").alias("node_id"), "span")
    return costs.agg(F.max((F.col("depth") - F.col("top_depth")) * routing + F.col("pages")).alias("cost"))


def with_path_ids(nodes: DataFrame) -> DataFrame:
    """``path_ids`` of each node, by a join for each level of the deepest tree."""
    out = nodes.withColumn("path_ids", F.array("node_id")).withColumn("_up", F.col("parent_id"))
    parents = nodes.select("doc_id", F.col("node_id").alias("_up"), F.col("parent_id").alias("_next"))
    for _ in range((nodes.agg(F.max("depth")).first()[0] or 1) - 1):
        out = out.join(parents, ["doc_id", "_up"], "left").withColumn("path_ids", F.when(F.col("_up").isNotNull(), F.concat(F.array("_up"), F.col("path_ids"))).otherwise(F.col("path_ids"))).drop("_up").withColumnRenamed("_next", "_up")
    return out.drop("_up")


def merged(nodes: DataFrame, routing: int = ROUTING_COST) -> DataFrame:
    """Nodes after collapsing, deepest first, each subtree that a linear scan beats or equals.

    ``key_items`` holds the titles of what was collapsed, in order.
    """
    now = with_path_ids(nodes).withColumn("key_items", F.array().cast("array<string>"))
    deepest = now.agg(F.max("depth")).first()[0] or 1
    for depth in range(deepest - 1, 0, -1):
        parents = now.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
        costs = tree_costs(now, routing).join(parents, ["doc_id", "node_id"], "left_semi")
        gone = costs.join(now.where(F.col("depth") == depth).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").where("span <= cost").select("doc_id", F.col("node_id").alias("top"))
        below = now.select("doc_id", "ord", "title", "key_items", F.col("node_id"), F.explode("path_ids").alias("top")).where("node_id != top").join(gone, ["doc_id", "top"])
        items = below.groupBy("doc_id", F.col("top").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "title", "key_items"))).alias("x"))
        items = items.select("doc_id", "node_id", F.flatten(F.transform("x", lambda t: F.concat(F.array(t["title"]), t["key_items"]))).alias("items"))
        now = now.join(below.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti").join(items, ["doc_id", "node_id"], "left").withColumn("key_items", F.coalesce("items", "key_items")).drop("items")
    return now


def tree_issues(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``doc_id, node_id, issue``: ranges outside the document or turned, starts before the parent's or the sibling's before, uncovered pages."""
    known = nodes.join(page_counts.select("doc_id", "pages"), "doc_id")
    parents = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("start").alias("parent_start"))
    before = F.lag("start").over(Window.partitionBy("doc_id", "parent_id").orderBy("ord"))
    known = known.withColumn("before", before).join(parents, ["doc_id", "parent_id"], "left")
    tests = {
        "start outside": ~F.col("start").between(1, F.col("pages")), "end outside": ~F.col("end").between(1, F.col("pages")), "start after end": F.col("start") > F.col("end"),
        "start before parent": F.col("start") < F.col("parent_start"), "start before sibling": F.col("start") < F.col("before"),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    own = known.select("doc_id", "node_id", F.explode(found).alias("issue"))
    page = page_counts.where("pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    covered = nodes.where("start <= end").select("doc_id", F.explode(F.sequence("start", "end")).alias("page")).distinct()
    gaps = page.join(covered, ["doc_id", "page"], "left_anti")
    return own.unionByName(gaps.select("doc_id", F.lit(None).cast("string").alias("node_id"), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" uncovered")).alias("issue")))


def section_for(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hits(doc_id, page, heading, ...)`` with ``section`` and ``node_id``.

    The node of that title that starts on the page; without a heading, one that started on an
    earlier page; else any. Of those that cover the page the deepest, then the latest start,
    then the latest in order. ``nodes`` need ``path``.
    """
    places = ["doc_id", "page", "heading"]
    # a range of n pages lies in at most three blocks of the power of two next below n; a page lies in one of each size
    level = F.floor(F.log2(F.col("end").cast("long") - F.col("start").cast("long") + 1)).cast("int")
    ranges = nodes.where("start <= end").withColumn("level", level).withColumn("block", F.explode(F.expr("sequence(shiftright(cast(start as bigint), level), shiftright(cast(end as bigint), level))")))
    levels = F.explode(F.sequence(F.lit(0), F.lit(62)))
    asked = hits.select(*places).distinct().select("*", levels.alias("level")).withColumn("block", F.expr("shiftright(cast(page as bigint), level)"))
    meets = (F.col("h.doc_id") == F.col("n.doc_id")) & (F.col("h.level") == F.col("n.level")) & (F.col("h.block") == F.col("n.block"))
    pairs = asked.alias("h").join(ranges.alias("n"), meets & F.col("h.page").between(F.col("n.start"), F.col("n.end")))
    titled = F.col("h.heading").isNotNull() & (F.col("n.start") == F.col("h.page")) & (F.trim("n.title") == F.col("h.heading"))
    earlier = F.col("h.heading").isNull() & (F.col("n.start") < F.col("h.page"))
    rank = F.struct((titled | earlier).cast("int").alias("a"), F.col("n.depth").alias("b"), F.col("n.start").alias("c"), F.col("n.ord").alias("d"))
    best = pairs.groupBy(*[F.col(f"h.{c}").alias(f"_{c}") for c in places]).agg(F.max_by(F.struct(F.array_join("n.path", " > ").alias("section"), F.col("n.node_id").alias("node_id")), rank).alias("best"))
    same = hits["doc_id"].eqNullSafe(best["_doc_id"]) & hits["page"].eqNullSafe(best["_page"]) & hits["heading"].eqNullSafe(best["_heading"])
    out = hits.join(best, same, "left")
    return out.withColumn("section", F.coalesce("best.section", F.lit(""))).withColumn("node_id", F.coalesce("best.node_id", F.lit(""))).drop("best", *[f"_{c}" for c in places])


def recursive_counts(files: DataFrame) -> DataFrame:
    """``dir, n_files, n_dirs``: files and directories anywhere below each directory of ``files(path)``; the root is ''."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = files.select("path", F.explode(above).alias("dir"))
    n_files = each.groupBy("dir").agg(F.count("*").alias("n_files"))
    dirs = each.select("dir").distinct()
    up = F.filter(F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/")) - 1), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/")), lambda d: d != F.col("dir"))
    n_dirs = dirs.where("dir != ''").select(F.explode(up).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_dirs"))
    return n_files.join(n_dirs, "dir", "left").withColumn("n_dirs", F.coalesce("n_dirs", F.lit(0)))


def page_marker_chapters(marks: DataFrame) -> DataFrame:
    """``doc_id, ord, title, page, start, end`` of lines: a chapter for each page mark of ``marks(doc_id, line_no, page, last_line)``, to the line before the next one."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    end = F.coalesce(F.lead("line_no").over(order) - 1, F.col("last_line")).cast("int")
    return marks.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title"), "page", F.col("line_no").cast("int").alias("start"), end.alias("end"))


def chosen_trees(sources: list[tuple[str, DataFrame]], page_counts: DataFrame) -> DataFrame:
    """The nodes of each document's first good source, with ``toc_source``: ``sources`` are names and ``nodes``, the best first.

    ``page_counts(doc_id, pages)``. A tree is good if ``bad_tree_reason`` has nothing against it; where none is, the last source
    that has any nodes is taken. A source may be none for some documents.
    """
    every = None
    for rank, (name, nodes) in enumerate(sources):
        rows = nodes.withColumns({"_rank": F.lit(rank), "toc_source": F.lit(name)})
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    of_source = every.groupBy("doc_id", "_rank", "toc_source").agg(F.count("*").alias("n"), F.avg(is_fake_title("title").cast("int")).alias("fake")).join(page_counts.select("doc_id", "pages"), "doc_id")
    good = _reason().isNull()
    order = F.when(good, F.col("_rank")).otherwise(2 * len(sources) - F.col("_rank"))
    choice = of_source.groupBy("doc_id").agg(F.min_by("_rank", order).alias("_rank"))
    return every.join(choice, ["doc_id", "_rank"]).drop("_rank")


def valid_groups(top: DataFrame, groups: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``doc_id, valid``: whether ``groups(doc_id, nth, title, first, last)`` of top nodes, by ``ord``, may be used.

    Groups in order must take in all of ``top(doc_id, ord)`` one after the other, leave none and overlap nowhere, and have
    a title each; with ``texts(doc_id, text)`` a title must stand in its document, whatever its case and white space.
    """
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    places = top.select("doc_id", "ord", number.alias("place"))
    known = groups.join(places.select("doc_id", F.col("ord").alias("first"), F.col("place").alias("a")), ["doc_id", "first"], "left").join(places.select("doc_id", F.col("ord").alias("last"), F.col("place").alias("b")), ["doc_id", "last"], "left")
    before = F.coalesce(F.lag("b").over(Window.partitionBy("doc_id").orderBy("nth")), F.lit(0))
    good = F.coalesce((F.col("a") == before + 1) & (F.col("b") >= F.col("a")) & (F.trim(F.coalesce("title", F.lit(""))) != ""), F.lit(False))
    if texts is not None:
        known = known.join(texts.select("doc_id", title_key("text").alias("_text")), "doc_id", "left")
        good = good & F.coalesce(F.contains("_text", title_key("title")), F.lit(False))
    facts = known.withColumn("good", good).groupBy("doc_id").agg(F.min("good").alias("good"), F.max("b").alias("b"))
    sizes = places.groupBy("doc_id").agg(F.max("place").alias("n"))
    return sizes.join(facts, "doc_id", "left").select("doc_id", F.coalesce(F.col("good") & (F.col("b") == F.col("n")), F.lit(False)).alias("valid"))
