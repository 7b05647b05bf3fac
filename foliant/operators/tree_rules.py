"""Tree rules that move nodes: fake and continued titles, missing containers, thinning, optimising.

Rules are joins and windows over ``nodes`` as in ``trees``; only the folding of fake titles, where
what becomes of a node hangs on its children and on the sibling before it, takes a document at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from foliant.functions.arrays import scan
from foliant.functions.python_text import as_column, title_form
from foliant.functions.text import title_key
from foliant.operators import trees
from foliant.sources.staging import written

#: Fixed value: what a title ends with that another one goes on with.
CONTINUED = r"(?i)\s*[（(]\s*(?:續|续|continued)\s*[)）]\s*$"
NODES = "doc_id string, node_id string, parent_id string, depth int, ord int, title string, start int, end int"


def _titled(nodes: DataFrame) -> DataFrame:
    """``nodes`` with what its rules ask of a title: whether it is fake, whether it goes on, and the name it goes on with."""
    own = F.regexp_replace(F.coalesce("title", F.lit("")), CONTINUED, "")
    return nodes.withColumns({"fake": trees.is_fake_title("title"), "goes_on": F.coalesce(F.col("title").rlike(CONTINUED), F.lit(False)), "name": title_key(own)})


def settled(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one document after ``drop_fake_titles``, in order, with new numbers.

    The lists of children are settled from the deepest level up, so that what takes a node's place
    is known when its own list is settled.
    """
    rows = rows.sort_values("ord").reset_index(drop=True)
    title, start, end = rows["title"].tolist(), rows["start"].tolist(), rows["end"].tolist()
    fake, goes_on, name = rows["fake"].tolist(), rows["goes_on"].tolist(), rows["name"].tolist()
    number = {n: i for i, n in enumerate(rows["node_id"])}
    lists: dict[int, list[int]] = {}  # -1 holds the top level
    for i, parent in enumerate(rows["parent_id"]):
        lists.setdefault(number.get(parent, -1), []).append(i)
    level = dict(enumerate(rows["depth"].tolist())) | {-1: 0}

    def last_line(node: int) -> list[int]:
        """The node and the last child of each on the way down."""
        out = [node]
        while lists.get(out[-1]):
            out.append(lists[out[-1]][-1])
        return out

    for holder in sorted(lists, key=lambda h: -level[h]):
        stay: list[int] = []
        lost_start = None
        for i in lists[holder]:
            again = goes_on[i] and bool(stay) and name[stay[-1]] == name[i]
            shell = goes_on[i] and holder >= 0 and name[holder] == name[i] and not again
            if shell or fake[i] and not stay:  # its children take its place; a first top node leaves its start
                if not shell and holder < 0 and not lists.get(i):
                    lost_start = start[i] if lost_start is None else lost_start
                stay += lists.get(i, [])
            elif again or fake[i]:
                for x in last_line(stay[-1]):
                    end[x] = max(end[x], end[i])
                lists[stay[-1]] = lists.get(stay[-1], []) + lists.get(i, [])
            else:
                start[i], lost_start = min(start[i], start[i] if lost_start is None else lost_start), None
                stay.append(i)
        lists[holder] = stay if stay or holder >= 0 else lists[holder][:1]
    out: list[tuple] = []
    todo = [(i, None, 1) for i in reversed(lists.get(-1, []))]
    while todo:
        i, parent, depth = todo.pop()
        own = f"{len(out):04d}"
        out.append((rows["doc_id"][0], own, parent, depth, len(out), title[i], start[i], end[i]))
        todo += [(k, own, depth + 1) for k in reversed(lists.get(i, []))]
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])


def drop_fake_titles(nodes: DataFrame) -> DataFrame:
    """``NODES`` without headings that are body text.

    The pages and children of one go to the sibling before it; a first child leaves its children in its
    place; a first top node gives its start to the next. A title that is continued joins its
    sibling of the same name, or gives way to its children under a parent of that name. A document
    of nothing else keeps its first.
    """
    plain = nodes.select(F.col("doc_id").cast("string").alias("doc_id"), "node_id", "parent_id", "depth", "ord", "title", "start", "end")
    return _titled(plain).groupBy("doc_id").applyInPandas(settled, NODES)


def numeral(title: str) -> Column:
    return F.split(F.trim(title), "[、．.\\s]", 2)[0]


def with_containers(nodes: DataFrame, headings: DataFrame) -> DataFrame:
    """``NODES`` and the outermost numbered ``headings(doc_id, page, title)`` that the top level lacks.

    One goes before the first top node that starts after it, or on its page without such a number, if
    that node has a number of a lower style; of headings of one number the first such. New numbers.
    """
    top = nodes.where("depth = 1").select("doc_id", "ord", "start", numeral("title").alias("number"), trees.numbering_rank("title").alias("rank"))
    asked = headings.where(trees.numbering_rank("title") == 0).select("doc_id", "page", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), numeral("title").alias("number"))
    asked = asked.join(top.where("rank = 0").select("doc_id", "number"), ["doc_id", "number"], "left_anti")
    later = (F.col("start") > F.col("page")) | ((F.col("start") == F.col("page")) & (F.coalesce("rank", F.lit(-1)) != 0))
    place = asked.join(top.select("doc_id", "ord", "start", "rank"), "doc_id").where(later).groupBy("doc_id", "number", "page", "title").agg(F.min_by(F.struct("ord", "rank"), "ord").alias("before"))
    first = Window.partitionBy("doc_id", "number").orderBy("page", "title")
    fresh = place.where("before.rank > 0").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    fresh = fresh.select("doc_id", F.concat(F.lit("+"), "number").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("depth"), (F.col("before.ord") - 0.5).alias("at"), "title", F.col("page").alias("start"), F.col("page").alias("end"))
    every = nodes.select("doc_id", "node_id", "parent_id", "depth", F.col("ord").cast("double").alias("at"), "title", "start", "end").unionByName(fresh)
    return numbered(every, "at", "start")


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """``NODES`` in the order of columns, with preorder numbers for ids."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    rows = nodes.withColumn("ord", nth.cast("int")).withColumn("own", F.lpad(F.col("ord").cast("string"), 4, "0"))
    parents = rows.select("doc_id", F.col("node_id").alias("parent_id"), F.col("own").alias("parent"))
    out = rows.join(parents, ["doc_id", "parent_id"], "left")
    return out.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("own").alias("node_id"), F.col("parent").alias("parent_id"), F.col("depth").cast("int").alias("depth"), "ord", "title", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def subtree_tokens(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, tokens``: own tokens and those below; ``nodes`` need ``path_ids`` and ``own_tokens``."""
    up = nodes.select("doc_id", "own_tokens", F.explode("path_ids").alias("node_id"))
    return up.groupBy("doc_id", "node_id").agg(F.sum("own_tokens").alias("tokens"))


def thinned(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes that stay when every subtree of fewer than ``least`` tokens is folded into its top.

    ``folded`` says how many nodes below went.
    """
    small = subtree_tokens(nodes).where(F.col("tokens") < least).select("doc_id", F.col("node_id").alias("top"))
    below = nodes.select("doc_id", "node_id", F.explode("path_ids").alias("top")).where("node_id != top").join(small, ["doc_id", "top"])
    gone = below.select("doc_id", "node_id").distinct()
    counts = below.groupBy("doc_id", F.col("top").alias("node_id")).agg(F.count("*").alias("folded"))
    return nodes.join(gone, ["doc_id", "node_id"], "left_anti").join(counts, ["doc_id", "node_id"], "left").withColumn("folded", F.coalesce("folded", F.lit(0)))


#: A leaf of more pages may be expanded.
EXPANDABLE = 5


def with_ends(children: DataFrame, holders: DataFrame) -> DataFrame:
    """``children(doc_id, parent_id, title, start)`` with ``end``: the page before the next one's start, the last to its holder's end."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("start", "title")
    rows = children.select("doc_id", "parent_id", "title", "start").join(holders.select("doc_id", F.col("node_id").alias("parent_id"), F.col("end").alias("_end")), ["doc_id", "parent_id"])
    return rows.withColumn("end", F.greatest("start", F.coalesce(F.lead("start").over(order) - 1, F.col("_end")))).drop("_end")


def verbatim(children: DataFrame, pages: DataFrame) -> DataFrame:
    """Those ``children(doc_id, start, title, ...)`` whose title is a line of their first page, ``pages(doc_id, page, markdown)``.

    White space, case and the marks of Markdown do not count; nothing else may stand on the line.
    """
    bare = lambda c: title_key(F.regexp_replace(c, r"^[\s#>*_]+|[\s#*_]+$", ""))
    lines = pages.select("doc_id", F.col("page").alias("start"), F.explode(F.split("markdown", "\n")).alias("line")).select("doc_id", "start", bare(F.col("line")).alias("_key")).where("_key != ''").distinct()
    return children.withColumn("_key", bare(F.col("title"))).join(lines, ["doc_id", "start", "_key"], "left_semi").drop("_key")


def expanded(nodes: DataFrame, propose: Callable[[DataFrame], DataFrame], pages: DataFrame | None = None, routing: int = trees.ROUTING_COST) -> DataFrame:
    """``nodes`` with children for leaves of over ``EXPANDABLE`` pages that are not ``decided``, where these make the search cheaper.

    ``propose(leaves)`` returns ``doc_id, parent_id, title, start``. Proposals outside of their leaf are refused, as is, with
    ``pages(doc_id, page, markdown)``, a title that its page does not show as a line. A leaf is
    expanded by two children or more if routing and the longest of them beat its own scan. Every leaf that
    was asked about is ``decided``, and so are its children.
    """
    asked = written(trees.leaves(nodes).where(~F.col("decided") & (F.col("end") - F.col("start") + 1 > EXPANDABLE)), "expandable")
    offered = propose(asked).select("doc_id", "parent_id", "title", "start")
    inside = offered.join(asked.select("doc_id", F.col("node_id").alias("parent_id"), F.col("start").alias("_from"), F.col("end").alias("_to")), ["doc_id", "parent_id"]).where("start between _from and _to").select("doc_id", "parent_id", "title", "start").distinct()
    shown = inside if pages is None else verbatim(inside, pages)
    fit = written(with_ends(shown, asked), "proposals")
    price = fit.groupBy("doc_id", "parent_id").agg((F.max(F.col("end") - F.col("start") + 1) + routing).alias("price"), F.count("*").alias("n"))
    span = F.col("end") - F.col("start") + 1
    good = price.join(asked.select("doc_id", F.col("node_id").alias("parent_id"), "depth", "ord", span.alias("span")), ["doc_id", "parent_id"]).where("price < span and n > 1")
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("start", "title"))
    fresh = fit.join(good, ["doc_id", "parent_id"]).withColumn("nth", nth)
    fresh = fresh.select("doc_id", F.concat_ws(".", "parent_id", F.col("nth").cast("string")).alias("node_id"), "parent_id", (F.col("depth") + 1).alias("depth"), "ord", "nth", "title", "start", "end", F.array().cast("array<string>").alias("key_items"), F.lit(True).alias("decided"))
    met = nodes.join(asked.select("doc_id", "node_id", F.lit(True).alias("_asked")), ["doc_id", "node_id"], "left")
    met = met.select("doc_id", "node_id", "parent_id", "depth", "ord", F.lit(0).alias("nth"), "title", "start", "end", "key_items", (F.col("decided") | F.coalesce("_asked", F.lit(False))).alias("decided"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "nth")) - 1
    return met.unionByName(fresh).withColumn("ord", order.cast("int")).drop("nth")


def optimized(nodes: DataFrame, propose: Callable[[DataFrame], DataFrame] | None = None, pages: DataFrame | None = None, routing: int = trees.ROUTING_COST, rounds: int = 3) -> DataFrame:
    """Merge, and expand where proposals make the search cheaper, in rounds until nothing changes.

    What was merged or asked about once is frozen: ``decided`` says so, and ``nodes`` that bring the column back
    are left as they are, so that a second run changes nothing and asks nothing.
    """
    given = nodes if "decided" in nodes.columns else nodes.withColumn("decided", F.lit(False))
    had = given if "key_items" in given.columns else given.withColumn("key_items", F.array().cast("array<string>"))
    now = written(_frozen_merge(had, routing), "tree-round")
    for _ in range(rounds if propose else 0):
        before = now.count()
        now = written(_frozen_merge(expanded(now, propose, pages, routing), routing), "tree-round")
        if now.count() == before:
            break
    return trees.with_path_ids(now)


def _frozen_merge(nodes: DataFrame, routing: int) -> DataFrame:
    """``trees.merged`` of what is not decided yet: a tree of which no node is stays as it is."""
    open_ = nodes.where(~F.col("decided")).select("doc_id").distinct()
    settled = nodes.join(open_, "doc_id", "left_anti")
    kept = nodes.select("doc_id", "node_id", F.col("key_items").alias("_items"), "decided")
    merged = trees.merged(nodes.drop("key_items", "decided", "path_ids").join(open_, "doc_id", "left_semi"), routing).drop("path_ids")
    merged = merged.join(kept, ["doc_id", "node_id"]).withColumns({"decided": F.col("decided") | (F.size("key_items") > 0), "key_items": F.concat("_items", F.col("key_items"))})
    columns = ["doc_id", "node_id", "parent_id", "depth", "ord", "title", "start", "end", "key_items", "decided"]
    return merged.select(*columns).unionByName(settled.select(*columns))


def bookmark_nodes(marks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``NODES`` from bookmarks ``(doc_id, ord, level, title, page)`` that go forward: ends before the next of their level."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    inside = marks.join(page_counts.select("doc_id", "pages"), "doc_id").where("page between 1 and pages")
    kept = inside.withColumn("most", F.max("page").over(before)).where("most is null or page >= most")
    kept = kept.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).cast("int"))
    one = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("level").cast("int").alias("level"), "title", F.col("page").cast("int").alias("page")))).alias("found"), F.first("pages").cast("int").alias("pages"))
    stacked = "array<struct<level:int,ord:int>>"

    def above(stack: Column, m: Column) -> tuple[Column, Column]:
        """The marks that hold ``m``, the innermost last; and with ``m`` for what follows."""
        outer = F.filter(stack, lambda s: s["level"] < m["level"])
        return F.array_append(outer, F.struct(m["level"].alias("level"), m["ord"].alias("ord"))), F.transform(outer, lambda s: s["ord"])

    def below(ends: Column, m: Column) -> tuple[Column, Column]:
        """From the last mark on: where the nearest later mark of each level up to ``m``'s begins."""
        later = F.filter(ends, lambda e: e["level"] <= m["level"])
        end = F.when(F.size(later) > 0, F.greatest(m["page"], F.try_element_at(later, F.lit(-1))["ord"] - 1)).otherwise(F.col("pages"))
        return F.array_append(later, F.struct(m["level"].alias("level"), m["page"].alias("ord"))), end

    none = F.array().cast(stacked)
    one = one.withColumns({"holders": scan(F.col("found"), none, above, "array<int>"), "ends": F.reverse(scan(F.reverse("found"), none, below, "int"))})
    each = one.select("doc_id", F.explode(F.arrays_zip("found", "holders", "ends")).alias("x"))
    name = lambda o: F.lpad(o.cast("string"), 4, "0")
    return each.select(F.col("doc_id").cast("string").alias("doc_id"), name(F.col("x.found.ord")).alias("node_id"), name(F.try_element_at("x.holders", F.lit(-1))).alias("parent_id"), (F.size("x.holders") + 1).alias("depth"), F.col("x.found.ord").alias("ord"), F.col("x.found.title").alias("title"), F.col("x.found.page").alias("start"), F.col("x.ends").alias("end"))


#: Titles that number pages alone, and words that number what a book is made of.
GENERIC = r"(?i)^(?:(?:page|slide|folie|document\s+page)\s*)?\d+$"
CONTENT_UNITS = ["chapter", "chap", "ch", "part", "pt", "section", "sec", "book", "appendix", "unit", "lesson", "章", "部", "节", "篇", "卷", "第章", "第部", "第节", "第篇", "第卷"]


def bookmark_tier(marks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``doc_id, kept, tier`` of bookmarks as of ``bookmark_nodes``: what they are good for.

    ``IGNORE``: fewer than three, half or more mere page numbers, half or more of one form with a counter
    (unless it is one counter of chapters and the like), or a quarter or less different titles.
    ``FULL``: nested, and six or one for twenty pages at least. Else ``SKELETON``.
    """
    nodes = bookmark_nodes(marks, page_counts)
    form, template = (as_column(lambda t, k=k: title_form(t, k), "string")("title") for k in (False, True))
    nodes = nodes.select("doc_id", "ord", "depth", F.trim("title").rlike(GENERIC).cast("int").alias("generic"), form.alias("form"), template.alias("template"))
    often = nodes.groupBy("doc_id", "template").agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    often = often.groupBy("doc_id").agg(F.max_by(F.struct("template", "n"), F.struct("n", -F.col("seen"))).alias("top"))
    facts = nodes.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("generic").alias("generic"), F.count_distinct("form").alias("forms"), F.max("depth").alias("depth"))
    counts = page_counts.select(F.col("doc_id").cast("string").alias("doc_id"), "pages")
    facts = facts.join(often, "doc_id").join(counts, "doc_id")
    counters = F.length("top.template") - F.length(F.replace("top.template", F.lit("#"), F.lit("")))
    filed = (counters >= 1) & (2 * F.col("top.n") >= F.col("kept")) & ((counters >= 2) | ~F.replace("top.template", F.lit("#"), F.lit("")).isin(*CONTENT_UNITS))
    poor = (F.col("kept") < 3) | (2 * F.col("generic") >= F.col("kept")) | filed | (4 * F.col("forms") <= F.col("kept"))
    full = (F.col("depth") >= 2) & (F.col("kept") >= F.greatest(F.lit(6), F.floor(F.col("pages") / 20)))
    return facts.select("doc_id", "kept", F.when(poor, "IGNORE").when(full, "FULL").otherwise("SKELETON").alias("tier"))


#: Titles that stand so often in a document, or are so long, are no headings.
OFTEN, LONGEST = 3, 100


def repaired_titles(base: DataFrame, detected: DataFrame) -> DataFrame:
    """``base`` with bookmark titles as their pages spell them: a detected title that a bookmark's begins, or equals but for its form.

    Of several on a bookmark's page the shortest counts; a bookmark of fewer than four letters is left.
    """
    form = as_column(lambda t: title_form(t), "string")
    own = base.withColumn("_form", form(F.coalesce("title", F.lit(""))))
    seen = detected.where(F.length("title") <= LONGEST).select("doc_id", "start", F.col("title").alias("_seen"), form(F.coalesce("title", F.lit(""))).alias("_of"))
    met = own.where(F.length("_form") >= 4).join(seen, ["doc_id", "start"]).where(F.startswith("_of", F.col("_form")))
    best = met.groupBy("doc_id", "node_id").agg(F.min_by("_seen", F.struct(F.length("_of"), "_seen")).alias("_seen"))
    return own.drop("_form").join(best, ["doc_id", "node_id"], "left").withColumn("title", F.coalesce("_seen", "title")).drop("_seen")


def merged_bookmarks(base: DataFrame, detected: DataFrame) -> DataFrame:
    """``NODES``: a bookmark tree, its titles repaired, with the detected nodes hung into it by their pages.

    A detected node is held by the deepest bookmark on whose pages it begins. One that goes on past its holder is
    dissolved: what hangs below it is hung anew, each under its own holder or the nearest detected node above it that
    stays under the same one. So do the nodes below a title that is refused: one over ``LONGEST`` characters, one
    that stands ``OFTEN`` times or more, or its holder's own title. Bookmarks keep their pages: none is lost or doubled.
    """
    base, found = repaired_titles(base, detected), trees.with_path_ids(detected)
    often = detected.groupBy("doc_id", title_key("title").alias("_key")).agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select("doc_id", "_key")
    covers = (F.col("d.doc_id") == F.col("b.doc_id")) & F.col("d.start").between(F.col("b.start"), F.col("b.end"))
    pairs = found.alias("d").join(base.alias("b"), covers)
    holder = F.struct("b.depth", "b.start", "b.ord")
    placed = pairs.groupBy("d.doc_id", "d.node_id").agg(F.max_by(F.struct(F.col("b.node_id").alias("node_id"), F.col("b.title").alias("title"), F.col("b.depth").alias("depth"), F.col("b.ord").alias("ord"), F.col("b.end").alias("end")), holder).alias("h"))
    rows = found.join(placed, ["doc_id", "node_id"]).withColumn("_key", title_key("title"))
    stays = (F.col("end") <= F.col("h.end")) & (F.length("title") <= LONGEST) & (F.col("_key") != title_key("h.title")) & (F.col("_key") != "")
    stays = rows.where(stays).join(often, ["doc_id", "_key"], "left_anti")
    stays = written(stays.select("doc_id", "node_id", "ord", "title", "start", "end", "path_ids", "h"), "bookmark-parts")

    up = stays.select("doc_id", "node_id", F.col("h.node_id").alias("holder"), F.posexplode("path_ids").alias("level", "top")).where("top != node_id")
    tops = stays.select("doc_id", F.col("node_id").alias("top"), F.col("h.node_id").alias("holder"))
    above = up.join(tops, ["doc_id", "top", "holder"]).groupBy("doc_id", "node_id").agg(F.max_by("top", "level").alias("top"), F.count("*").alias("between"))
    hung = stays.join(above, ["doc_id", "node_id"], "left")
    hung = hung.select("doc_id", F.concat(F.lit("d"), "node_id").alias("node_id"), F.coalesce(F.concat(F.lit("d"), "top"), F.col("h.node_id")).alias("parent_id"), (F.col("h.depth") + 1 + F.coalesce("between", F.lit(0))).cast("int").alias("depth"), F.col("h.ord").alias("_first"), "start", (F.col("ord") + 1).alias("_then"), "title", "end")
    whole = base.select("doc_id", "node_id", "parent_id", "depth", F.col("ord").alias("_first"), "start", F.lit(0).alias("_then"), "title", "end").unionByName(hung)
    # What hangs under a bookmark with children of its own stands among them by page.
    at = _placed(whole)
    return numbered(at, "_at")


def _placed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``_at``: the way to each from the top, a bookmark before what begins with it and children in order of pages."""
    own = F.struct("start", F.col("_then"), "_first", "node_id")
    rows = nodes.withColumns({"_at": F.array(own), "_up": F.col("parent_id")})
    steps = nodes.select("doc_id", F.col("node_id").alias("_up"), F.col("parent_id").alias("_next"), F.array(own).alias("_step"))
    for _ in range((nodes.agg(F.max("depth")).first()[0] or 1) - 1):
        rows = rows.join(steps, ["doc_id", "_up"], "left").withColumns({"_at": F.when(F.col("_step").isNotNull(), F.concat("_step", "_at")).otherwise(F.col("_at")), "_up": F.col("_next")}).drop("_step", "_next")
    return rows.drop("_up")


def graft(base: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected nodes hung under the deepest leaf of a bookmark tree that covers them.

    One that spans several leaves is left out, as is a title that its holder already has, one of over
    100 characters, or one that stands three times or more in the document.
    """
    often = detected.groupBy("doc_id", "title").agg(F.count("*").alias("n")).where("n >= 3").select("doc_id", "title")
    fit = detected.where(F.length("title") <= 100).join(often, ["doc_id", "title"], "left_anti").alias("d")
    holder = trees.leaves(base).alias("b")
    covers = (F.col("d.doc_id") == F.col("b.doc_id")) & F.col("d.start").between(F.col("b.start"), F.col("b.end")) & (F.col("d.end") <= F.col("b.end"))
    pairs = fit.join(holder, covers).where(F.lower("d.title") != F.lower("b.title"))
    best = pairs.groupBy("d.doc_id", "d.node_id").agg(F.max_by(F.struct(F.col("b.node_id").alias("parent_id"), F.col("b.depth").alias("depth"), F.col("b.ord").alias("ord"), F.col("d.title").alias("title"), F.col("d.start").alias("start"), F.col("d.end").alias("end")), F.struct("b.depth", "b.start")).alias("x"))
    fresh = best.select("doc_id", F.concat(F.lit("d"), "node_id").alias("node_id"), "x.parent_id", (F.col("x.depth") + 1).alias("depth"), "x.ord", "x.title", "x.start", "x.end")
    every = base.select(*fresh.columns).unionByName(fresh)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "depth", "start", "node_id")) - 1
    return every.withColumn("ord", order.cast("int"))


def graft(base: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected nodes hung under the deepest leaf of a bookmark tree that covers them.

    One that spans several leaves is left out, as is a title that its holder already has, one of over
    100 characters, or one that stands three times or more in the document.
    """
    often = detected.groupBy("doc_id", "title").agg(F.count("*").alias("n")).where("n >= 3").select("doc_id", "title")
    fit = detected.where(F.length("title") <= 100).join(often, ["doc_id", "title"], "left_anti").alias("d")
    holder = trees.leaves(base).alias("b")
    covers = (F.col("d.doc_id") == F.col("b.doc_id")) & F.col("d.start").between(F.col("b.start"), F.col("b.end")) & (F.col("d.end") <= F.col("b.end"))
    pairs = fit.join(holder, covers).where(F.lower("d.title") != F.lower("b.title"))
    best = pairs.groupBy("d.doc_id", "d.node_id").agg(F.max_by(F.struct(F.col("b.node_id").alias("parent_id"), F.col("b.depth").alias("depth"), F.col("b.ord").alias("ord"), F.col("d.title").alias("title"), F.col("d.start").alias("start"), F.col("d.end").alias("end")), F.struct("b.depth", "b.start")).alias("x"))
    fresh = best.select("doc_id", F.concat(F.lit("d"), "node_id").alias("node_id"), "x.parent_id", (F.col("x.depth") + 1).alias("depth"), "x.ord", "x.title", "x.start", "x.end")
    every = base.select(*fresh.columns).unionByName(fresh)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "depth", "start", "node_id")) - 1
    return every.withColumn("ord", order.cast("int"))
