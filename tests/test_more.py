import html
import unicodedata

from pyspark.sql import functions as F

from foliant.functions import rects, text as T
from foliant.operators import bm25, layout, statistics, trees


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_every_entity(spark):
    from html.entities import html5

    texts = [f"a&{n}b" for n in html5 if n.endswith(";")] + ["&#65;&#x1F600;&#8364;&#128;x", "&amp;lt; & &nosuch; &#0; &#1114112; &#xD800; AT&T &amp", "plain"]
    got = [r[0] for r in frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.plain_text("t")).collect()]
    for t, g in zip(texts[:-3], got):
        assert g == html.unescape(t), t
    assert got[-3:] == ["A😀€€x", "&lt; & &nosuch; � � � AT&T &amp", "plain"]


def test_character_classes(spark):
    texts = ["Ab1é ÀÇ ñ½", "日本ゴ한 x", "Привет ab", "", None, "12 ,.$", "שלום", "é"]
    rows = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", T.char_classes("t").alias("c"), T.script_of("t").alias("s"), T.without_marks("t").alias("w")).orderBy("i").collect()
    assert [r.s for r in rows] == ["latin", "cjk", "cyrillic", None, None, None, "arabic", "latin"]
    for r in rows:
        t = r.t or ""
        kind = [unicodedata.category(c) for c in t]
        assert (r.c.upper, r.c.lower, r.c.digits, r.c.marks) == (kind.count("Lu"), kind.count("Ll"), kind.count("Nd"), sum(k[0] == "M" for k in kind)) and sum(r.c) == len(t)
    assert rows[0].w == "Ab1e AC n½" and rows[7].w == "e" and rows[4].w is None


def test_rectangles(spark):
    rows = frame(spark, [(0.0, 10.0, 10.0, 0.0, 5.0, 15.0, 15.0, 5.0), (0.0, 10.0, 10.0, 0.0, 2.0, 8.0, 8.0, 2.0), (0.0, 10.0, 10.0, 0.0, 13.0, 20.0, -4.0, -9.0), (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "l double, r double, t double, b double, l2 double, r2 double, t2 double, b2 double")
    a, c = rects.rect("l", "r", "t", "b"), rects.rect("l2", "r2", "t2", "b2")
    got = rows.select(rects.overlap(a, c), rects.contains(a, c), rects.gap(a, c), rects.aligned(a, c, 0.5), rects.area(rects.union(a, c)), rects.ratio(rects.width(a), rects.width(c))).collect()
    assert [tuple(r) for r in got] == [(0.25, False, 0.0, None, 225.0, 1.0), (1.0, True, 0.0, "centre", 100.0, 0.6), (0.0, False, 5.0, None, 380.0, 0.7), (0.0, True, 0.0, "left", 0.0, 1.0)]
    one = frame(spark, [(2.0, 6.0), (0.0, 0.0), (-1.0, 2.0)], "a double, b double").select(rects.harmonic_mean(F.col("a"), F.col("b")), rects.ratio(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in one] == [(3.0, 1 / 3), (0.0, 1.0), (-4.0, 0.0)]


NODES = "doc_id string, ord int, node_id string, parent_id string, depth int, title string, start int, end int"


def test_choice_among_trees(spark):
    one = lambda d, n, title="Results of the year": [(d, i, f"{i}", None, 1, f"{title} {i}" if title[0] != "5" else title, i + 1, i + 1) for i in range(n)]
    layout_nodes = frame(spark, one("good", 3) + one("fake", 3, "5%") + one("bad", 3, "5%"), NODES)
    markdown = frame(spark, one("good", 2) + one("fake", 2) + one("bad", 2, "5%") + one("only", 1), NODES)
    counts = frame(spark, [("good", 9), ("fake", 9), ("bad", 9), ("only", 9), ("none", 9)], "doc_id string, pages int")
    got = trees.chosen_trees([("layout", layout_nodes), ("markdown", markdown)], counts).groupBy("doc_id", "toc_source").count().collect()
    assert {(r.doc_id, r.toc_source, r["count"]) for r in got} == {("good", "layout", 3), ("fake", "markdown", 2), ("bad", "markdown", 2), ("only", "markdown", 1)}


def test_groups_are_a_partition(spark):
    top = frame(spark, [(d, o) for d in ("ok", "gap", "over", "short", "title", "back", "none") for o in (0, 3, 5, 9)], "doc_id string, ord int")
    groups = frame(spark, [
        ("ok", 0, "First part", 0, 3), ("ok", 1, "SECOND  part", 5, 9), ("gap", 0, "a", 0, 0), ("gap", 1, "b", 5, 9), ("over", 0, "a", 0, 5), ("over", 1, "b", 5, 9), ("short", 0, "a", 0, 5), ("title", 0, " ", 0, 9), ("back", 0, "a", 3, 0), ("back", 1, "b", 5, 9),
    ], "doc_id string, nth int, title string, first int, last int")
    assert {r.doc_id for r in trees.valid_groups(top, groups).where("valid").collect()} == {"ok"}
    texts = lambda t: frame(spark, [("ok", t)], "doc_id string, text string")
    assert trees.valid_groups(top, groups, texts("the first Part\nand a second part")).where("valid").count() == 1 and trees.valid_groups(top, groups, texts("the first part")).where("valid").count() == 0


def test_marks_and_statistics(spark):
    marks = frame(spark, [("d", 3, 1, 30), ("d", 10, 2, 30), ("e", 1, 7, 4)], "doc_id string, line_no int, page int, last_line int")
    assert [tuple(r) for r in trees.page_marker_chapters(marks).orderBy("doc_id", "ord").collect()] == [("d", 0, "Page 1", 1, 3, 9), ("d", 1, "Page 2", 2, 10, 30), ("e", 0, "Page 7", 7, 1, 4)]
    pages = frame(spark, [("d", 1, 600.0, 800.0), ("d", 2, 900.0, 700.0), ("d", 3, 600.0, 800.0), ("x", 1, 1.0, 1.0)], "doc_id string, page int, width double, height double")
    lines = frame(spark, [("d", 1, 50.0, 250.0, 10.0, "word " * 20), ("d", 1, 60.0, 300.0, 20.0, "日本"), ("d", 2, 70.0, 100.0, 10.0, "more")], "doc_id string, page int, left double, right double, font_size double, text string")
    got = {r.doc_id: r.asDict() for r in layout.document_statistics(lines, pages).collect()}
    assert got["d"] == {"doc_id": "d", "pages": 3, "landscape": 1, "width": 600.0, "height": 800.0, "line_width": 200.0, "line_left": 60.0, "body_size": 10.0, "p80_size": 10.0, "script": "latin"} and got["x"]["line_width"] is None
    pairs = frame(spark, [(1, 2), (1, 3), (4, 5)], "a int, b int")
    chunks = frame(spark, [(1, "p"), (2, "p"), (3, "q"), (4, "q"), (5, "q"), (6, "r")], "key int, doc_id string")
    assert {tuple(r) for r in statistics.duplication(pairs, chunks).collect()} == {("p", 2, 2, 2, 1), ("q", 3, 3, 2, 1), ("r", 1, 0, 0, 0)}


def test_best_pages_are_those_of_all_passages(spark):
    """Pages by their best passage, without a row for each query and passage: few go on, and the best are those of the whole search."""
    words = [f"w{i}" for i in range(40)]
    lines = [(d, 1 + u // 3, u, " ".join(words[(d * 7 + u * u + j * (1 + d % 3)) % 40] for j in range(9))) for d in range(300) for u in range(6)]
    passages = spark.createDataFrame([*lines, (300, 1, 0, ""), (301, 1, 0, None), *((900 + d, *x[1:]) for d in range(4) for x in lines[:6])], "doc_id long, page int, unit int, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w1 w2 w3 w3"), (2, "w5 w39 nothing"), (3, "nothing"), (4, None), (5, " ".join(words))], "query_id long, query string")
    best = bm25.best_pages(passages, asked, 4, markup=False)
    rank = lambda x: {(r.query_id, r.rank, r.doc_id, r.unit, r.passage, round(r.score, 9)) for r in bm25.top_k(x.withColumn("score", F.round("score", 9)), 4).collect()}
    pages = passages.groupBy("doc_id", F.col("page").alias("unit")).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    by_page = passages.select("doc_id", "page", (F.col("unit") + 0).alias("unit"), "text")
    whole = bm25.search_passages(pages, by_page, asked, 1 << 30, markup=False).drop("rank")
    assert rank(best) == rank(whole) and len(rank(best)) == 12
    assert best.count() < whole.count() / 4
