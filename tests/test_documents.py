import time
import pytest
from pyspark.sql import functions as F

from foliant.library import Library, register_sql
from foliant.operators import changes, layout, pages, passages, routing, statistics, trees
from foliant.sources import readers
from foliant.streaming import watch

REPORT = """<!-- page: 1 -->
# Annual report

Opening words on insurance.

## Results
<!-- PageNumber="i" -->
| Item | 2023 |
|---|---|
| Profit | 6,610 |
<!-- page: 2 -->
| Sales | 4,034 |

**Outlook**
The outlook is good.
<!-- page: 4 -->
## Risk
Market risk remains.
"""


def paged(spark, *texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    out = {}
    for r in pages.pages(docs).orderBy("doc_id", "page").collect():
        out.setdefault(r.doc_id, []).append(r)
    return [out[str(i)] for i in range(len(texts))]


def test_page_marks(spark):
    report, breaks, late, no, mixed = paged(spark, REPORT, "a\r\n<!-- PageBreak -->\nb <!-- PageBreak --> c", 'intro\n<!-- page: 2 --> two <!-- PageHeader="H &amp;\nx" --> more\n<!-- note -->\nlast<!-- PAGE:3 -->', None, "<!-- a <!-- page: 3 -->x")
    assert [p.mode for p in report] == ["marker"] * 4 and report[2].markdown == "" and report[0].label == "i" and report[1].label is None
    assert report[1].markdown.startswith("| Item | 2023 |\n|---|---|\n| Sales")
    assert [p.markdown for p in breaks] == ["a", "b", "c"] and breaks[0].mode == "pagebreak"
    assert [p.markdown for p in late] == ["", "intro\ntwo  more\nlast"] and late[1].headers == ["H &\nx"]
    assert [p.markdown for p in no] == [""] and [p.markdown for p in mixed] == ["", "", "x"][-len(mixed):]
    lines = spark.createDataFrame([("\n".join(["x" * 10, "", "y", "```", "", "z" * 30, "```", "w"]),)], "t string")
    assert lines.select(pages.pseudo_pages("t", 5)).first()[0] == [1, 2, 2, 2, 2, 2, 2, 3]


def test_pseudo_pages_of_many_lines(spark):
    import random

    rng = random.Random(4)
    lines = [rng.choice(["", "# head", "some words here", "```", "| a |", "x" * rng.randint(1, 90)]) for _ in range(3000)]
    want, page, size, fenced = [], 1, 0, False
    for line in lines:
        if not fenced and (size >= 200 and (not line or line.startswith("# ")) or size >= 400):
            page, size = page + 1, 0
        fenced ^= line.startswith("```")
        size += len(line) + 1
        want.append(page)
    got = spark.createDataFrame([("\n".join(lines),)], "t string").select(pages.pseudo_pages("t", 200)).first()[0]
    assert got == want


def test_tables_are_whole_on_each_page():
    one, two = pages.whole_tables(["<table><tr><th>A</th><th>B</th></tr><tr><td>1</td>", "<td>2</td></tr></table>"])
    assert one.endswith("</tr></table>") and two.startswith("<table>\n<tr><th>A</th><th>B</th></tr><tr>\n<td>2")
    one, two = pages.whole_tables(["<table><tr><th>A</th></tr><tr><td>1</td></tr></table>", "<table><tr><td>2</td></tr></table>"])
    assert "<th>A</th>" in two and pages.without_blocks(["<table>", "# no", "</table>", "# yes"]) == ["", "", "", "# yes"]
    wide = "<table><tr><th colspan=2>A</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert "colspan" in pages.whole_tables([wide, " <table><tr><td>3</td><td>4</td></tr></table>"])[1]
    assert "colspan" not in pages.whole_tables([wide, "<table><tr><td>3</td></tr></table>"])[1]
    assert "colspan" not in pages.whole_tables([wide, "", "<table><tr><td>3</td><td>4</td></tr></table>"])[2]
    assert pages.without_blocks(["<figure>", "a", "</table>", "# b"]) == ["<figure>", "a", "</table>", "# b"]


def test_passages():
    long = "First sentence is here. " * 60
    cut = passages.split("# Head\n\n" + long)
    assert len(cut) > 1 and cut[0][2].startswith("# Head") and all(passages.size(t) <= 830 for _, _, t in cut)
    table = "| a | b |\n|---|---|\n" + "".join(f"| row {i} with words | {i} |\n" for i in range(80))
    cut = passages.split(table)
    assert len(cut) > 1 and all(t.startswith("| a | b |\n|---|---|") for _, _, t in cut)
    cut = passages.split("# A\n" + "word " * 80 + "\n# B\nshort")
    assert [t[:3] for _, _, t in cut] == ["# A", "# B"] and passages.split(" \n ") == []
    squeezed = lambda page: [" ".join(t.split()) for _, _, t in passages.split(page)]
    assert squeezed("## A\n\n" + "y" * 500 + "\n\n### B\n\n" + "z" * 500) == ["## A " + "y" * 500, "### B " + "z" * 500]
    small = "## Two\n\nshort\n\n| a |\n|---|\n| 1 |\n\n## Three\n\nlast"
    assert squeezed("# T\n\n## One\n\n" + "x" * 350 + "\n\n" + small) == ["# T ## One " + "x" * 350, " ".join(small.split())]
    rows = "".join(f"<tr><td>row {i}</td><td>{i * 7}</td></tr>" for i in range(60))
    cut = passages.split(f"intro<table><tr><th>Item</th><th>Value</th></tr>{rows}</table>tail")
    assert cut[0][2] == "intro" and cut[-1][2] == "tail" and sum(t.count("<td>row ") for _, _, t in cut) == 60
    assert all(t.startswith("<table><tr><th>Item</th><th>Value</th></tr><tr>") and t.endswith("</table>") and passages.size(t) <= 800 for _, _, t in cut[1:-1])
    cut = passages.split("w" * 2000 + " one. Two three.")
    assert [len(t) for _, _, t in cut] == [800, 800, 416] and "".join(t for _, _, t in cut) == "w" * 2000 + " one. Two three."


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_numbering_groups(spark):
    titles = ["一、概述", "1. Scope", "(a) One", "free", "2. More", "二、末"]
    rows = frame(spark, [("d", "p", i, t) for i, t in enumerate(titles)], "doc_id string, parent_id string, ord int, title string")
    assert [r.holder_ord for r in trees.group_by_numbering(rows).orderBy("ord").collect()] == [None, 0, 1, 1, 0, None]


def test_merging_trees(spark):
    nodes = frame(spark, [("d", 0, "0", None, 1, "Aims", 1, 2), ("d", 1, "1", "0", 2, "Base", 1, 1), ("d", 2, "2", "0", 2, "Cost", 2, 2), ("d", 3, "3", None, 1, "Debt", 3, 30), ("d", 4, "4", "3", 2, "Ends", 3, 15), ("d", 5, "5", "3", 2, "Fees", 16, 30)], "doc_id string, ord int, node_id string, parent_id string, depth int, title string, start int, end int")
    left = {r.node_id: r.key_items for r in trees.merged(nodes).collect()}
    assert set(left) == {"0", "3", "4", "5"} and left["0"] == ["Base", "Cost"] and left["3"] == []
    counts = frame(spark, [("d", 30, "layout")], "doc_id string, pages int, toc_source string")
    assert trees.bad_tree_reason(nodes, counts).first().reason is None and not trees.flat_top(nodes, counts).first().flat
    assert trees.tree_issues(nodes, counts).count() == 0


def test_section_of_a_hit(spark):
    nodes = trees.page_tree(pages.lines(frame(spark, [("d", REPORT)], "doc_id string, text string")))
    hits = frame(spark, [("d", 2, "Outlook"), ("d", 2, None), ("d", 4, "Risk"), ("d", 9, None)], "doc_id string, page int, heading string")
    got = {(r.page, r.heading): r.section for r in trees.section_for(hits, nodes).collect()}
    assert got[2, "Outlook"] == "Annual report > Results > Outlook" and got[4, "Risk"] == "Annual report > Risk" and got[9, None] == ""
    assert got[2, None] == "Annual report > Results"


def test_section_of_many_hits(spark):
    """Hits of one place are looked up once, and a place meets the ranges around it alone: not each hit every node of its document."""
    n = 20_000
    nodes = spark.range(n).selectExpr("'d' AS doc_id", "id AS ord", "concat('n', id) AS node_id", "1 AS depth", "'t' AS title", "array('t') AS path", "cast(id * 3 - 3 AS int) AS start", "cast(id * 3 - 3 + id % 9 AS int) AS end")
    hits = spark.range(200_000).selectExpr("id", "'d' AS doc_id", "cast(id % 50000 AS int) - 4 AS page", "cast(null AS string) AS heading")
    odd = frame(spark, [(-1, None, 3, None), (-2, "d", None, None), (-3, "e", 3, None), (-4, "d", 3, "t"), (-5, "d", 1 << 30, None)], "id long, doc_id string, page int, heading string")
    began = time.perf_counter()
    got = {r.id: r.node_id for r in trees.section_for(hits.union(odd), nodes).select("id", "node_id").collect()}
    assert time.perf_counter() - began < 60  # the pairs are 4 milliards

    def want(page):
        covers = [(i * 3 - 3 < page, i * 3 - 3, i) for i in range(max(0, page // 3 - 4), page // 3 + 3) if i < n and i * 3 - 3 <= page <= i * 3 - 3 + i % 9]
        return f"n{max(covers)[2]}" if covers else ""

    assert len(got) == 200_005 and all(got[i] == want(i % 50000 - 4) for i in range(200_000))
    assert [got[-1], got[-2], got[-3], got[-5]] == ["", "", "", ""] and got[-4] == "n2"


def test_cosine_duplicates_miss_none(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= 0.97}
    rows = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], "id int, e array<double>")
    assert {(r.a, r.b) for r in statistics.cosine_duplicates(rows, "id", "e").collect()} == want


def test_cosine_duplicates_of_many(spark):
    """Blocks against all pairs, with vectors that take no part; 18 million pairs are no rows of a join."""
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(6000, 48)).astype("f4")
    v[1::500] = v[::500] * 3
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = {(f"k{min(i, j):05}", f"k{max(i, j):05}") for i, j in zip(*np.nonzero(u @ u.T >= 0.6)) if i != j}
    rows = [(f"k{i:05}", x.tolist()) for i, x in enumerate(v)]
    odd = [("z1", None), ("z2", [0.0] * 48), ("z3", [None, *[1.0] * 47]), ("z4", [float("nan")] * 48), ("z5", [float("inf")] * 48), (None, rows[0][1]), ("z6", [1.0, 1.0]), ("z7", [2.0, 2.0]), ("z7", [2.0, 2.0]), ("z8", [])]
    table = frame(spark, rows + odd, "id string, e array<float>")
    began = time.perf_counter()
    got = [(r.a, r.b) for r in statistics.cosine_duplicates(table, "id", "e", 0.6).collect()]
    assert time.perf_counter() - began < 25
    assert sorted(got) == sorted([*want, ("z6", "z7"), ("z6", "z7")])
    assert statistics.cosine_duplicates(table.limit(0), "id", "e").count() == 0


def test_rules(spark):
    files = frame(spark, [("QMR/a.pdf", "QMR", "a.pdf"), ("x/IR_2021.pdf", "x", "IR_2021.pdf"), ("x/y.pdf", "x", "y.pdf")], "path string, folder string, name string")
    types = frame(spark, [(1, "qmr", "folder", "qmr"), (2, "interim", "alias", "ir")], "ord int, key string, kind string, term string")
    assert {r.path: r.report_type for r in routing.report_type_of(files, types).collect()} == {"QMR/a.pdf": "qmr", "x/IR_2021.pdf": "interim", "x/y.pdf": None}
    names = frame(spark, [("a/b/r.pdf",), ("a/c/r.pdf",), ("z.pdf",)], "path string")
    assert {r.path: r.unique_name for r in routing.clashing_names(names).collect()} == {"a/b/r.pdf": "b_r.pdf", "a/c/r.pdf": "c_r.pdf", "z.pdf": "z.pdf"}


def test_layout(spark):
    spans = []
    for page in range(1, 5):
        spans += [("d", page, 50.0, 200.0, 840.0, 830.0, "ACME Report 2023", "f", 8.0, False), ("d", page, 280.0, 290.0, 20.0, 12.0, str(page), "f", 8.0, False), ("d", page, 50.0, 250.0, 780.0, 764.0, f"{page}. Chapter {'abcd'[page - 1]}", "b", 16.0, True)]
        spans += [("d", page, 50.0, 500.0, 740.0 - 14 * i, 730.0 - 14 * i, "plain body words that go on for a while in a long line " * 2, "f", 10.0, False) for i in range(10)]
    rows = frame(spark, spans, "doc_id string, page int, left double, right double, top double, bottom double, text string, font string, font_size double, bold boolean")
    sheets = rows.select("doc_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(850.0)})
    blocks = layout.blocks(layout.columns(layout.text_lines(rows), sheets))
    kinds = {(r.page, r.zone) for r in layout.furniture(blocks, sheets).collect()}
    assert kinds == {(p, z) for p in range(1, 5) for z in ("header", "footer")}
    docs = frame(spark, [("d", 10.0, False)], "doc_id string, body_size double, body_bold boolean")
    heads = layout.outline(layout.heading_candidates(blocks, docs))
    assert [(r.page, r.level, r.numbering) for r in heads.where("font_size > 12").orderBy("page").collect()] == [(p, 1, 1) for p in range(1, 5)]
    assert layout.body_paragraphs(blocks, sheets, docs).count() == 4 and layout.page_statistics(layout.text_lines(rows)).first().body_size == 10.0
    assert "Chapter" in layout.title(blocks, sheets, docs).first().title


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("lib")))
    files = frame(spark, [("Acme_AR2023.md", REPORT), ("Other_IR2022.md", "# Other\nNothing about profit margins, only sheep.\n" * 3)], "name string, text string")
    assert lib.index(files) == 2 and lib.index(files) == 0
    return lib


def test_library_search_and_reading(spark, library):
    hits = library.search_pages("profit 6610")
    assert hits[0]["name"] == "Acme_AR2023.md" and hits[0]["page"] == 1 and "**6,610**" in hits[0]["snippet"] and hits[0]["section"].startswith("Annual report")
    assert library.search_pages("sheep", "Acme_AR2023.md") == []
    docs = {d["name"]: d for d in library.browse()}
    assert docs["Acme_AR2023.md"]["period"] == "FY2023" and docs["Other_IR2022.md"]["report_type"] == "interim"
    assert [p["page"] for p in library.page_content("Acme_AR2023.md", "1-2,9")["pages"]] == [1, 2]
    assert library.structure("Acme_AR2023.md")["nodes"][0]["title"] == "Annual report"
    questions = frame(spark, [("q1", "operating profit", "6,610", [1]), ("q2", "sheep", "sheep", [])], "query_id string, query string, expected string, pages array<int>")
    row = library.evaluated(questions).first()
    assert row.judged == 2 and row.recall_5 == 1.0 and "6,610" in library.context(questions).where("query_id = 'q1'").first().context
    asked = questions.select("query_id", "query")
    assert library.search(asked, match="passage").count() >= 2


def test_library_tools(library):
    assert library.call_tool("calculate", '{"expression": "1 + 1"}')["result"]["result"] == "2"
    assert library.call_tool("nothing")["errorCode"] == "UNKNOWN_TOOL" and library.call_tool("get_document", {"name": "Acme_AR2024.md"})["errorCode"] == "INVALID_INPUT"
    assert library.call_tool("get_page_content", {"name": "Acme_AR2023.md", "pages": "x"})["success"] is False
    assert library.call_tool("calculate", "{broken")["success"] is False


def test_library_upsert_and_delete(spark, library):
    assert library.index(frame(spark, [("Other_IR2022.md", "# Other\nNow about goats.\n")], "name string, text string")) == 1
    assert library.search_pages("sheep") == [] and len(library.search_pages("goats")) == 1
    assert library.remove(["Other_IR2022.md"]) == {"Other_IR2022.md": "deleted"} and len(library.browse()) == 1


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_bytes("﻿# A\r\nx".encode())
    (tmp_path / "in" / "sub" / "b.markdown").write_text("b")
    (tmp_path / "in" / "sub" / "c.txt").write_text("c")
    got = readers.markdown_files(spark, str(tmp_path / "in")).collect()
    assert [(r.name, r.text) for r in got] == [("a.md", "# A\nx"), ("b.markdown", "b")]
    assert [r.path for r in readers.listing(spark, str(tmp_path / "in"), [".md", ".txt"]).collect()] == ["a.md", "sub/c.txt"]
    assert readers.listing(spark, str(tmp_path / "in"), exclude=["sub"]).count() == 1
    (tmp_path / "q.json").write_text('{"questions": [{"id": "a", "question": "x?", "doc": ["d"], "type": "t"}, {"question": " "}]}')
    (tmp_path / "q.jsonl").write_text('{"question": "one", "doc": "d"}\n{"question": "two", "expected": "2"}\n')
    (tmp_path / "q.csv").write_text("question,expected\n\"a, b\",1\n")
    (tmp_path / "q.txt").write_text("# no\nfirst\n\nsecond\n")
    a = readers.questions(spark, str(tmp_path / "q.json")).collect()
    assert len(a) == 1 and a[0].doc == ["d"] and a[0].extra == {"type": "t"}
    assert [r.id for r in readers.questions(spark, str(tmp_path / "q.jsonl")).collect()] == ["Q001", "Q002"]
    assert readers.questions(spark, str(tmp_path / "q.csv")).first().question == "a, b" and readers.questions(spark, str(tmp_path / "q.txt")).count() == 2
    row = frame(spark, [('{"data": {"items": [{"id": 1, "t": "x"}, {"id": 2}]}}',)], "j string")
    assert row.select(readers.field("j", "data.items[].id").alias("x")).first().x == ["1", "2"] and row.select(readers.first_field("j", ["no", "data.items[].t"]).alias("x")).first().x == "x"
    assert readers.with_page_marks("abcd", [(1, 0), (2, 2)]) == "<!-- page: 1 -->\nab<!-- page: 2 -->\ncd"
    rows = readers.extracted(spark, str(tmp_path / "in"), lambda b: [b.decode()[:1]] if b != b"c" else 1 / 0, "*.*").orderBy("path").collect()
    assert [r.error is None for r in rows] == [True, True, False]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text('{"ts": 1, "id": "a", "ok": true}\nbroken\n{"ts": 2, "id": "b", "ok": false}\n')
    assert [r.id for r in readers.log(spark, str(tmp_path / "log"), "ts long, id string, ok boolean").collect()] == ["b", "a"]


def test_watching_a_folder(spark, tmp_path):
    seen = []
    frame(spark, [("a", "one", 1), ("a", "two", 2), ("b", "x", 1)], "name string, text string, mtime long").write.parquet(str(tmp_path / "w"))
    go = lambda: watch.watch(spark, str(tmp_path / "w"), "name string, text string, mtime long", str(tmp_path / "c"), lambda b, n: seen.extend((r.name, r.text) for r in b.collect()), once=True).awaitTermination()
    go()
    assert sorted(seen) == [("a", "two"), ("b", "x")]
    frame(spark, [("c", "y", 3)], "name string, text string, mtime long").write.mode("append").parquet(str(tmp_path / "w"))
    go()
    assert sorted(seen)[-1] == ("c", "y") and len(seen) == 3
    old, new = frame(spark, [("p", 1, 1), ("q", 1, 1)], "path string, size int, mtime int"), frame(spark, [("p", 1, 2)], "path string, size int, mtime int")
    assert [r.path for r in watch.removed(old, new).collect()] == ["q"] and changes.change_set(old, new).count() == 2


def test_sql_functions(spark):
    register_sql(spark)
    assert "**profit**" in spark.sql("SELECT foliant_snippet('the profit of the year', 'profit') AS p").first().p
    assert spark.sql("SELECT count(*) AS n FROM foliant_passages('# A\n\ntext')").first().n == 1


def test_wasted_slots_of_many(spark):
    import numpy as np

    v, label, table = many(spark)
    like = v @ v.T >= 0.6
    began = time.perf_counter()
    ranked = table.select(F.col("label").alias("query_id"), F.col("id").alias("key"), F.col("id").alias("rank"))
    got = {r.query_id: r.wasted for r in statistics.wasted_slots(ranked, statistics.cosine_duplicates(table, "id", "e", 0.6)).collect()}
    assert time.perf_counter() - began < 30
    assert got == {k: int((np.tril(like & (label[:, None] == label), -1).any(axis=1) & (label == k)).sum()) for k in range(5)}


def test_duplication_of_many(spark):
    import numpy as np

    v, label, table = many(spark)
    like = (v @ v.T >= 0.6) & ~np.eye(len(v), dtype=bool)
    across = like & (label[:, None] != label)
    began = time.perf_counter()
    found = statistics.duplication(statistics.cosine_duplicates(table, "id", "e", 0.6), table.select(F.col("id").alias("key"), F.col("label").alias("doc_id")))
    got = {r.doc_id: (r.chunks, r.repeated, r.pairs, r.across) for r in found.collect()}
    assert time.perf_counter() - began < 30
    want = {}
    for k in range(5):
        own = label == k
        each = int(across[own].sum())
        want[k] = (int(own.sum()), int(like[own].any(axis=1).sum()), int((like[own] & own).sum()) // 2 + each, each)
    assert got == want


def many(spark):
    """6000 unit vectors, their labels, and a table of them."""
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 48)).astype("f4")
    v[1::400] = v[::400] * 2
    label = rng.integers(0, 5, 6000)
    table = frame(spark, [(i, int(label[i]), x.tolist()) for i, x in enumerate(v)], "id int, label int, e array<float>")
    u = v.astype(float)
    return u / np.linalg.norm(u, axis=1, keepdims=True), label, table
