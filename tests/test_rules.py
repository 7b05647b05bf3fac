import pytest

from foliant.functions.policy import Policy, PolicyError, suggested_questions
from foliant.operators import routing, tree_rules as R, trees


def nodes(spark, rows):
    return spark.createDataFrame([("d", n, p, d, i, t, a, b) for i, (n, p, d, t, a, b) in enumerate(rows)], R.NODES)


def titles(frame):
    return [(r.title, r.start, r.end, r.depth) for r in frame.orderBy("ord").collect()]


def test_fake_and_continued_titles(spark):
    tree = nodes(spark, [("0", None, 1, "12.5%", 1, 1), ("1", None, 1, "Results", 2, 4), ("2", "1", 2, "1H26", 2, 2), ("3", "1", 2, "Profit", 3, 4), ("4", "1", 2, "Profit (continued)", 4, 6), ("5", None, 1, "x", 7, 9), ("6", None, 1, "Risk", 10, 12)])
    assert titles(R.drop_fake_titles(tree)) == [("Results", 1, 9, 1), ("Profit", 3, 9, 2), ("Risk", 10, 12, 1)]
    assert titles(R.drop_fake_titles(nodes(spark, [("0", None, 1, "5%", 1, 3)]))) == [("5%", 1, 3, 1)]


def test_fake_first_nodes(spark):
    tree = nodes(spark, [("0", None, 1, "Aims", 1, 9), ("1", "0", 2, "5%", 1, 3), ("2", "1", 3, "Deep", 2, 3), ("3", "0", 2, "Base", 4, 6), ("4", None, 1, "Aims (continued)", 10, 12), ("5", "4", 2, "Cost", 10, 12), ("6", "5", 3, "Cost (续)", 11, 12), ("7", "6", 4, "Debt", 12, 12)])
    assert titles(R.drop_fake_titles(tree)) == [("Aims", 1, 12, 1), ("Deep", 2, 3, 2), ("Base", 4, 12, 2), ("Cost", 10, 12, 2), ("Debt", 12, 12, 3)]


def test_containers(spark):
    forest = nodes(spark, [("0", None, 1, "一、概述", 1, 2), ("1", None, 1, "1. Scope", 3, 4), ("2", "1", 2, "Below", 4, 4), ("3", None, 1, "Free", 6, 7)])
    heads = spark.createDataFrame([("d", 3, "二、范围"), ("d", 1, "一、概述"), ("d", 6, "三、其他")], "doc_id string, page int, title string")
    got = R.with_containers(forest, heads)
    assert [(t, d) for t, _, _, d in titles(got)] == [("一、概述", 1), ("二、范围", 1), ("1. Scope", 1), ("Below", 2), ("Free", 1)]
    assert {r.title: r.parent_id for r in got.collect()}["Below"] == "0002"


def test_thinning(spark):
    tree = nodes(spark, [("0", None, 1, "A", 1, 9), ("1", "0", 2, "B", 1, 3), ("2", "1", 3, "C", 2, 3), ("3", "0", 2, "D", 4, 9)])
    own = spark.createDataFrame([("0", 50), ("1", 5), ("2", 4), ("3", 100)], "node_id string, own_tokens int")
    left = {r.node_id: r.folded for r in R.thinned(trees.with_path_ids(tree).join(own, "node_id"), 20).collect()}
    assert left == {"0": 0, "1": 1, "3": 0}


def test_optimising(spark):
    tree = nodes(spark, [("0", None, 1, "A", 1, 30), ("1", None, 1, "B", 31, 33)])
    halves = lambda leaves: leaves.selectExpr("doc_id", "node_id as parent_id", "explode(array(struct('first' as title, start as start, cast(start + 14 as int) as end), struct('second' as title, cast(start + 15 as int) as start, end as end))) as x").where("x.end > x.start").select("doc_id", "parent_id", "x.*")
    got = titles(R.optimized(tree, halves, rounds=1))
    assert got == [("A", 1, 30, 1), ("first", 1, 15, 2), ("second", 16, 30, 2), ("B", 31, 33, 1)] and R.optimized(tree).count() == 2


def test_bookmarks_and_grafts(spark):
    marks = spark.createDataFrame([("d", 0, 1, "One", 1), ("d", 1, 2, "Sub", 3), ("d", 2, 1, "Back", 2), ("d", 3, 1, "Two", 6)], "doc_id string, ord int, level int, title string, page int")
    counts = spark.createDataFrame([("d", 10)], "doc_id string, pages int")
    base = R.bookmark_nodes(marks, counts)
    assert titles(base) == [("One", 1, 5, 1), ("Sub", 3, 5, 2), ("Two", 6, 10, 1)]
    assert {r.title: r.parent_id for r in base.collect()} == {"One": None, "Sub": "0000", "Two": None}
    found = nodes(spark, [("0", None, 1, "Detail", 7, 8), ("1", None, 1, "Two", 6, 9), ("2", None, 1, "Wide", 4, 9)])
    assert titles(R.graft(base, found)) == [("One", 1, 5, 1), ("Sub", 3, 5, 2), ("Two", 6, 10, 1), ("Detail", 7, 8, 2)]


def test_policy(spark):
    p = Policy.of({"weights": [{"pattern": "annual", "weight": 3, "label": "yearly"}], "exclude": ["draft"], "aliases": [["VONB", "value of new business"]], "periods": [r"FY\s?(\d{2})"], "report_types": {"qmr": {"folders": ["QMR"], "quarter_as_half": True}}, "corpora": {"hk": {"exclude": ["old"]}}})
    assert p.for_path("hk/x").exclude == ["draft", "old"] and p.for_path("sg/x") is p and p.periods_in("FY24 against 2023") == ["2023", "2024", "FY24"] and p.halves == {"qmr"}
    t = p.tables(spark)
    paths = spark.createDataFrame([("annual/a",), ("draft/b",), ("drafting/c",)], "path string")
    assert {r.path: r.weight for r in routing.weighted_paths(paths, t["weights"]).collect()} == {"annual/a": 3, "draft/b": 0, "drafting/c": 0}
    assert {r.path for r in routing.without_excluded(paths, t["excludes"]).collect()} == {"annual/a", "drafting/c"}
    none = Policy.of({}).tables(spark)
    assert routing.without_excluded(paths, none["excludes"]).count() == 3
    for bad in ({"weights": [{"weight": 1}]}, {"exclude": "x"}, {"periods": ["("]}, {"what": 1}, []):
        with pytest.raises(PolicyError):
            Policy.of(bad)


def test_suggestions():
    assert suggested_questions({"questions": ["1. What is it", "what is it?", {"question": "利润是多少"}, "x"]}) == ["What is it?", "利润是多少？"]
    assert suggested_questions(["How much?"], ["how much"]) == [] and suggested_questions("no") == []


def test_bookmark_tiers(spark):
    rows = [("flat", [(1, f"Topic {c} of all") for c in "abcdefg"]), ("deep", [(1 + i % 2, w) for i, w in enumerate("aims base cost debt ends fees gain".split())]), ("pages", [(1, f"Page {i}") for i in range(8)]),
            ("files", [(1, f"doc {i}-{i}") for i in range(8)]), ("chapters", [(1, f"Chapter {i}") for i in range(8)]), ("few", [(1, "a"), (1, "b")]), ("same", [(1, "Note")] * 8)]
    marks = spark.createDataFrame([(d, i, level, t, i + 1) for d, found in rows for i, (level, t) in enumerate(found)], "doc_id string, ord int, level int, title string, page int")
    counts = marks.select("doc_id").distinct().selectExpr("doc_id", "20 as pages")
    got = {r.doc_id: r.tier for r in R.bookmark_tier(marks, counts).collect()}
    assert got == {"flat": "SKELETON", "deep": "FULL", "pages": "IGNORE", "files": "IGNORE", "chapters": "SKELETON", "few": "IGNORE", "same": "IGNORE"}


def test_paths_of_deep_trees(spark):
    deep = nodes(spark, [(str(i), str(i - 1) if i else None, i + 1, f"t{i}", 1, 2) for i in range(24)])
    assert max(len(r.path_ids) for r in trees.with_path_ids(deep).collect()) == 24


def test_page_thinning(spark):
    tree = trees.with_path_ids(nodes(spark, [("0", None, 1, "Aims", 1, 9), ("1", "0", 2, "Base", 2, 2), ("2", "1", 3, "Cost", 2, 2), ("3", "0", 2, "Debt", 3, 9)]))
    assert {r.node_id for r in trees.page_thinned(tree).collect()} == {"0", "1", "3"}
    assert {(r.node_id, r.end) for r in trees.page_thinned(tree, 3, 20).collect()} == {("0", 9)}


def test_own_text_between_titles(spark):
    tree = nodes(spark, [("0", None, 1, "First part", 1, 2), ("1", "0", 2, "Its  detail", 2, 2), ("2", None, 1, "Not there", 2, 3), ("3", None, 1, "Last (one)", 3, 4)])
    pages = spark.createDataFrame([("d", 1, "intro First\npart begins"), ("d", 2, "goes on. its detail here"), ("d", 3, "more LAST (ONE) end"), ("d", 4, "tail")], "doc_id string, page int, markdown string")
    got = {r.node_id: r.text for r in trees.own_text_at_titles(tree, pages).collect()}
    assert got == {"0": "First\npart begins\ngoes on. ".strip(), "1": "", "2": "goes on. its detail here\nmore", "3": "LAST (ONE) end\ntail"}


def test_outline_parts():
    from foliant.library import outline_parts, schema_of

    leaf = lambda i: {"node_id": f"{i:04d}", "title": "t" * 20, "start": i, "end": i}
    big = {**leaf(0), "nodes": [leaf(i) for i in range(1, 30)]}
    parts = outline_parts([big, leaf(30), leaf(31)], 500)
    names = [n["node_id"] for p in parts for top in p for n in [top, *top.get("nodes", [])]]
    assert len(parts) > 4 and set(names) == {f"{i:04d}" for i in range(32)} and len(names) == 31 + names.count("0000")
    assert all(len(str(p)) < 700 for p in parts) and outline_parts([leaf(1)], 500) == [[leaf(1)]] and outline_parts([], 500) == [[]]

    def tool(name: str, top_k: int = 5, names: list[str] | None = None) -> None: ...

    assert schema_of(tool) == {"type": "object", "properties": {"name": {"type": "string"}, "top_k": {"type": "integer", "default": 5}, "names": {"type": "array"}}, "required": ["name"]}


def test_citations_and_logs(spark, tmp_path):
    from foliant.operators import citations
    from foliant.sources import logs

    text = 'A <cite doc="Two" page="4-5" block="b1"/> b <doc=One.pdf;page=3> c <doc=One.pdf;page=3> <cite page="0" doc="x"/> <cite doc="Two" page="7">in</cite>'
    frame = spark.createDataFrame([(1, text), (2, None), (3, "none")], "answer_id int, text string")
    docs = spark.createDataFrame([("d1", "One.pdf"), ("d2", "Two"), ("d3", "Two")], "doc_id string, name string")
    got = [(r.answer_id, r["index"], r.document, r.page, r.block_id, r.doc_id, r.candidates) for r in citations.resolved(frame, docs).orderBy("answer_id", "index").collect()]
    assert got == [(1, 1, "One.pdf", 3, None, "d1", None), (1, 2, "Two", 4, "b1", None, ["d2", "d3"]), (1, 3, "Two", 7, None, None, ["d2", "d3"])]
    links = [r[0] for r in frame.orderBy("answer_id").select(citations.linked("text")).collect()]
    assert links == ['A [[2]](#citation-02) b [[1]](#citation-01) c [[1]](#citation-01) <cite page="0" doc="x"/> [[3]](#citation-03)in', None, "none"]

    path, schema = f"file://{tmp_path}/log", "id int, ts int"
    assert logs.read(spark, path, schema).count() == 0
    for i in range(5):
        logs.append(spark.createDataFrame([(i, i)], schema), path, most_bytes=30, kept=2)
    assert 1 <= logs.read(spark, path, schema).count() < 5 and logs.read(spark, path, schema, old=2).count() == len({r.id for r in logs.read(spark, path, schema, old=2).collect()}) >= 3
