import random

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import assembly, detectors, furniture, gutters, layout, pages, tries

LINE = "doc_id string, page int, left double, right double, top double, bottom double, font_size double, text string"
BLOCK = "doc_id string, page int, column int, block int, left double, right double, top double, bottom double, n_lines long, text string, font_size double, bold double"


def reading(spark, boxes, width=600.0):
    """The texts of one page in reading order."""
    rows = spark.createDataFrame([("d", 1, *b[:4], 10.0, b[4]) for b in boxes], LINE)
    found = gutters.columns(rows, spark.createDataFrame([("d", 1, width)], "doc_id string, page int, width double"))
    return [r.text for r in found.orderBy("column", F.desc("top"), "left").collect()]


def column(left, right, top, n, name, pitch=14.0):
    return [(left, right, top - pitch * i, top - pitch * i - 10, f"{name}{i}") for i in range(n)]


def test_columns_in_reading_order(spark):
    title, foot = [(50.0, 550.0, 800.0, 785.0, "title")], [(50.0, 550.0, 60.0, 50.0, "foot")]
    two = column(50.0, 280.0, 760.0, 20, "a") + column(310.0, 550.0, 760.0, 20, "b")
    shuffled = random.Random(1).sample(title + two + foot, len(two) + 2)
    names = lambda boxes: [b[4] for b in boxes]
    assert reading(spark, shuffled) == names(title + two + foot)
    # three columns, of which the last is parted in two: columns within a column
    nested = column(50.0, 220.0, 700.0, 30, "a") + column(250.0, 400.0, 700.0, 12, "b") + column(250.0, 400.0, 500.0, 10, "c") + column(425.0, 550.0, 700.0, 30, "d")
    assert reading(spark, random.Random(2).sample(nested, len(nested))) == names(nested)
    # bands of two and of three columns, without a line that crosses them
    bands = column(50.0, 280.0, 800.0, 12, "a") + column(310.0, 550.0, 800.0, 12, "b") + column(50.0, 190.0, 560.0, 12, "c") + column(220.0, 370.0, 560.0, 12, "d") + column(400.0, 550.0, 560.0, 12, "e")
    assert reading(spark, random.Random(3).sample(bands, len(bands))) == names(bands)
    # a title over two columns in the middle of the page parts them
    middle = column(50.0, 280.0, 800.0, 9, "a") + column(310.0, 550.0, 800.0, 9, "b") + [(50.0, 550.0, 660.0, 650.0, "rule")] + column(50.0, 280.0, 630.0, 9, "c") + column(310.0, 550.0, 630.0, 9, "d")
    assert reading(spark, random.Random(4).sample(middle, len(middle))) == names(middle)


def test_what_is_no_column(spark):
    one = column(50.0, 550.0, 800.0, 30, "a")
    assert reading(spark, one[::-1]) == [b[4] for b in one]
    # a gap in one line, margin figures and a narrow strip make no column
    words = [x for i in range(20) for x in ((50.0, 290.0 - i * 3, 800.0 - 14 * i, 790.0 - 14 * i, f"l{i}"), (296.0 - i * 3, 550.0, 800.0 - 14 * i, 790.0 - 14 * i, f"r{i}"))]
    assert reading(spark, words) == [b[4] for b in words]
    figures = column(30.0, 40.0, 800.0, 20, "n") + column(60.0, 550.0, 800.0, 20, "a")
    assert reading(spark, figures) == [x for i in range(20) for x in (f"n{i}", f"a{i}")]
    assert reading(spark, [(50.0, 100.0, 800.0, 790.0, "alone")]) == ["alone"]
    same = [(50.0, 100.0, 800.0, 790.0, "x")] * 5
    assert reading(spark, same) == ["x"] * 5


def test_stretches_are_those_that_few_cross():
    rng = np.random.default_rng(3)
    for _ in range(50):
        low = rng.integers(0, 60, 12).astype(float)
        high = low + rng.integers(1, 15, 12)
        for most in (0, 1, 3):
            got = list(gutters.stretches(low, high, most))
            open_ = [x + 0.5 for x in range(int(low.min()), int(high.max())) if ((low < x + 0.5) & (high > x + 0.5)).sum() <= most]
            assert sorted({x for a, b, _ in got for x in open_ if a < x < b}) == sorted(open_)
            assert all(c <= most for _, _, c in got)


def test_furniture_walks_and_recurs(spark):
    rows = []
    long = "Net income rose in every market in which the group is present and the outlook for next year stays good although costs went up. " * 3
    for page in range(1, 9):
        rows += [("d", page, 0, 0, 60.0, 300.0, 830.0, 820.0, 1, f"Group report 2023 part {'ab'[page % 2]}", 8.0, 0.0), ("d", page, 0, 1, 60.0, 500.0, 800.0, 200.0, 30, long + str(page), 10.0, 0.0)]
        rows += [("d", page, 0, 2, 60.0 if page % 2 else 500.0, 520.0, 40.0, 30.0, 1, f"Page {page}", 8.0, 0.0)]
    rows += [("d", 9, 0, 0, 60.0, 300.0, 836.0, 826.0, 1, "Group report 2023, part", 8.0, 0.0), ("d", 9, 0, 1, 60.0, 500.0, 760.0, 300.0, 20, long, 10.0, 0.0)]
    rows += [("d", 20, 0, 0, 60.0, 300.0, 845.0, 835.0, 1, "Group report 2023 part c", 8.0, 0.0), ("d", 20, 0, 1, 60.0, 300.0, 822.0, 812.0, 1, "A heading of its own", 14.0, 1.0)]
    rows += [("one", 1, 0, 0, 60.0, 300.0, 830.0, 820.0, 1, "Alone", 8.0, 0.0)]
    blocks = spark.createDataFrame(rows, BLOCK)
    sheets = blocks.select("doc_id", "page").distinct().withColumn("height", F.lit(850.0))
    got = {(r.doc_id, r.page, r.block): r.zone for r in furniture.furniture(blocks, sheets).collect()}
    assert {k for k, z in got.items() if z == "header"} == {("d", p, 0) for p in [*range(1, 10), 20]}
    assert {k for k, z in got.items() if z == "footer"} == {("d", p, 2) for p in range(1, 9)}
    candidates = furniture.edge_candidates(blocks, sheets)
    assert ("d", 20, 0) not in {(r.doc_id, r.page, r.block) for r in furniture.matched(candidates).collect()}  # the last pass finds it


def test_long_texts_without_a_letter_in_common_are_no_furniture(spark):
    """Blocks of over 320 characters at one place: alike only if they are."""
    rows = [("d", p, 0, 0, 60.0, 500.0, 840.0, 800.0, 3, (chr(96 + p) * 165 + " ") * 2, 8.0, 0.0) for p in (1, 2)]
    rows += [("e", p, 0, 0, 60.0, 500.0, 840.0, 800.0, 1, f"{chr(96 + p) * 90}", 8.0, 0.0) for p in (1, 2)]
    blocks = spark.createDataFrame(rows, BLOCK)
    sheets = blocks.select("doc_id", "page").distinct().withColumn("height", F.lit(850.0))
    assert furniture.furniture(blocks, sheets).count() == 0
    a, b = "x" * 400, "x" * 330 + "y" * 70
    pairs = spark.createDataFrame([(a, b), (a, "z" * 400), ("ab", "ab"), ("", ""), ("y" * 325, "z" * 325)], "a string, b string")
    assert [r[0] for r in pairs.select(furniture.closer(F.col("a"), F.col("b"), 5)).collect()] == [True, False, False, False, False]


def page_of(rows, doc="d", page=1):
    """Blocks one below the other: ``(text, size, bold)`` with a gap before headings and none before body."""
    out, y = [], 790.0
    for i, (text, size, bold, *more) in enumerate(rows):
        gap, lines = (more + [12.0, 1])[:2] if more else (12.0, 1)
        y -= gap
        out.append((doc, page, 0, i, 60.0, 60.0 + min(480.0, len(text) * size / 2), y, y - size * lines, lines, text, size, float(bold)))
        y -= size * lines
    return out


def detect(spark, rows, keep=detectors.headings, body=10.0, bold_body=False, pages=None):
    blocks = spark.createDataFrame(rows, BLOCK)
    sheets = blocks.select("doc_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(850.0)})
    docs = blocks.select("doc_id").distinct().withColumns({"body_size": F.lit(body), "body_bold": F.lit(bold_body)})
    return keep(blocks, sheets, docs)


BODY = ("these are plain words of the body that go on and on in one line", 10.0, False, 2.0, 3)


DETECTED = [
    ("Chapter 4 Markets", (10.0, False), "chapter", [4]), ("Part IV", (10.0, False), "chapter", [4]), ("第三章 市场", (10.0, False), "chapter", [3]), ("chapters of a book", (10.0, False), None, None),
    ("Appendix C Tables", (10.0, False), "appendix", [3]), ("Annex 2", (10.0, False), "appendix", [2]), ("appendices are below", (10.0, False), None, None),
    ("Abstract", (10.0, False), "abstract", []), ("Abstract words", (10.0, False), None, None), ("Introduction", (10.0, False), "introduction", []), ("Introduction of cars", (10.0, False), None, None),
    ("References", (10.0, False), "references", []), ("References to it", (10.0, False), None, None), ("Conclusion", (10.0, True), "keyword", []), ("Conclusion", (10.0, False, 1.0, 1), None, None),
    ("Section 3.2 Scope", (10.0, True), "labelled", [3, 2]), ("Section 3.2 says so", (10.0, False, 1.0, 1), None, None), ("2.1.3 Cash flow", (10.0, True), "numbered", [2, 1, 3]), ("2.1 of it", (10.0, True, 1.0, 1), None, None),
    ("2.1.3 Cash flow", (10.0, False, 1.0, 1), None, None), ("25 Percent", (10.0, True, 1.0, 1), None, None), ("3. Risk", (12.0, False), "numbered", [3]), ("i. First", (10.0, True), "roman", [1]), ("a) First", (10.0, True), "letter", [1]),
    ("一、概述", (10.0, True), "cjk", [1]), ("（一） 概述", (10.0, True), "cjk", [1]), ("Ａ 概述", (10.0, False, 1.0, 1), None, None),
    ("Outlook for markets", (14.0, False), "plain", []), ("Outlook for markets", (10.0, False, 1.0, 1), None, None), ("OUTLOOK FOR MARKETS", (10.0, False), "plain", []), ("It ends with a stop.", (14.0, False), None, None),
    ("Table 3 Assets", (14.0, True), None, None), ("Contents ......... 12", (14.0, True), None, None), ("12345", (14.0, True), None, None), ("words, then more,", (14.0, True), None, None),
]


def test_each_detector(spark):
    """What each form is read as, and what is like it and is none."""
    rows = [x for i, (text, style, _, _) in enumerate(DETECTED) for x in page_of([BODY, (text, *style), BODY], doc=str(i), page=9)]
    found = {r.doc_id: (r.kind, list(r.numbers)) for r in detect(spark, rows, detectors.candidates).collect()}
    for i, (text, _, kind, numbers) in enumerate(DETECTED):
        assert found.get(str(i)) == (None if kind is None else (kind, numbers)), text


def test_gates_of_place_and_size(spark):
    big = ("A large title", 20.0, True)
    rows = page_of([BODY, big, BODY])
    at = lambda **k: [tuple(k.get(n, v) for n, v in zip("doc_id page column block left right top bottom n_lines text font_size bold".split(), r)) if r[9] == big[0] else r for r in rows]
    assert detect(spark, at()).count() == 1
    for bad in ({"top": 849.0, "bottom": 830.0}, {"left": 520.0}, {"n_lines": 5}, {"text": "word " * 50}):
        assert detect(spark, at(**bad)).count() == 0, bad
    assert detect(spark, at(n_lines=3)).count() == 1 and detect(spark, at(n_lines=3, font_size=11.0)).count() == 0


def test_filter_looks_at_series(spark):
    crowd = page_of([(f"Heading {i} of many", 14.0, True) for i in range(20)])
    assert detect(spark, crowd, detectors.candidates).count() == 20 and detect(spark, crowd).count() == 0 and detect(spark, crowd[:19]).count() == 19
    listed = page_of([(f"{i}. Point", 10.0, True) for i in range(1, 6)] + [("1.1 Inner", 10.0, True)], page=9)
    assert [r.text for r in detect(spark, listed).collect()] == ["1.1 Inner"] and detect(spark, listed[:4]).count() == 4
    far = page_of([("7. Late", 12.0, True)], page=2) + page_of([("6. Fits", 12.0, True)], page=2, doc="e")
    assert [r.text for r in detect(spark, far).collect()] == ["6. Fits"]
    roman = page_of([("i. One", 10.0, True), ("ii. Two", 10.0, True), ("iv. Four", 10.0, True), ("v. Five", 10.0, True)], page=5) + page_of([("ii. Starts late", 10.0, True), ("iii. On", 10.0, True)], doc="e") + page_of([("a) One", 10.0, True), ("b) Two", 10.0, True)], page=6) + page_of([("a) Again", 10.0, True), ("c) Gap", 10.0, True)], page=7)
    assert sorted(r.text for r in detect(spark, roman).collect()) == ["a) Again", "a) One", "b) Two", "i. One", "ii. Two"]


def tree(spark, pages_, counts=None, **more):
    rows = [x for p, page in enumerate(pages_, 1) for x in page_of(page, page=p)]
    found = detect(spark, rows, **more)
    n = spark.createDataFrame([("d", counts or len(pages_))], "doc_id string, pages int")
    return {r.ord: r for r in assembly.assembled(found, n).collect()}, n


def nested(nodes):
    return [(r.depth, r.title, r.page, r.end) for _, r in sorted(nodes.items())]


def test_golden_outline_by_numbers(spark):
    body = BODY
    pages_ = [
        [("Chapter 1 Business", 18.0, True), body, ("1.1 Market", 12.0, True), body, ("1.2 Products", 12.0, True), body],
        [body, ("1.2.1 Life", 11.0, True), body],
        [("Chapter 2 Results", 18.0, True), body, ("2.1 Income", 12.0, True), body],
        [body, ("2.2 Costs", 12.0, True), body, ("Notes on costs", 11.0, True), body],
        [("Appendix A Tables", 18.0, True), body],
    ]
    nodes, counts = tree(spark, pages_)
    assert nested(nodes) == [
        (1, "Chapter 1 Business", 1, 2), (2, "1.1 Market", 1, 1), (2, "1.2 Products", 1, 2), (3, "1.2.1 Life", 2, 2),
        (1, "Chapter 2 Results", 3, 4), (2, "2.1 Income", 3, 4), (2, "2.2 Costs", 4, 4), (3, "Notes on costs", 4, 4), (1, "Appendix A Tables", 5, 5),
    ]
    assert [n.parent_ord for _, n in sorted(nodes.items())] == [None, 0, 0, 2, None, 4, 4, 6, None]


def test_golden_outline_by_styles(spark):
    page = lambda a, b, c: [(a, 20.0, True), BODY, (b, 14.0, True), BODY, (c, 14.4, True), BODY, ("SMALL CAPITALS " + b.upper(), 10.0, False), BODY]
    nodes, _ = tree(spark, [page("Review", "Sales", "Stock"), page("Risk", "Credit", "Market"), page("People", "Pay", "Pensions")])
    assert [d for d, *_ in nested(nodes)] == [1, 2, 2, 3] * 3


def test_refused_headings(spark):
    body = BODY
    pages_ = [
        [("1. One", 14.0, True), body], [("2. Two", 14.0, True), body, ("9. Figure of a table", 14.0, True), body], [("3. Three", 14.0, True), body, ("3. Small print", 10.0, True), body],
        [("2. Two again", 14.0, True), body, ("4. Four", 14.0, True), body],
    ]
    nodes, _ = tree(spark, pages_)
    assert [t for _, t, *_ in nested(nodes)] == ["1. One", "2. Two", "3. Three", "4. Four"]
    echo, _ = tree(spark, [[("Chapter 1 Markets", 18.0, True), body], [("Markets", 12.0, True), body], [("Chapter 2 Risk", 18.0, True), body]])
    assert [t for _, t, *_ in nested(echo)] == ["Chapter 1 Markets", "Chapter 2 Risk"]


def test_gate_of_outlines(spark):
    counts = spark.createDataFrame([("few", 9), ("gap", 20), ("three", 6), ("five", 90), ("none", 3)], "doc_id string, pages int")
    top = {"few": [1, 5], "gap": [1, 2, 3], "three": [1, 3, 5], "five": [1, 2, 3, 4, 5]}
    nodes = spark.createDataFrame([(d, i, None, 1, "t", p, p) for d, ps in top.items() for i, p in enumerate(ps)], "doc_id string, ord int, parent_ord int, depth int, title string, page int, end int")
    assert {r.doc_id: r.valid for r in assembly.valid(nodes, counts).collect()} == {"few": False, "gap": False, "three": True, "five": True, "none": False}


def test_cliques_share_what_all_may_share():
    K = assembly.Kind
    a, b, c = K("plain", 0, 1, 14.0, True, False), K("plain", 0, 2, 14.4, True, False), K("plain", 0, 3, 14.8, True, False)
    assert a.may_share(b) and b.may_share(c) and not a.may_share(c)
    assert [set(x) for x in assembly.cliques({a: 5, b: 3, c: 1})] == [{a, b}, {c}] and [set(x) for x in assembly.cliques({a: 1, b: 2, c: 9})] == [{c, b}, {a}]
    one, two = K("numbered", 1, 4, 12.0, True, False), K("numbered", 2, 4, 12.0, True, False)
    assert not one.may_share(two) and assembly.levels({one: 3, two: 3, a: 1}) == {a: 0, one: 1, two: 2}


def brute(texts, terms):
    import re

    cut = lambda t: re.findall(r"[^\W_]+|[^\s\w]|_", t.lower())
    out = set()
    for doc, text in texts:
        w = cut(text or "")
        for term_id, term in terms:
            t = cut(term or "")
            out |= {(doc, term_id, i, len(t)) for i in range(len(w) - len(t) + 1) if t and w[i : i + len(t)] == t}
    return out


def test_terms_by_automaton_and_by_join(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "Ab", "x-y", "é", "日本", "1"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, ""), (62, "a " * 300)]
    terms = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(80)] + [(80, ""), (81, None), (82, "a a a"), (83, "a a a")]
    frames = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, term string"), spark.createDataFrame([(*t, 1) for t in terms], "term_id long, term string, doc_id int")
    want = brute(texts, terms)
    for most in (tries.MOST_TOKENS, 0):
        got = tries.occurrences(*frames, most_tokens=most).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        assert tries.occurrences(frames[0], frames[1].where("false"), most_tokens=most).count() == 0 == tries.occurrences(frames[0].where("false"), frames[1], most_tokens=most).count()


def test_hundred_thousand_terms_in_one_pass(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    terms = {i: [word() for _ in range(rng.randrange(1, 4))] for i in range(100_000)}
    automaton = tries.Automaton(sorted(terms.items()))
    by_words = {}
    for i, t in terms.items():
        by_words.setdefault(tuple(t), []).append(i)
    text = [word() for _ in range(20_000)]
    want = {(i, s, n) for n in (1, 2, 3) for s in range(len(text) - n + 1) for i in by_words.get(tuple(text[s : s + n]), ())}
    found = list(automaton.find(text))
    assert len(found) == len(want) and set(found) == want


def test_page_numbers_that_are_large_or_none(spark):
    docs = spark.createDataFrame([("a", "<!-- page: 30000 -->\nlast\n"), ("b", "<!-- page: 1000000000 -->\ntext\n<!-- page: 2 -->\nmore"), ("c", "<!-- page: 0000000000000000000002 -->x")], "doc_id string, text string")
    got = {}
    for r in pages.pages(docs).where("markdown != ''").collect():
        got.setdefault(r.doc_id, []).append((r.page, r.markdown))
    assert got == {"a": [(30000, "last")], "b": [(2, "text\nmore")], "c": [(2, "x")]}


def test_whole_chain(spark):
    """Spans to an outline: lines, columns, blocks, furniture, statistics, detectors, assembly."""
    spans = []
    for page in range(1, 7):
        spans += [("d", page, 50.0, 200.0, 848.0, 840.0, "ACME Report 2023", "f", 8.0, False), ("d", page, 280.0, 290.0, 20.0, 12.0, str(page), "f", 8.0, False), ("d", page, 50.0, 300.0, 780.0, 764.0, f"{page}. Chapter {'abcdef'[page - 1].upper()}", "b", 16.0, True)]
        for x in (50.0, 310.0):
            spans += [("d", page, x, x + 230.0, 740.0 - 14 * i, 730.0 - 14 * i, "plain words that go on in a line of a column", "f", 10.0, False) for i in range(20)]
    rows = spark.createDataFrame(spans, "doc_id string, page int, left double, right double, top double, bottom double, text string, font string, font_size double, bold boolean")
    sheets = rows.select("doc_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(850.0)})
    blocks = layout.blocks(layout.columns(layout.text_lines(rows), sheets))
    kept = blocks.join(layout.furniture(blocks, sheets), ["doc_id", "page", "column", "block"], "left_anti")
    docs = spark.createDataFrame([("d", 10.0, False, 6)], "doc_id string, body_size double, body_bold boolean, pages int")
    nodes = assembly.outline(detectors.headings(kept, sheets, docs), docs).orderBy("ord").collect()
    assert [(n.depth, n.title, n.page, n.end) for n in nodes] == [(1, f"{p}. Chapter {'ABCDEF'[p - 1]}", p, p) for p in range(1, 7)]
