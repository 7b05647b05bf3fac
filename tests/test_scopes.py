import re

import pytest

from foliant.functions.policy import Policy, PolicyError, as_question, suggested_questions
from foliant.library import Library
from foliant.operators import scopes

POLICY = {"report_types": {
    "mbrqbr": {"folders": ["mbr qbr"], "split": ["mbr", "qbr"]}, "mbr": {"aliases": ["MBR", "Monthly Report"], "filename": ["monthly"]}, "qbr": {"aliases": ["QBR", "Quarterly Review"], "quarter_as_half": True},
    "factbook": {"folders": ["fact book"], "aliases": ["Factbook"], "quarter_as_half": True},
}, "aliases": [["Acme", "ACM"], ["Hong Kong", "HK"]]}


def types(spark):
    return Policy.of(POLICY).tables(spark)


def test_types_of_documents(spark):
    rows = [
        ("2023/MBR_QBR/x_MBR_May.pdf", "mbr", "folder"), ("MBR-QBR pack/plain.pdf", "mbrqbr", "folder"), ("MBR QBR/MBR and QBR.md", "mbrqbr", "folder"), ("other/Fact Books/a_QBR.md", "factbook", "folder"), ("other/monthly figures.md", "mbr", "filename"),
        ("other/QBR.pdf", "qbr", "filename"), ("other/Quarterly Review 2.md", "qbr", "filename"), ("ambr/notes.md", None, None), ("notes.md", None, None), ("fact book.md", None, None), ("other/factbook.md", "factbook", "filename"),
    ]
    files = spark.createDataFrame([(p, p.rpartition("/")[2]) for p, _, _ in rows], "path string, name string")
    t = types(spark)
    assert {r.path: (r.report_type, r.report_type_source) for r in scopes.document_types(files, t["types"], t["splits"]).collect()} == {p: (k, s) for p, k, s in rows}
    for bad in ({"report_types": {"a": {"split": ["b"]}}}, {"report_types": {"a": {"split": "b"}}}, {"report_types": {"a": {"filename": [1]}}}):
        with pytest.raises(PolicyError):
            Policy.of(bad)


DOCS = [
    ("a23", "FY2023", "annual", "Acme Group Limited", "Group"), ("i23", "1H2023", "interim", "Acme Group Limited", "Group"), ("a24", "FY2024", "annual", "Acme Group Limited", "Hong Kong"), ("m23", "2023M05", "mbr", "Acme Group Limited", "Thailand"), ("p23", "FY2023", "mbrqbr", "Baker Ltd", "Hong Kong"),
    ("a22", "FY2022", "annual", "Baker Ltd", "Singapore"), ("none", None, None, None, None), ("q23", "2023Q3", "qbr", "友邦保险有限公司", "中国"),
]
QUESTIONS = {
    "plain": "How is business?", "year": "Profit in 2023?", "half": "Profit in the first half of 2023?", "whole": "Profit for the full year 2023, and six months?", "short": "Profit in FY22?", "lost": "Profit in 2001?",
    "type": "What does the MBR say on 2023?", "company": "Profit of Acme in 2023?", "alias": "Profit of ACM in 2023?", "region": "Profit in HK in 2023?", "chinese": "友邦保险2023年的利润？", "no such": "Profit of Zenith in 2023 in the Factbook?", "inside": "Macme and bakery in 2023?",
}


def brute(question, docs):
    """The rules one after the other, document by document."""
    year = lambda d: int(re.search(r"\d{4}", d[1])[0]) if d[1] else None
    years = {int(y) for y in re.findall(r"(?:19|20)\d{2}", question)} | {2000 + int(y) for y in re.findall(r"FY(\d{2})(?!\d)", question)}
    if not years:
        return "no_period", None
    allowed = years | {y + 1 for y in years}
    first = bool(re.search("first half|six months", question)) and "full year" not in question
    inside = [d for d in docs if year(d) is None or year(d) in allowed]
    strict = [d for d in inside if year(d) is None or d[2] == "interim" or d[2] not in ("annual", "interim", "quarterly", "other")]
    if first and any(d[2] == "interim" for d in strict):
        inside = strict
    if not any(year(d) for d in inside):
        return "no_match", None
    cover = {"mbr", "mbrqbr"} if "MBR" in question else {"factbook"} if "Factbook" in question else set()
    if any(d[2] in cover for d in inside):
        inside = [d for d in inside if d[2] in cover or d[2] is None]
    names = {"Acme Group Limited": ["acme", "acm"], "Baker Ltd": ["baker"], "友邦保险有限公司": ["友邦保险"], "Hong Kong": ["hong kong", "hk"], "Thailand": ["thailand"], "Singapore": ["singapore"], "中国": ["中国"], "Group": ["group"]}
    for at in (3, 4):
        said = lambda v: v is not None and any(re.search(rf"(?<![a-z0-9]){n}(?![a-z0-9])" if n.isascii() else n, question.lower()) for n in names[v])
        if any(said(d[at]) for d in inside):
            inside = [d for d in inside if said(d[at]) or d[at] is None or (at == 4 and d[at] == "Group")]
    return "routed", {d[0] for d in inside}


def test_scopes_are_those_of_the_rules(spark):
    t = types(spark)
    asked = spark.createDataFrame(list(QUESTIONS.items()), "query_id string, query string")
    docs = spark.createDataFrame(DOCS, "doc_id string, period string, report_type string, company string, region string")
    routes, found = scopes.routed(asked, docs, t["types"], t["splits"], t["aliases"])
    got: dict = {r.query_id: (r.reason, None if r.reason != "routed" else set()) for r in routes.collect()}
    for r in found.collect():
        got[r.query_id][1].add(r.doc_id)
    assert got == {k: brute(q, DOCS) for k, q in QUESTIONS.items()}
    bare = docs.select("doc_id", scopes.F.lit(None).cast("string").alias("period"), "report_type")
    assert {r.reason for r in scopes.routed(asked, bare)[0].collect()} == {"no_period", "no_meta"}
    routes, found = scopes.routed(asked, docs.where("false"))
    assert {r.reason for r in routes.collect()} == {"no_period", "no_meta"} and found.count() == 0


def test_library_joins_its_policy(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), policy=Policy.of(POLICY))
    files = spark.createDataFrame([
        ("packs/MBR QBR/Acme MBR 2023 May.md", "Acme MBR 2023 May.md", "# Pack\nprofit of the month", "Acme Group", None), ("fact book/Acme Q2 2023.md", "Acme Q2 2023.md", "# Facts\nprofit of the half", "Acme Group", None),
        ("Acme_AR2023.md", "Acme_AR2023.md", "# Report\nprofit of the year", "Acme Group", None), ("Baker_AR2021.md", "Baker_AR2021.md", "# Report\nprofit of Baker", "Baker", "FY2020"),
    ], "path string, name string, text string, company string, period string")
    assert lib.index(files) == 4
    docs = {d["name"]: (d["report_type"], d["period"], d["report_type_source"]) for d in lib.browse()}
    assert docs == {"Acme MBR 2023 May.md": ("mbr", "2023M05", "folder"), "Acme Q2 2023.md": ("factbook", "1H2023", "folder"), "Acme_AR2023.md": ("annual", "FY2023", None), "Baker_AR2021.md": ("annual", "FY2020", None)}
    asked = spark.createDataFrame([("m", "profit in the MBR of 2023"), ("b", "profit of Baker in 2020"), ("a", "profit")], "query_id string, query string")
    hits: dict = {}
    for r in lib.routed_search(asked).collect():
        hits.setdefault((r.query_id, r.reason), set()).add(r.name)
    assert hits == {("m", "routed"): {"Acme MBR 2023 May.md"}, ("b", "routed"): {"Baker_AR2021.md"}, ("a", "no_period"): set(docs)}


def test_suggestions_are_questions():
    good = {"1. What is it": "What is it?", "- 利润是多少": "利润是多少？", "2024 年利润是多少？": "2024 年利润是多少？", '"How much?"': "How much?", "Compare HK and Thailand.": "Compare HK and Thailand?", "(2) Who leads": "Who leads?"}
    for text, want in good.items():
        assert as_question(text) == want
    for bad in ("", None, "Below you find some", "好的", "?", "2024？", "What is it? And why?", "What is it,", "以下是：", "x" * 81 + "?", "Profit grew."):
        assert as_question(bad) is None, bad
    assert suggested_questions({"questions": ["What is it", "what is it?", {"question": "利润是多少"}, "prose"]}, ["利润是多少？"]) == ["What is it?"] and suggested_questions("Why?") == ["Why?"]
