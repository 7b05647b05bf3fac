import json

from foliant.__main__ import run


def test_commands(spark, tmp_path):
    folder, root = tmp_path / "in" / "QMR", str(tmp_path / "lib")
    folder.mkdir(parents=True)
    (folder / "Acme Q2 2023.md").write_text("# Results\nprofit of the quarter\n")
    (tmp_path / "in" / "Acme_AR2022.md").write_text("# Report\nprofit of the year\n\n## Risk\nsome risk\n")
    (tmp_path / "policy.json").write_text(json.dumps({"report_types": {"qmr": {"folders": ["QMR"], "aliases": ["QMR"], "quarter_as_half": True}}}))
    with_policy = [root, "--policy", str(tmp_path / "policy.json")]
    assert run(spark, [*with_policy, "index", str(tmp_path / "in")]) == {"indexed": 2} and run(spark, [*with_policy, "index", str(tmp_path / "in")]) == {"indexed": 0}
    meta = {d["name"]: (d["period"], d["report_type"], d["report_type_source"]) for d in run(spark, [root, "doc-meta"])}
    assert meta == {"Acme Q2 2023.md": ("1H2023", "qmr", "folder"), "Acme_AR2022.md": ("FY2022", "annual", None)}
    assert {h["name"] for h in run(spark, [root, "search", "profit 2022"])} == set(meta)
    assert [h["name"] for h in run(spark, [*with_policy, "search", "profit in the QMR of 2023", "--routed"])] == ["Acme Q2 2023.md"]
    assert run(spark, [root, "pages", "Acme_AR2022.md", "1"])["pages"][0]["markdown"].startswith("# Report") and run(spark, [root, "outline", "Acme_AR2022.md"])["nodes"][0]["nodes"][0]["title"] == "Risk"
    assert run(spark, [root, "calculate", "1 + 1"])["result"] == "2" and run(spark, [root, "remove", "Acme Q2 2023.md"]) == {"Acme Q2 2023.md": "deleted"} and len(run(spark, [root, "browse"])) == 1
