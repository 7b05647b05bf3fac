import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from foliant.operators import joins, routing, summaries, tree_rules, trees
from foliant.sources import readers
from foliant.sources.store import TABLES, Store

NODES = "doc_id string, node_id string, parent_id string, depth int, ord int, title string, start int, end int"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# as-of join


@pytest.mark.parametrize("width", [None, 1.0, 7.5, 1000.0])
def test_as_of_is_the_last_at_or_before(spark, width):
    rng = random.Random(1)
    left = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([*range(60), None]), i) for i in range(300)]
    right = [(rng.choice(["a", "hot", "c", None]), rng.choice([*range(0, 60, 3), None]), rng.choice([None, *range(100)])) for _ in range(80)]
    got = joins.as_of(frame(spark, left, "k string, at int, i int"), frame(spark, right, "k string, at int, v int"), ["k"], "at", "v", width)
    by = {}
    for k, at, v in right:
        if at is not None and v is not None:
            by.setdefault(k, {}).setdefault(at, []).append(v)
    want = {}
    for k, at, i in left:
        places = sorted(by.get(k, {}))
        n = 0 if at is None else bisect_right(places, at)
        want[i] = max(by[k][places[n - 1]]) if n else None
    assert {r.i: r.v for r in got.collect()} == want and got.columns == ["k", "at", "i", "v"]
    assert joins.as_of(frame(spark, left, "k string, at int, i int").where("false"), frame(spark, right, "k string, at int, v int"), ["k"], "at", "v", width).count() == 0


# versions of a store


def tables(spark, names, word):
    docs = frame(spark, [(n, n + ".md", "completed", word) for n in names], "doc_id string, name string, status string, word string")
    rest = {t: frame(spark, [(n, word, i) for n in names for i in range(3)], "doc_id string, term string, i int") for t in TABLES if t != "documents"}
    return {"documents": docs, **rest}


def state(store):
    return {t: sorted((r["doc_id"], r["word"] if t == "documents" else r["term"]) for r in store.table(t).collect()) for t in TABLES}


def whole(names, word):
    return {t: sorted((n, word) for n in names for _ in range(1 if t == "documents" else 3)) for t in TABLES}


def test_upsert_is_all_or_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    assert store.table("pages") is None and store.documents() is None and store.versions() == []
    names = [f"d{i}" for i in range(12)]
    assert store.upsert(tables(spark, names, "old")) == 1 and state(store) == whole(names, "old")
    for at in range(len(TABLES) + 1):
        calls, write, put = [], Store._write, type(store.folder).put

        def broken(self, *args, at=at, calls=calls, write=write):
            write(self, *args)
            calls.append(args[0])
            if len(calls) > at:
                raise RuntimeError("lost")

        with monkeypatch.context() as m:
            m.setattr(Store, "_write", broken)
            if at == len(TABLES):
                m.setattr(type(store.folder), "put", lambda *a: 1 / 0)
            with pytest.raises((RuntimeError, ZeroDivisionError)):
                store.upsert(tables(spark, names[:5], "new"))
        assert state(store) == whole(names, "old") and store.versions() == [1]
    assert store.upsert(tables(spark, names[:5], "new")) == 2
    got = state(store)
    assert {t: [x for x in got[t] if x[0] in names[:5]] for t in TABLES} == whole(names[:5], "new") and {t: [x for x in got[t] if x[0] not in names[:5]] for t in TABLES} == whole(names[5:], "old")


def test_readers_hold_a_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(tables(spark, ["a", "b"], "one"))
    reader = store.held()
    store.upsert(tables(spark, ["b", "c"], "two"))
    assert store.delete(["a"]) == {"a": "deleted"} and store.delete(["x"]) == {"x": "not found"} and store.versions() == [1, 2, 3]
    assert state(reader) == whole(["a", "b"], "one") and state(store) == whole(["b", "c"], "two")
    assert [r.term for r in store.of_document("postings", "c").collect()] == ["two"] * 3 and store.of_document("postings", "a") is None or store.of_document("postings", "a").count() == 0
    other = Store(spark, store.root)
    with pytest.raises(FileExistsError):  # two writers began from one version
        other.folder.put("_versions/00000003.json", "{}")
    assert store.vacuum(keep=1) and store.versions() == [3] and state(store) == whole(["b", "c"], "two")
    for bad in ([], ["a/b"], [".."], ["x"] * 11):
        with pytest.raises(ValueError):
            store.delete(bad)


def test_all_documents_may_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(tables(spark, ["a"], "one"))
    store.delete(["a"])
    assert store.documents() is None or store.documents().count() == 0
    store.upsert(tables(spark, ["a"], "two"))
    assert state(store) == whole(["a"], "two")


# summaries


def test_only_what_changed_is_summarised(spark, tmp_path):
    nodes = frame(spark, [("d", "0", None, 1, 0, "Top", 1, 9), ("d", "1", "0", 2, 1, "One", 1, 4), ("d", "2", "1", 3, 2, "Deep", 1, 2), ("d", "3", "1", 3, 3, "Next", 3, 4), ("d", "4", "0", 2, 4, "Two", 5, 9), ("e", "0", None, 1, 0, "Short", 1, 1), ("f", "0", None, 1, 0, None, 1, 1)], NODES)
    words = {"2": "deep " * 20, "3": "next " * 20, "4": "two " * 20, "1": "  intro  of one "}
    asked = []

    def call(fresh):
        got = fresh.collect()
        asked.append(sorted(r.source[:9] for r in got))
        return spark.createDataFrame([(r.fingerprint, f"<{r.source.split()[0]}:{len(r.source)}>") for r in got], "fingerprint string, summary string")

    def run(words):
        texts = frame(spark, [("d", n, t) for n, t in words.items()] + [("e", "0", "a few words")], "doc_id string, node_id string, text string")
        return {(r.doc_id, r.node_id): r.summary for r in summaries.summarized(nodes, texts, call, str(tmp_path / "kept"), short=50).collect()}

    first = run(words)
    assert first["e", "0"] == "a few words" and first["f", "0"] == "" and first["d", "2"] == "<deep:99>"
    one = "One\nintro of one\nDeep: <deep:99>\nNext: <next:99>"
    assert first["d", "1"] == f"<One:{len(one)}>" and first["d", "0"].startswith("<Top:")
    assert len(asked) == 3 and run(words) == first and len(asked) == 3
    second = run(words | {"3": "other " * 20})
    assert asked[3:] == [["other oth"], ["One\nintro"], ["Top\nOne: "]][:3] and second["d", "4"] == first["d", "4"] and second["d", "2"] == first["d", "2"]


def test_a_lost_run_goes_on(spark, tmp_path):
    nodes = frame(spark, [("d", "0", None, 1, 0, "Top", 1, 2), ("d", "1", "0", 2, 1, "Leaf", 1, 2)], NODES)
    texts = frame(spark, [("d", "1", "x" * 99)], "doc_id string, node_id string, text string")
    levels = []

    def call(fail):
        def run(fresh):
            levels.append(fresh.count())
            if fail and len(levels) > 1:
                raise RuntimeError("lost")
            return fresh.select("fingerprint", F.lit("s").alias("summary"))

        return run

    with pytest.raises(RuntimeError):
        summaries.summarized(nodes, texts, call(True), str(tmp_path / "k"), 10)
    levels.clear()
    assert summaries.summarized(nodes, texts, call(False), str(tmp_path / "k"), 10).count() == 2 and levels == [1]
    silent = lambda fresh: fresh.where("false").select("fingerprint", F.lit("s").alias("summary"))
    with pytest.raises(Exception, match="no summary"):
        summaries.summarized(nodes, texts, silent, str(tmp_path / "other"), 10).count()


# expanding and optimising trees


def test_expansion_asks_once_and_wants_words_of_the_page(spark):
    nodes = frame(spark, [("d", "0", None, 1, 0, "Long", 1, 40), ("d", "1", None, 1, 1, "Short", 41, 44), ("d", "2", None, 1, 2, "Holder", 45, 46), ("d", "3", "2", 2, 3, "Tiny", 45, 45)], NODES)
    sheets = frame(spark, [("d", p, f"words\n## Part {p // 10}\nmore of Part {p}\n**Made   up**" if p % 10 == 1 else "words") for p in range(1, 47)], "doc_id string, page int, markdown string")
    asked = []

    def propose(leaves):
        asked.append(sorted(r.node_id for r in leaves.collect()))
        rows = [("d", "0", f"part {p // 10}", p) for p in (1, 11, 21, 31)] + [("d", "0", "Invented", 5), ("d", "0", "Part 99", 43), ("d", "0", "more of", 11), ("d", "9", "Part 0", 1)]
        return frame(spark, rows, "doc_id string, parent_id string, title string, start int")

    first = tree_rules.optimized(nodes, propose, sheets)
    got = [(r.title, r.start, r.end, r.depth) for r in first.orderBy("ord").collect()]
    assert got == [("Long", 1, 40, 1), ("part 0", 1, 10, 2), ("part 1", 11, 20, 2), ("part 2", 21, 30, 2), ("part 3", 31, 40, 2), ("Short", 41, 44, 1), ("Holder", 45, 46, 1)]
    assert asked[0] == ["0"] and all(not a for a in asked[1:])
    n = len(asked)
    again = tree_rules.optimized(first.drop("path_ids"), propose, sheets)
    assert [(r.title, r.start, r.end, r.depth) for r in again.orderBy("ord").collect()] == got and all(not a for a in asked[n:])
    assert [r.key_items for r in again.where("title = 'Holder'").collect()] == [["Tiny"]]


def test_expansion_must_pay(spark):
    nodes = frame(spark, [("d", "0", None, 1, 0, "Long", 1, 10)], NODES)
    dear = lambda leaves: frame(spark, [("d", "0", "a", 1), ("d", "0", "b", 2)], "doc_id string, parent_id string, title string, start int")
    assert tree_rules.optimized(nodes, dear).count() == 1 and tree_rules.optimized(nodes, dear, routing=0).count() == 3
    assert tree_rules.optimized(nodes).first().decided is False


# bookmarks


def test_bookmarks_take_in_what_was_detected(spark):
    base = frame(spark, [("d", "0", None, 1, 0, "Chapter 1: Busi", 1, 10), ("d", "1", "0", 2, 1, "Market", 3, 6), ("d", "2", None, 1, 2, "Results", 11, 20)], NODES)
    found = frame(spark, [
        ("d", "0", None, 1, 0, "Chapter 1: Business", 1, 10), ("d", "1", "0", 2, 1, "Setting", 1, 2), ("d", "2", "1", 3, 2, "People", 2, 2), ("d", "3", "0", 2, 3, "Share", 4, 5), ("d", "4", "0", 2, 4, "Spanning", 6, 12),
        ("d", "5", "4", 3, 5, "Within", 6, 6), ("d", "6", "4", 3, 6, "Income", 11, 12), ("d", "7", "6", 4, 7, "Tax", 12, 12), ("d", "8", None, 1, 8, "Note", 13, 13), ("d", "9", None, 1, 9, "NOTE", 14, 14), ("d", "10", None, 1, 10, "no te", 15, 15), ("d", "11", None, 1, 11, "x" * 101, 16, 16), ("d", "12", "11", 2, 12, "Below it", 17, 17),
        ("d", "13", None, 1, 13, "Beyond", 30, 31),
    ], NODES)
    out = tree_rules.merged_bookmarks(base, found).orderBy("ord").collect()
    by = {r.node_id: r for r in out}
    assert [(r.depth, r.title, by[r.parent_id].title if r.parent_id else None) for r in out] == [
        (1, "Chapter 1: Business", None), (2, "Setting", "Chapter 1: Business"), (3, "People", "Setting"), (2, "Market", "Chapter 1: Business"), (3, "Share", "Market"), (3, "Within", "Market"),
        (1, "Results", None), (2, "Income", "Results"), (3, "Tax", "Income"), (2, "Below it", "Results"),
    ]
    kept = {r.title: (r.start, r.end) for r in out}
    assert kept["Chapter 1: Business"] == (1, 10) and kept["Market"] == (3, 6) and kept["Results"] == (11, 20)
    held = lambda n: n is None or by[n.parent_id].start <= n.start and n.end <= by[n.parent_id].end
    assert all(held(r) for r in out if r.parent_id)
    alone = tree_rules.merged_bookmarks(base, found.where("false")).orderBy("ord").collect()
    assert [(r.title, r.start, r.end, r.depth) for r in alone] == [("Chapter 1: Busi", 1, 10, 1), ("Market", 3, 6, 2), ("Results", 11, 20, 1)]


# descent


def test_descent_goes_down_by_choice_and_falls_back(spark):
    nodes = [("d", f"{a}", None, 1, a * 100, f"Area {a}", 1, 1) for a in range(5)] + [("d", f"{a}.{b}", f"{a}", 2, a * 100 + b + 1, f"Topic {b}" + (" profit" if (a, b) == (2, 3) else ""), 1, 1) for a in range(5) for b in range(5)]
    nodes = frame(spark, nodes, NODES).withColumn("summary", F.when(F.col("node_id") == "2", "about profit"))
    questions = frame(spark, [("q", "profit", "d"), ("r", "nothing here", "d"), ("s", "profit", "none")], "query_id string, query string, doc_id string")
    ends = lambda rows: sorted((r.query_id, r.node_id, r.level) for r in rows.collect())
    plain = ends(routing.descended(questions, nodes))
    assert [x for x in plain if x[0] == "q"] == [("q", "2.3", 2)] and {x[0] for x in plain} == {"q", "r"} and len([x for x in plain if x[0] == "r"]) == routing.BEAM
    shown = []

    def choose(seen):
        shown.append(seen.groupBy("query_id").count().agg(F.max("count")).first()[0])
        return seen.where("query_id = 'q' and (node_id in ('4', '1') or node_id like '%.0')").select("query_id", "doc_id", "node_id").union(frame(spark, [("q", "d", "no such"), ("q", "d", "2.2")], "query_id string, doc_id string, node_id string"))

    got = ends(routing.descended(questions, nodes, choose, beam=2, shown=7))
    assert [x for x in got if x[0] == "q"] == [("q", "1.0", 2), ("q", "4.0", 2)] and [x for x in got if x[0] == "r"] == [("r", "0.0", 2)] and max(shown) <= 7
    assert ends(routing.descended(questions, nodes, levels=1, beam=1)) == [("q", "2", 1), ("r", "0", 1)]
    assert routing.descended(questions.where("false"), nodes).count() == 0 and routing.descended(questions, nodes.where("false")).count() == 0


# scans


def test_unchanged_files_are_not_opened(spark, tmp_path):
    import os

    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for name, text in (("a.md", "one"), ("sub/b.md", "two\r\nlines"), ("c.txt", "three")):
        (root / name).write_bytes(text.encode())
    first = readers.carried_listing(spark, str(root), None, [".md", ".txt"])
    assert {r.path: r.carried for r in first.collect()} == {"a.md": False, "sub/b.md": False, "c.txt": False}
    first.write.parquet(str(tmp_path / "kept"))
    before = spark.read.parquet(str(tmp_path / "kept"))
    kept = {r.path: r.content_hash for r in before.collect()}
    stat = os.stat(root / "a.md")
    (root / "a.md").write_bytes(b"ONE")  # other content behind the same size and time: only a read would tell
    os.utime(root / "a.md", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (root / "sub/b.md").write_bytes(b"changed")
    (root / "c.txt").unlink()
    (root / "new one #1 %.md").write_bytes(b"\xff new")
    now = {r.path: (r.carried, r.content_hash) for r in readers.carried_listing(spark, str(root), before, [".md", ".txt"]).collect()}
    assert now["a.md"] == (True, kept["a.md"]) and now["sub/b.md"][0] is False and now["sub/b.md"][1] != kept["sub/b.md"] and "c.txt" not in now and now["new one #1 %.md"][0] is False
    assert {(r.path, r.text) for r in readers.changed_files(spark, str(root), before).collect()} == {("sub/b.md", "changed"), ("new one #1 %.md", "� new")}


def test_metrics_divide_once_and_round_ties_up(spark):
    rows = frame(spark, [(666, 160), (1, 3), (5, 1000), (15, 10000), (0, 7), (10**12, 3)], "n long, d long")
    got = [r[0] for r in rows.select(trees.quotient(F.col("n"), F.col("d"), 3)).collect()]
    assert got == [4.163, 0.333, 0.005, 0.002, 0.0, 333333333333.333]
