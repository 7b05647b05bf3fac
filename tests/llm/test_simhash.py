import random

import xxhash

from foliant.llm import simhash
from foliant.llm.components import components


def plain_fingerprint(text, k=3):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_fingerprint():
    random.seed(1)
    texts = ["", None, "   \n", "One", "one TWO", "a b c", "A É\xa0x y z É", *(" ".join(random.choices(["the", "cat", "Sat", "on", "ünder"], k=n)) + "\n\t x" for n in range(1, 60))]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_components(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 300)] + [(random.randint(1000, 1400),) * 2 for _ in range(9)]
    edges += [(random.randint(500, 900), random.randint(500, 900)) for _ in range(200)] + [(-5, 3), (7, 7)]
    random.shuffle(edges)
    frame = spark.createDataFrame(edges + [(None, 4)], "a long, b long")
    assert {r.node: r.root for r in components(frame).collect()} == union_find(edges)
    assert components(frame.limit(0)).count() == 0


def brute(rows):
    fps = {f for _, f in rows}
    edges = [(a, b) for a in fps for b in fps if a <= b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    root, first = union_find(edges), {}
    for i, f in rows:
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    return sorted(((i, f, first.get(root[f])) for i, f in rows), key=str)


def test_classes_are_those_of_brute_force(spark, monkeypatch):
    random.seed(3)
    base = [random.getrandbits(64) - (1 << 63) for _ in range(60)]
    fps = list(base)
    for f in base[:30]:
        for _ in range(12):
            g = f
            for b in random.sample(range(64), random.randint(1, 5)):
                g ^= (1 << b) if b < 63 else -(1 << 63)
            fps.append(g)
    dense = [base[0] ^ random.getrandbits(9) for _ in range(250)]
    rows = [(i if i % 50 else None, f) for i, f in enumerate(fps + dense + [0, 0, 0, base[5], base[5]])]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    want = brute(rows)
    for cell in (simhash.CELL, 4):
        monkeypatch.setattr(simhash, "CELL", cell)
        got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.classes(frame).collect()), key=str)
        assert got == want


def test_near_duplicates_of_odd_rows(spark):
    texts = ["", None, "\n", "same text here now", "same text here now", "other words are in this one", "SAME text  here now"]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(4, texts[4], "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [(i, c) for i, _, c in got] == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (4, 3), (5, 5), (6, 3)]
    assert got[0][1] == "0" * 16 and got[3][1] == f"{plain_fingerprint(texts[3]):016x}"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
