import random
from difflib import SequenceMatcher

import numpy as np

from foliant.llm import contamination as C

RNG = random.Random(8)
COMMON = "the of and to in is".split()
VOCABULARY = COMMON * 60 + ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(3, 8))) for _ in range(900)]


def words(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


def test_longest_common_subsequence():
    for _ in range(200):
        a, b = [[RNG.randint(0, 6) for _ in range(RNG.randint(1, 90))] for _ in range(2)]
        masks = {}
        for k, c in enumerate(a):
            masks[c] = masks.get(c, 0) | 1 << k
        assert C.lcs(masks, len(a), b) == plain_lcs(a, b)


def test_leaks_are_found_and_clean_documents_left(spark, monkeypatch):
    rng = random.Random(1)
    items = [words(rng.randint(18, 55), rng) for _ in range(30)]
    docs, want = [], set()
    for d in range(400):
        body = words(rng.randint(1, 400), rng)
        if d % 8 == 0:
            i = rng.randrange(30)
            text = list(items[i])
            if d % 3 == 0:  # a paraphrase: some words go, some are new
                for _ in range(len(text) // 10):
                    text[rng.randrange(len(text))] = "newword"
            at = rng.randint(0, len(body))
            body = body[:at] + text + body[at:]
            want.add((d, i))
        docs.append((d, "%% ".join(body).capitalize() if d % 5 == 0 else " ".join(body), "x"))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "one", "x"), (None, " ".join(items[3]), "x"), (1003, " ".join(items[4]), "x"), (1003, " ".join(items[4]), "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, leaks string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t) + ".") for i, t in enumerate(items)] + [(90, None), (91, ""), (None, "a b c d e"), (92, "..!")], "item_id long, text string")
    for block in (C.ITEMS, 16):
        monkeypatch.setattr(C.item_blocks, "__defaults__", (block,))
        got = [(r.doc_id, r.item_id) for r in C.leaks(frame, bench).collect()]
        assert set(got) == want | {(None, 3), (1003, 4)} and got.count((1003, 4)) == 2
    held = {r.doc_id for r in C.with_leaks(frame.drop("leaks"), bench).where("size(leaks) > 0").collect()}
    assert held == {d for d, _ in want} | {None, 1003}
    rest = C.clean(frame, bench)
    assert rest.columns == frame.columns and rest.count() == frame.count() - len(want) - 3
    assert C.leaks(frame.limit(0), bench).count() == 0 and C.leaks(frame, bench.limit(0)).count() == 0


def test_latent_space_is_that_of_the_svd(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(f"w{k}" for k in rng.choice(40, 25) // (1 + i % 4))) for i in range(300)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    model = next(C.item_blocks(bench))
    codes = C.encoded(frame, model)
    old = C.COMMON
    C.COMMON = 2.0
    try:
        C.fit(codes, model, rank=12)
    finally:
        C.COMMON = old
    rows = []
    for _, t in docs:
        x = np.zeros(len(model.weight))
        for c in model.codes(C.word_hashes(C.pa.array([t]), only_letters=True).hash):
            x[c] += model.weight[c]
        rows.append(x / max(np.linalg.norm(x), 1e-9))
    a = np.array(rows)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    basis = np.linalg.qr(model.space / np.maximum(model.weight, 1e-9)[:, None])[0]
    assert np.linalg.norm(a @ basis) ** 2 >= 0.9 * (s[:12] ** 2).sum()


def test_long_items_are_found_whole(spark):
    rng = random.Random(5)
    sizes = [150, 300, 1000]
    items = [words(n, rng) for n in sizes for _ in range(4)]
    docs, want = [(d, " ".join(words(300, rng))) for d in range(300)], set()
    for i, item in enumerate(items):
        for d, text in ((1000 + i, item), (2000 + i, [w if rng.random() > 0.1 else "newword" for w in item])):
            docs.append((d, " ".join(words(rng.randint(0, 200), rng) + text + words(rng.randint(0, 200), rng))))
            want.add((d, i))
        docs.append((3000 + i, " ".join(item[: len(item) // 3])))  # a third of an item is no leak
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    rows = C.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.lcs == 1 for r in rows if r.doc_id < 2000)
    assert C.clean(frame, bench).count() == len(docs) - len(want)


def one_by_one(docs, items):
    """(doc, item) by plain TF-IDF cosines over all passages and parts, then subsequences: no latent space, no arrays."""
    from collections import Counter
    from math import log, sqrt

    split = {d: t.split() for d, t in docs}
    vocabulary = {w for t in items.values() for w in t.split()}
    blocks = {d: [w[i : i + C.BLOCK] for i in range(0, len(w), C.BLOCK)] for d, w in split.items()}
    df, n = Counter(), 0
    for d in blocks:
        for b in blocks[d]:
            n += 1
            df.update(set(b) & vocabulary)
    parts = [(i, at, t.split()[at : at + C.PART]) for i, t in items.items() for at in C.part_starts(len(t.split()))]
    telling = {w for w in vocabulary if df[w] <= max(C.COMMON * n, 2)}
    for _, _, p in parts:
        if len(set(p) & telling) < C.LEAST_TELLING:
            telling |= set(sorted(set(p), key=lambda w: (df[w], hash_of[w]))[: C.LEAST_TELLING])
    weight = {w: max(log((1 + n) / (1 + df[w])), 1e-3) for w in telling}
    seen = {w for w in weight if df[w]}  # what no block holds has no place in the space

    def vector(ws):
        return Counter({w: c * weight[w] for w, c in Counter(ws).items() if w in seen})

    def cosine(a, b):
        return sum(a[w] * b[w] for w in a) / max(sqrt(sum(x * x for x in a.values())) * sqrt(sum(x * x for x in b.values())), 1e-12)

    out = set()
    for d, bs in blocks.items():
        for k, b in enumerate(bs):
            passage = b + (bs[k + 1] if k + 1 < len(bs) else [])
            for i, at, part in parts:
                q, own = vector(part), items[i].split()
                if max(cosine(vector(passage), q), cosine(vector(b), q)) < C.COSINE:
                    continue
                if len(set(passage) & set(part) & telling) < C.TELLING * max(1, len(set(part) & telling)):
                    continue
                a, z = C.around(len(own), at, k * C.BLOCK)
                held = split[d][a:z]
                share = plain_lcs(own, held) / len(own)
                rare = sorted(set(own) & telling, key=lambda w: (-weight[w], hash_of[w]))
                rare = rare[: max(3, len(rare) // 3)]
                answers = sum(w in held for w in rare) / max(1, len(rare))
                if share >= C.EXACT or share >= C.PARAPHRASE and answers >= C.ANSWERS:
                    out.add((d, i))
    return out


hash_of = {}


def test_against_one_by_one(spark, monkeypatch):
    """With a space of all directions the search is the plain one."""
    rng = random.Random(5)
    items = {i: " ".join(words(n, rng)) for i, n in enumerate((12, 20, 40, 63, 64, 65, 90, 130, 150, 300))}
    docs = []
    for d in range(90):
        body = words(rng.randint(1, 300), rng)
        if d % 2:
            text = items[d % len(items)].split()
            for _ in range(rng.randint(0, len(text) // 2)):
                text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
            cut = rng.randint(0, len(text) // 2) if d % 6 == 1 else 0
            at = rng.randint(0, len(body))
            body = body[:at] + text[cut:] + body[at:]
        docs.append((d, " ".join(body)))
    every = sorted({w for t in items.values() for w in t.split()})
    hashes = C.word_hashes(C.pa.array([" ".join(every)]), only_letters=True).hash
    hash_of.update(zip(every, hashes.tolist()))
    monkeypatch.setattr(C.fit, "__defaults__", (5000,))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in C.leaks(frame, bench).collect()}
    want = one_by_one(docs, items)
    assert got == want and 20 < len(want) < 45, (got ^ want, len(want))


def test_items_of_every_length_in_long_documents(spark):
    rng = random.Random(9)
    sizes = (5, 8, 30, 96, 121, 150, 175, 300, 1000)
    items = {i: words(n, rng) for i, n in enumerate(sizes)}
    docs = [(i, " ".join(words(rng.randint(0, 90), rng) + t + words(rng.randint(0, 90), rng))) for i, t in items.items()]
    docs += [(100 + i, " ".join(words(400, rng))) for i in range(30)] + [(200, " ".join(words(3000, rng) + items[8] + words(2000, rng)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in C.leaks(frame, bench).collect()}
    assert got == {(i, i) for i in items} | {(200, 8)}
