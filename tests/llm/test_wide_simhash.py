import random

import numpy as np
import pyarrow as pa

from foliant.llm import wide_simhash as S

RNG = random.Random(6)
VOCABULARY = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 9))) for _ in range(4000)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def changed(text, n):
    out = list(text)
    for i in RNG.sample(range(len(out)), n):
        out[i] = "new" + RNG.choice(VOCABULARY)
    return out


def test_distance_follows_similarity():
    base = words(400)
    near = [changed(base, k) for k in (1, 3, 6, 9, 14, 40)]
    fp = S.wide_fingerprints(pa.array([" ".join(t) for t in [base, *near]]))
    for t, f in zip(near, fp[1:]):
        p = np.bitwise_count(f ^ fp[0]).sum() / S.BITS
        j = jaccard(base, t)
        assert abs(p - np.arccos(2 * j / (1 + j)) / np.pi) < 0.035
    assert (S.wide_fingerprints(pa.array(["", None, " \n"])) == 0).all()
    assert (S.wide_fingerprints(pa.array(["a b", "A  b"]))[0] == S.wide_fingerprints(pa.array(["x", "a b"]))[1]).all()


def test_one_of_each(spark, monkeypatch, tmp_path):
    docs, groups = [], []
    for g in range(60):
        base = words(RNG.randint(60, 500))
        copies = [base, base] + [changed(base, max(1, len(base) // 60)) for _ in range(RNG.randint(0, 3))]
        copies = [c for c in copies if jaccard(base, c) > 0.88]
        ids = [len(docs) + k for k in range(len(copies))]
        docs += [(i, " ".join(c), "x") for i, c in zip(ids, copies)]
        groups.append(ids)
    crowd = words(200)
    ids = list(range(len(docs), len(docs) + 60))
    docs += [(i, " ".join(changed(crowd, 1)), "x") for i in ids]
    groups.append(ids)
    apart = list(range(len(docs), len(docs) + 300))
    docs += [(i, " ".join(words(RNG.randint(1, 300))), "x") for i in apart]
    n = len(docs)
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, docs[0][1], None), (n + 2, "z " * 20000, "x")]
    RNG.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, root string").repartition(3)
    frame.write.parquet(path := str(tmp_path / "docs"))
    frame = spark.read.parquet(path)
    for chunk in (S.CHUNK, 16):
        monkeypatch.setattr(S, "CHUNK", chunk)
        left = sorted((r.doc_id for r in S.one_of_each(frame).collect()), key=lambda i: (i is None, i or 0))
        assert left == sorted([g[0] for g in groups] + apart + [n, n + 2])
    assert S.one_of_each(frame.limit(0)).count() == 0 and S.one_of_each(frame).columns == frame.columns
