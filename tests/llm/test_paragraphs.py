import random
import time

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import paragraphs as P
from foliant.llm.wordhash import sliding, word_hashes

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 9))) for _ in range(3000)]


def words(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_word_hashes():
    texts = ["One two\ttwo  ONE\n", "", None, "é", "one", "x" * 300, " ", "two"]
    w = word_hashes(pa.array(texts))
    assert np.diff(w.first).tolist() == [4, 0, 0, 1, 1, 1, 0, 1]
    assert w.hash[0] == w.hash[3] == w.hash[5] and w.hash[1] == w.hash[2] == w.hash[7] and len(set(w.hash.tolist())) == 4
    assert np.diff(word_hashes(pa.array(["a-b, c!", "--"]), only_letters=True).first).tolist() == [3, 0]
    x = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    assert sliding(x, 3, np.minimum).tolist() == [3, 1, 1, 1, 2, 2] and sliding(x, 10, np.minimum)[0] == 1


def test_anchors_do_not_depend_on_neighbours():
    passage = words(51)
    texts = [" ".join(words(RNG.randint(0, 90)) + passage + words(RNG.randint(0, 90))) for _ in range(40)]
    text, word, sets = P.paragraphs_of(pa.array(texts))
    common = set.intersection(*(set(P.signature(sets[text == d]).tolist()) for d in range(40)))
    assert common
    alone = [P.paragraphs_of(pa.array([t]))[1].tolist() for t in texts]
    assert alone == [word[text == d].tolist() for d in range(40)]
    assert len(P.paragraphs_of(pa.array([" ".join(words(4)), "", None]))[0]) == 0
    assert P.paragraphs_of(pa.array([" ".join(words(24)), "", " ".join(words(5))]))[0].tolist() == [0, 2]
    assert len(P.paragraphs_of(pa.array([" ".join(["same"] * 5000)]))[0]) == 1


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    shared, copy = words(60, rng), words(300, rng)
    near = list(copy)
    for i in range(10, 300, 60):
        near[i] = "changed"
    docs = [(i, " ".join(words(rng.randint(30, 200), rng)), "clash") for i in range(60)]
    docs += [(i, " ".join(words(rng.randint(5, 90), rng) + shared + words(rng.randint(5, 90), rng)), "x") for i in range(100, 130)]
    docs += [(200, " ".join(copy), "x"), (201, " ".join(near), "x"), (202, " ".join(copy), "x"), (203, " ".join(copy), "x"), (203, " ".join(copy), "x")]
    docs += [(300, None, "x"), (301, "", "x"), (None, " ".join(words(40, rng) + shared), "x"), (302, "few words", "x"), (303, "z " * 9000, "x"), (304, "z " * 500, "x")]
    return docs


def test_repeats_are_found_and_clean_documents_left(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, row string").repartition(4)
    for chunk in (P.CHUNK, 2):
        monkeypatch.setattr(P, "CHUNK", chunk)
        rows = P.removals(docs).collect()
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
        assert set(by) == {*range(100, 130), 200, 201, 202, 203, None, 303, 304}
        kept = [d for d in range(100, 130) if not by[d][0].spans]
        assert kept == [100] and by[200][0].spans == "" and len(by[203]) == 2
        assert by[202][0].removed_words > 250 and by[201][0].removed_words > 100
        assert all(r.removed_words <= 62 for d in range(100, 130) for r in by[d])
    assert P.removals(docs.limit(0)).count() == 0


def test_forest_is_that_of_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 31, 40)
    sets = [np.where(rng.random(40) < 0.05, rng.integers(0, 1 << 31, 40), base).astype("<u4").tobytes() for _ in range(30)]
    links = P._forest(list(range(30)), sets, [0] * 30, False, 0.8)
    assert all(P.jaccard(sets[a], sets[b]) >= 0.8 for a, b in links) and len(links) <= 29


@pytest.mark.parametrize("cross", [False, True])
def test_forest_joins_what_all_pairs_join(cross):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 31, (40, 21))
    sets = base[rng.integers(0, 40, 300)]
    sets = np.where(rng.random(sets.shape) < 0.04, rng.integers(0, 1 << 31, sets.shape), sets)
    sets[:50, 9:] = sets[:50, 9:10]  # short texts repeat their last shingle
    sets, parts = [x.astype("<u4").tobytes() for x in sets], rng.integers(0, 2, 300).tolist()
    pairs = [(i, j) for i in range(300) for j in range(i) if not (cross and parts[i] == parts[j]) and P.jaccard(sets[i], sets[j]) >= 0.8]

    def classes(links):
        least = list(range(300))
        for a, b in links:
            x, y = sorted((least[a], least[b]))
            least = [x if v == y else v for v in least]
        return least

    links = P._forest(list(range(300)), sets, parts, cross, 0.8)
    assert set(map(frozenset, links)) <= set(map(frozenset, pairs)) and classes(links) == classes(pairs)


def test_crowded_bucket_is_not_compared_pair_by_pair():
    rng = np.random.default_rng(5)
    sets = rng.integers(0, 1 << 31, (8000, 21))
    sets[:, 0] = 7  # the shingle they met by
    sets[1::1000] = sets[0::1000]
    began = time.process_time()
    links = P._forest(list(range(8000)), [x.astype("<u4").tobytes() for x in sets], [0] * 8000, False, 0.8)
    assert sorted(links) == [(k, k + 1) for k in range(0, 8000, 1000)] and time.process_time() - began < 6  # 32 million pairs


def removed(row):
    runs = [tuple(map(int, x.split("-"))) for x in row.spans.split(",") if x]
    return {w for a, b in runs for w in range(a, b)}


def test_every_copy_in_a_text_is_removed(spark):
    rng = random.Random(6)
    passage, gaps = words(80, rng), [words(40, rng) for _ in range(12)]
    thrice = [gaps[2] + passage + gaps[3] + passage + gaps[4] + passage + gaps[5], gaps[6] + passage + gaps[7] + passage]
    docs = [(1, " ".join(gaps[0] + passage + gaps[1])), (2, " ".join(thrice[0])), (0, " ".join(thrice[1])), (3, "z " * 9000), (4, "z " * 500)]
    by = {r.doc_id: removed(r) for r in P.removals(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()}
    for start in (40, 160, 280):
        assert any(start <= w < start + 80 for w in by[2])
    assert any(160 <= w < 240 for w in by[0]) and not any(w < 120 for w in by[0])  # the first copy of the first document stays
    assert len(by[3]) >= 8950 and not any(w < 25 for w in by[3]) and len(by[4]) >= 475


def test_whole_passages_are_removed(spark):
    rng = random.Random(7)
    docs, want = [], {}
    for k, size in enumerate((51, 55, 60, 100, 400)):
        passage = words(size, rng)
        for j in range(12):
            d, before = 100 * k + j, rng.randint(0, 90)
            docs.append((d, " ".join([f"a{d}", *words(before, rng)] + passage + [f"b{d}", *words(rng.randint(0, 90), rng)])))
            want[d] = set(range(before + 1, before + 1 + size)) if j else set()
    by = {r.doc_id: removed(r) for r in P.removals(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert set(by) == set(want)
    for d, held in want.items():
        assert held <= by[d] and len(by[d] - held) <= 2, d


def test_short_texts_are_paragraphs(spark):
    docs = [(1, "one two three four five six"), (2, "One two  three four five six"), (3, "one two three four"), (4, "one two three four"), (5, "a b c d e f g h i j k l m n o p q r s t u v w x"), (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (7, "a b c d e f g h i j k l m n o p q r s t u v w x")]
    by = {r.doc_id: r.spans for r in P.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert by == {1: "", 2: "0-6", 5: "", 6: "0-25", 7: "0-24"}  # of the sixth text 20 of 21 shingles are those of the fifth
