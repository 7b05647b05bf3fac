import random

import numpy as np

from foliant.llm import quality


def make(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("the of and run house tree light water stone paper".split()) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([lambda w: [x + "$$$" for x in w], lambda w: [x.upper() + "!!" for x in w], lambda w: [w[0]] * len(w)])(words)
        rows.append((i, " ".join(words), "clash", 9.0))
        labels.append((i, int(good), 0))
    return rows, labels


def test_isotonic_fit():
    x, y = quality.isotonic(np.array([3.0, 1, 2, 4, 5]), np.array([0.0, 0, 1, 1, 1]))
    assert np.all(np.diff(y) >= 0) and y[0] == 0 and y[-1] == 1 and 0.5 in y


def test_held_out_accuracy(spark):
    rows, labels = make(3000)
    docs = spark.createDataFrame(rows + [(None, None, "x", 1.0), (5000, "", "x", 1.0)], "doc_id long, text string, source string, quality_score double")
    known = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.training_labels(known))
    got = {r.doc_id: r for r in quality.classify(docs, model).withColumn("h", quality.held_out("doc_id")).collect()}
    assert len(got) == 3002 and all(0 <= r.quality_score <= 1 for r in got.values()) and got[5].source == "clash"
    held = [(got[i].quality_predicted, q) for i, q, _ in labels if got[i].h]
    assert 600 < len(held) < 900 and sum(p == q for p, q in held) > 0.98 * len(held)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, quality.fit(docs, none)).first().quality_score == 0.5
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit(docs, one).weights is None
    assert quality.classify(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_bounded_sample(spark):
    rows, labels = make(1500, 4)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, a string, b double"), spark.createDataFrame(labels, "doc_id long, quality int, t int")
    model = quality.fit(docs, known, sample=300)
    assert model.weights is not None and len(model.steps[0]) <= 120
