import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import negatives, queries

label_column = lambda: F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def brute(rows):
    """By the contract, in whole Python numbers, one pair after the other."""
    seen, kept = set(), []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = tuple(math.floor(256 * c) for c in v)
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, x)
        if row not in seen:
            seen.add(row)
            kept.append(row)
    out = []
    for a, la, x in kept:
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), b, lb) for b, lb, y in kept if b != a]
        for s, b, _ in sorted(t for t in scored if t[2] == la)[:5]:
            fit = sorted(t[:2] for t in scored if t[2] != la and 50 * -s <= 100 * -t[0] <= 95 * -s)[:3]
            out += [(a, b, r, n, -s, -t) for r, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def got(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, v, label, "x", 0.5) for i, v, label in rows], "vec_id long, embedding array<float>, label int, anchor string, score double").repartition(parts)
    return sorted(map(tuple, negatives.hard_negatives(negatives.quantized(frame, label_column()), F.col("vec_id") % 50 == 0).collect()))


def vectors(n, width, seed=0, step=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) + 0.6
    x = np.round(x / step) * step if step else x
    return [(i, [float(c) for c in np.float32(v)], int(rng.integers(0, 10))) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [None, (7, 16, 4000)])
def test_equal_to_pair_by_pair(spark, monkeypatch, block):
    """Whole blocks, then blocks of a few rows in several passes over the candidates."""
    if block:
        for name, value in zip(("ANCHOR_ROWS", "CANDIDATE_ROWS", "ANCHOR_BYTES"), block):
            monkeypatch.setattr(negatives, name, value)
    rows = vectors(700, 12)
    assert got(spark, rows) == brute(rows) != []


def test_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATE_ROWS", 32)
    rows = vectors(400, 3, seed=2, step=1.0)
    rows += rows[50:60] + rows[50:52] * 2 + [(100, rows[3][1], 4), (100, rows[4][1], rows[4][2])]
    assert got(spark, rows, 5) == brute(rows) != []


def test_one_label_holds_most_rows(spark):
    rows = [(i, v, 3 if i % 3 else label) for i, v, label in vectors(600, 8, seed=5)]
    assert got(spark, rows) == brute(rows) != []


def test_rows_that_take_no_part(spark):
    rows = vectors(200, 6, seed=3)
    bad = [(1000, None, 1), (1050, [float("nan")] * 6, 1), (1100, [float("inf")] + [0.0] * 5, 1), (1150, [None] * 6, 1), (None, rows[0][1], 1), (1200, rows[0][1], None), (1250, [], 1), (1300, [0.0] * 6, 2), (1350, [0.5, 0.5], 2)]
    assert got(spark, rows + bad) == brute(rows + bad)
    assert got(spark, []) == [] and got(spark, [r for r in rows if r[0] % 50]) == []
    assert got(spark, rows[:1]) == [] and got(spark, [(0, [1.0], 3), (1, [1.0], 4), (2, [0.7], 9)]) == brute([(0, [1.0], 3), (1, [1.0], 4), (2, [0.7], 9)])


def test_large_whole_numbers(spark):
    """Products over 2^53 are whole as well; over 62 bits they are refused."""
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.uniform(1e5, 3e5))) for _ in range(8)], i % 3) for i in range(150)]
    assert got(spark, rows) == brute(rows) != []
    with pytest.raises(OverflowError):
        got(spark, [(0, [1e30], 1), (1, [1e30], 1)])


def test_query_is_its_sql_over_the_whole_table(spark):
    import duckdb

    sf, name = "/root/testdata/sf0.001", "op13_hard_negatives"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf).collect())) == sorted(db.execute(queries.ORACLE_SQL[name]).fetchall())
