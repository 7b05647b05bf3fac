import random

import pytest

from foliant.llm.sharding import shard_by_bytes


def check(rows, out, shards=40):
    sizes, slots, groups = [0] * shards, {}, {}
    assert len(out) == len(rows)
    assert sorted(map(str, rows)) == sorted(str((r.doc_id, r.text, r.lang)) for r in out)
    for r in out:
        assert r.size == len((r.text or "").encode()) + 16
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(r.text, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, groups


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, slot string").repartition(7)


@pytest.mark.parametrize("kind", ["even", "hot text", "hot row", "long"])
def test_shards_are_equal_in_bytes(spark, kind):
    rng = random.Random(kind)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 300))), rng.choice("ab")) for i in range(6000)]
    if kind == "hot text":
        rows += [(i, "same text " * 9, "a") for i in range(6000, 9000)]
    if kind == "hot row":
        rows += [(7, "same row " * 9, "a")] * 3000 + [(None, None, None)] * 50
    if kind == "long":
        rows += [(i, "é" * 2000, "x") for i in range(9000, 9010)]
    out = shard_by_bytes(make(spark, rows)).collect()
    sizes, groups = check(rows, out)
    ideal = sum(sizes) / 40
    most = max(r.size for r in out)
    assert max(sizes) - ideal <= most + 0.002 * ideal + 1 and ideal - min(sizes) <= most + 0.002 * ideal + 1
    assert sum(len(g) > 1 for g in groups.values()) <= 39


def test_few_or_no_rows(spark):
    assert shard_by_bytes(make(spark, [(1, "a", "b")]).limit(0)).count() == 0
    for rows in ([(1, "a", "b")], [(1, "a", "b")] * 5, [(None, None, None), (2, "", "x"), (3, "long " * 500, "x")]):
        check(rows, shard_by_bytes(make(spark, rows)).collect())


def test_columns_of_any_name_are_kept(spark):
    rows = [(i, "text" * (i % 5), i, "x", 1.5, "y") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h long, _range string, _of_shards_h double, _row string")
    out = shard_by_bytes(docs)
    assert sorted(out.columns) == sorted([*docs.columns, "size", "shard", "slot"])
    assert sorted(map(tuple, out.select(docs.columns).collect())) == sorted(rows)
