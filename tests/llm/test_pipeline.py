import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from foliant.llm import contamination, pii, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_order(stages):
    assert [n.split()[0] for n, _ in P.STAGES] == ["quality", "simhash", "benchmark", "pii", "best-fit"]
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[1:5])


def test_each_stage_takes_effect(spark, stages):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert ids[0] > ids[1] > ids[2] and ids[2] >= ids[3] == ids[4] == ids[5]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[i] == 1 for i in ids[0] - ids[1] if i in labels) <= 0.03 * len(labels)
    assert sum(labels[i] == 0 for i in ids[1] if i in labels) <= 0.03 * len(labels)


def test_duplicates_against_brute_force(stages):
    sets = {}
    for r in stages[1].collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    kept = {r.doc_id for r in stages[2].collect()}
    alike = collections.defaultdict(list)
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = collections.Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    for (a, b), n in shared.items():
        j = n / (len(sets[a]) + len(sets[b]) - n)
        if j >= 0.7:
            alike[b].append((a, j))
    assert all(b in alike for b in sets if b not in kept)
    assert not [b for b in kept if any(j >= 0.87 for _, j in alike[b])]


def test_leaks_and_personal_data_against_brute_force(spark, stages):
    norm = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in stages[3].collect()}
    for r in stages[2].collect():
        assert (r.doc_id in kept) != any(i in norm(r.text) for i in items)
    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert not re.search(pii.BASE["email"][1] + r"mail\d", r.text) and not re.search(r"\+1 \(\d{3}\)", r.text)
        assert len(r.text) == r.n_chars and (r.text == before[r.doc_id] or "[" in r.text)


def test_packing_holds_everything(stages):
    rows = stages[5].collect()
    assert all(r.length == len(r.ids) // 4 for r in rows)
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_a_corpus_without_labels_or_items(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels, items = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    assert quality.fit(docs, labels).weights is None and contamination.clean(docs, items).count() == 2
    assert P.redact_personal_data(spark, docs, "").count() == 2 and P.pack(spark, docs, "").count() == 2


def test_clashing_columns_and_no_documents(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    clash = {"_row": "r", "leaks": "l", "pii_spans": "s", "pii_base": "b", "quality_score": "q", "sig": "g", "cell": "c"}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "x", 0), (10**6, "", "en", "x", 0), (10**6 + 1, "word " * 60_000, "en", "x", 300_000)], docs.schema)
    for rows in (docs.union(odd), docs.limit(0)):
        now = rows.withColumns({c: F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c, v in clash.items()})
        kept = now.columns
        for i, (_, stage) in enumerate(P.STAGES):
            now = stage(spark, now, small)
            assert i == len(P.STAGES) - 1 or now.columns == kept
            now.write.mode("overwrite").parquet(path := str(tmp_path / f"{rows is docs}-{i}-{len(kept)}-{id(rows)}"))
            now = spark.read.parquet(path)
            if i < len(P.STAGES) - 1:
                wrong = " or ".join(f"{c} != concat('{v}', coalesce(cast(doc_id as string), ''))" for c, v in clash.items())
                assert now.where(wrong).count() == 0
        assert (now.count() > 0) == (rows.count() > 0)
