import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm import packing, sstable
from foliant.llm.tokens import Encoder

TEXTS = [
    "", None, " ", "\n\n", "That it.", "It's they'll  we'd 'tis x'S", "a  b\t\tc \n d", "Élan ÀÉ ß÷×ÿ café2²", "中文 mixed 12 3",
    "<|endoftext|> x", "hello <|endoftext|> world", "<|startoftext|>a<|ENDOFTEXT|>", "a[PAD] <unk> </s>", "y" * 3000 + " z", "a_b __ -- 3.14 1,000", "naïve é  nbsp", "🙂 smile", "x" * 5000, "word " * 3000, "\x00\x01 ctl", "That it.",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    ours, theirs = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    random.seed(3)
    more = ["".join(random.choices("abAB zé'sßÜ .,!?12\n\t-_|<>ñ", k=200)) for _ in range(300)]
    for text in [*TEXTS, *more]:
        want = theirs.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ours.batch([text], 7)[0], "<u4").tolist() == [*want, 7]


def test_special_tokens_as_text_and_the_bound_of_the_cache(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = Encoder(path, plain_special=True), Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    monkeypatch.setattr("foliant.llm.tokens.MOST_CACHED", 2000)
    for text in [*TEXTS, *(f"word{i} other{i} " + "q" * i for i in range(0, 400, 7))]:
        want = theirs.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ours.batch([text], 7)[0], "<u4").tolist() == [*want, 7]
        assert len(ours.cache) < 60 and all(len(k) <= 64 for k in ours.cache)


def test_two_bytes_must_hold_an_id():
    import io

    writer = sstable.Writer(io.BytesIO(), 2)
    writer.add(b"\1" * 10, np.array([65535], "<u4").tobytes())
    with pytest.raises(ValueError, match="width=4"):
        writer.add(b"\2" * 10, np.array([65536], "<u4").tobytes())


def best_fit_one_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    random.seed(5)
    for capacity in (7, 64, 100):
        lengths = [random.choice([random.randint(1, capacity), random.randint(1, 9)]) for _ in range(900)]
        lengths = [min(n, capacity) for n in lengths]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan_best_fit(counts, capacity)
        left = [capacity] * plan.bins
        runs = {n: [r for r in plan.runs if r.length == n] for n in counts}
        for n, c in counts.items():
            for i in range(c):
                r = [r for r in runs[n] if r.first <= i][-1]
                assert capacity - r.offset >= n
                left[r.bin + (i - r.first) // r.each] -= n
        assert min(left) >= 0 and sorted(left) == best_fit_one_by_one(lengths, capacity)


def frame(spark, texts, ids=None):
    rows = [(i, t, 1, "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, length string")


def test_packing_of_odd_rows(spark):
    texts = TEXTS * 3 + ["lorem ipsum " * 4000]
    ids = [*range(len(texts) - 1), None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_best_fit(frame(spark, texts, ids).repartition(3), path).collect()
    whole = {i: Encoder(path).batch([t], 2)[0] for i, t in zip(ids, texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert b"".join(r.ids for r in parts) == whole[doc]
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 1024 for r in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) == len(best_fit_one_by_one([r.length for r in rows], 1024))
    seqs = packing.sequences(packing.pack_best_fit(frame(spark, TEXTS), path)).collect()
    assert sum(len(r.ids) for r in seqs) == sum(len(whole[i]) for i in range(len(TEXTS)))


def test_no_documents(spark):
    empty = frame(spark, []).limit(0)
    assert packing.pack_best_fit(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert sstable.token_tables(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_token_tables_round_trip(spark, tmp_path):
    texts = TEXTS * 4
    ids = [random.Random(1).choice([None, -5, i, 7]) if i % 9 == 0 else i - 20 for i in range(len(texts))]
    path = public_tokenizers.path("word_bpe_49k.json")
    files = sstable.write_tables(frame(spark, texts, ids).repartition(5), path, f"file://{tmp_path}/t", shards=4)
    rows = sstable.read_tables(files).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))
    at, want = 0, {}
    for i, t in zip(ids, texts):
        want.setdefault(i, []).append(Encoder(path).batch([t], 1)[0])
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
        want[r.doc_id].remove(bytes(r.ids))
    assert not any(want.values())
    for f in files.collect():
        reader = sstable.Store.of(f.path).reader()
        for doc, _, value in reader.scan():
            assert value in reader.lookup(doc)
        assert reader.lookup(10**12) == []


def test_blocks_and_filter(tmp_path):
    with open(tmp_path / "x", "wb") as out:
        w = sstable.Writer(out, 4, block_bytes=300)
        values = {i * 3: np.arange(i % 40, dtype="<u4").tobytes() for i in range(2000)}
        for k, v in values.items():
            w.add(sstable.key_of(k), v)
        for _ in range(50):
            w.add(sstable.key_of(10**9), b"\1\0\0\0")
        w.close()
    r = sstable.Store.of(f"file://{tmp_path}/x").reader()
    assert all(r.lookup(k) == [v] for k, v in values.items()) and len(r.lookup(10**9)) == 50
    assert sum(r.may_have(i * 3 + 1) for i in range(2000)) < 100 and r.blocks > 50
    assert [zlib.crc32(v) for _, _, v in r.scan()][:2000] == [zlib.crc32(v) for v in values.values()]
