import random

import pytest
import numpy as np
import public_tokenizers as public
import tiktoken

from foliant.llm import bpe, queries

RANKS, PATTERN = public.path("byte_bpe_50k.tiktoken"), public.PATTERN


@pytest.fixture(scope="module")
def code():
    return bpe.Bpe(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library(code):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=code.ranks, special_tokens={})


def one_by_one(code, cut):
    """Merges without a tree: the leftmost pair of lowest rank, looked for anew each time."""
    parts = [bytes([b]) for b in cut]
    while True:
        ranks = [code.ranks.get(a + b, code.none) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == code.none:
            return [code.ranks[p] for p in parts]
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_tree_gives_the_leftmost_least():
    rng = random.Random(3)
    for n in (1, 2, 3, 9, 64, 100, bpe.PACKED + 1):
        ranks = [rng.choice([1, 2, 3, 9]) for _ in range(n)]
        tree = bpe.Pairs(ranks, 9)
        for _ in range(min(200, 4 * n)):
            least = min(ranks)
            assert tree.first() == (-1 if least == 9 else ranks.index(least))
            i, r = rng.randrange(n), rng.choice([1, 2, 3, 9])
            ranks[i] = r
            ranks[0] = r
            assert tree.put((i, r), (0, r)) == tree.first()


def test_merges_are_those_of_plain_merging(code):
    rng = random.Random(5)
    for n in (2, 3, 7, 40, 200):
        for letters in ("ab", "aeiounrstl", "é日x-"):
            cut = "".join(rng.choice(letters) for _ in range(n)).encode()
            if cut not in code.ranks:
                assert code.merged(cut) == one_by_one(code, cut)


TEXTS = [
    "", " ", "  \n\n\t x", "It's we'll they'd I'm you've 12345 a1b2", "<|endoftext|> is text", "naïve façade × ÷ ÿ", "日本語 テスト 中文。", "\x00\x01\x1f a\x85b c",
    "🙂🙂 é ٠١", "a" * 20_000, "ab " * 5_000, " " * 3_000 + "x", "=" * 5_000, "zq" * 40_000,
]


def test_ids_are_the_librarys(code, library):
    rng = random.Random(7)
    signs = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    mixed = ["".join(rng.choice(signs[: rng.choice([128, 256, 3000, 70_000, len(signs)])]) for _ in range(200)) for _ in range(300)]
    for text in TEXTS + mixed:
        ids = np.frombuffer(code.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert code.decode(np.array(ids, "<u4").tobytes()) == text.encode()


def test_cache_is_bounded_and_decides_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CACHED", 1000)
    small = bpe.Bpe(RANKS, PATTERN)
    for text in ["one two three four five six seven"] * 3 + ["alphabetagamma deltaepsilon zetaeta"] * 3:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        assert small.held <= 1000 + 10 * 300


def test_tables(spark, code):
    rows = [(i, t, i * 2, "x") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (3, TEXTS[3], 6, "x"), (3, TEXTS[3], 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, _value string")
    out = bpe.decoded(bpe.encoded(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "ids", "_value", "decoded"}
    for r in out:
        assert bytes(r.decoded) == (r.text or "").encode() and bytes(r.ids) == code.encode(r.text or "")
    assert bpe.encoded(docs.where("false"), RANKS, PATTERN).count() == 0
    assert bytes(bpe.decoded(docs.limit(1).select(bpe.F.lit(None).cast("binary").alias("ids")), RANKS, PATTERN).first().decoded) == b""


def test_query_is_the_librarys_over_whole_texts(spark, library):
    from hashlib import sha256

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_byte_level_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
