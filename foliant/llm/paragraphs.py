"""Repeated passages: MinHash banding of paragraphs, exact Jaccard, components of removals.

A passage that documents share stands anywhere in a line, so paragraphs are anchored by
content: a paragraph is the ``WORDS`` words from an anchor on, and an anchor is the least
five-word shingle of some ``SPREAD`` neighbouring ones. A shared passage of
``WORDS + SPREAD`` - 1 words therefore has a paragraph in common, wherever it stands. A text of
fewer than ``WORDS`` words, but a shingle at least, is one paragraph.

Equal paragraphs are one node. Bands of one MinHash each give the chance of
``1 - (1 - 0.8) ** BANDS`` that two paragraphs of similarity 0.8 meet (passages have
several paragraphs). Those that meet are verified by the exact Jaccard similarity of their
shingles; crowded buckets are dealt to pairs of chunks, each of which is compared in full
and returns a spanning forest of the links it finds. Connected components of the links are
classes; the first occurrence of a class stays, the others are removals. Banding and
verification see a paragraph once a text; removals are made of every occurrence, each grown
word by word to both sides for as long as it agrees with an earlier occurrence. A passage that
has whole windows of anchors ends at most ``SPREAD`` - 1 words from its outermost paragraphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from foliant.functions.arrays import runs
from foliant.llm.components import components, dealt_anew
from foliant.llm.filters import filter_of, may_hold
from foliant.llm.storage import delete, written
from foliant.llm.tokens import slices
from foliant.llm.wordhash import Words, mix, shingles, sliding, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
WORDS, SPREAD = 25, 26
BANDS = 2
#: Members of a bucket that are compared at once; those compared pair by pair.
CHUNK, FEW = 4096, 24
#: Words beside an occurrence that it is grown over; bytes that are compared of a word's hash.
SIDE, HELD = SPREAD - 1, 3
SEEDS = [0x51ED27, 0xC0FFEE]
N_SHINGLES = WORDS - SHINGLE + 1
MOST = np.uint64((1 << 64) - 1)


def paragraphs_of(texts: pa.Array, again: bool = False, words: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, shingle hashes) of the paragraphs of a batch, without repeats in a text.

    ``again``: with them; of a run of equal shingles every ``WORDS``-th is an anchor. ``words``: those of
    the texts, if known.
    """
    words = words or word_hashes(texts)
    first = words.first
    counts = np.diff(first)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, N_SHINGLES), np.uint64)
    value = np.concatenate((shingles(words.hash, SHINGLE), np.zeros(SHINGLE - 1, np.uint64)))[: len(words.hash)]
    # texts are set SPREAD places apart, where nothing is the least
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.where(counts < WORDS, (counts >= SHINGLE).astype(np.int64), counts - WORDS + 1)
    nth = np.arange(len(text)) - first[text]
    may = nth < starts[text]
    place = first[text] + SPREAD * (text + 1) + nth
    size = len(text) + SPREAD * (len(counts) + 2)
    line = np.full(size, MOST)
    line[place[may]] = value[may]
    least = sliding(line, SPREAD, np.minimum)
    inside = np.zeros(size, bool)  # windows of whole SPREAD, or the one window of a short text
    inside[place[may & (nth + SPREAD <= starts[text])]] = True
    short = np.flatnonzero((starts > 0) & (starts < SPREAD))
    inside[first[short] + SPREAD * (short + 1)] = True
    least[~inside] = 0
    back = np.concatenate((np.zeros(SPREAD - 1, np.uint64), least))[:size]  # the window that ends here begins SPREAD - 1 before
    chosen = (sliding(back, SPREAD, np.maximum) == line) & (line != MOST)
    goes_on = np.zeros(size, bool)
    goes_on[1:] = chosen[1:] & chosen[:-1] & (line[1:] == line[:-1])
    if again:
        nth_of_run = np.arange(size) - np.maximum.accumulate(np.where(goes_on, 0, np.arange(size)))
        goes_on &= nth_of_run % WORDS != 0
    chosen &= ~goes_on
    at = np.flatnonzero(chosen[place] & may)
    last = np.minimum(N_SHINGLES - 1, counts[text[at]] - SHINGLE - nth[at])  # of a short text; it repeats
    sets = value[at[:, None] + np.minimum(np.arange(N_SHINGLES), last[:, None])]
    if again:
        return text[at], nth[at], sets
    _, once = np.unique(np.stack((text[at].astype(np.uint64), signature(sets))), axis=1, return_index=True)
    once.sort()
    return text[at][once], nth[at][once], sets[once]


def signature(sets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(sets), np.uint64)
    for k in range(sets.shape[1]):
        total = total * np.uint64(0x100000001B3) + sets[:, k]
    return mix(total, 99)


def minhash(sets: np.ndarray, band: int) -> np.ndarray:
    """The band's MinHash, mixed with its number."""
    return mix(mix(sets, SEEDS[band]).min(axis=1) if len(sets) else np.zeros(0, np.uint64), band + 1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


PARAGRAPHS = "doc_id long, row long, word int, sig long, " + ", ".join(f"h{b} long" for b in range(BANDS))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, row, word, sig, h0, h1``: every paragraph of ``docs(doc_id, text)``; row numbers the input rows."""
    names = [x.split()[0] for x in PARAGRAPHS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                text, word, sets = paragraphs_of(some.column("text"))
                columns = [some.column("doc_id").take(pa.array(text)), pa.array(row + text), pa.array(word.astype(np.int32)), _long(signature(sets))]
                yield pa.RecordBatch.from_arrays([*columns, *[_long(minhash(sets, b)) for b in range(BANDS)]], names=names)
                row += some.num_rows

    return _texts(docs).mapInArrow(read, PARAGRAPHS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sig, content`` (32 bits of each shingle's hash) of the paragraphs of ``docs`` whose signature is in ``wanted(sig)``."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select(F.col("sig").alias("key"))))
    schema = pa.schema([("sig", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                _, _, sets = paragraphs_of(some.column("text"))
                sig = signature(sets)
                hit = may_hold(held, sig)
                hit = hit[np.unique(sig[hit], return_index=True)[1]]
                rows = np.ascontiguousarray(sets[hit].astype("<u4"))
                content = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([_long(sig[hit]), content], schema=schema)

    found = _texts(docs).mapInArrow(read, "sig long, content binary")
    return found.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("content").alias("content"))


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, row, word, size, sig, around``: every occurrence in ``docs`` of what may be in ``wanted(sig)``, repeats in a text too."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select(F.col("sig").alias("key"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                words = word_hashes(some.column("text"))
                text, word, sets = paragraphs_of(some.column("text"), again=True, words=words)
                sig = signature(sets)
                hit = may_hold(bits.value, sig)
                text, word, sig = text[hit], word[hit], sig[hit]
                near = pa.array([r.tobytes() for r in around(words, text, word)], pa.binary())
                size = np.minimum(WORDS, np.diff(words.first)[text] - word)
                columns = [some.column("doc_id").take(pa.array(text)), pa.array(row + text), pa.array(word.astype(np.int32)), pa.array(size.astype(np.int32)), _long(sig), near]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "word", "size", "sig", "around"])
                row += some.num_rows

    return _texts(docs).mapInArrow(read, "doc_id long, row long, word int, size int, sig long, around binary")


def around(words: Words, text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """``HELD`` bytes of the hashes of ``SIDE`` words on both sides of each paragraph and of its outermost shingles; 0 beyond the text."""
    beside = np.r_[-SIDE:SHINGLE, WORDS - SHINGLE : WORDS + SIDE]
    at = (words.first[text] + word)[:, None] + beside
    inside = (at >= words.first[text][:, None]) & (at < words.first[text + 1][:, None])
    out = np.zeros(at.shape, "<u4")
    out[inside] = np.maximum(words.hash[at[inside]] >> np.uint64(64 - 8 * HELD), np.uint64(1))
    return out.view(np.uint8).reshape(*at.shape, 4)[:, :, :HELD].reshape(len(at), HELD * len(beside))


def agreement(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words beside the paragraphs ``x`` agree with ``y``, to the left and right; rows as in ``around``.

    Nothing agrees beside an outermost shingle that differs.
    """
    x, y = (z.reshape(len(z), z.shape[1] // HELD, HELD) for z in (x, y))
    same = (x == y).all(axis=2) & x.any(axis=2)
    half = SIDE + SHINGLE
    left = np.logical_and.accumulate(same[:, :half][:, ::-1], axis=1).sum(axis=1)
    right = np.logical_and.accumulate(same[:, half:], axis=1).sum(axis=1)
    return np.maximum(left - SHINGLE, 0), np.maximum(right - SHINGLE, 0)


GROWN = "doc_id long, row long, word int, class_id long, kept boolean, start int, end int"


def grown(found: DataFrame) -> DataFrame:
    """``GROWN`` from ``found``, which has ``around`` and the earlier occurrences' ``own_around`` and ``first_around`` too."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("word", pa.int32()), ("class_id", pa.int64()), ("kept", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "around", 1 << 22):
                x, own, first = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(some.num_rows, HELD * (2 * (SIDE + SHINGLE))) for c in ("around", "own_around", "first_around"))
                sides = agreement(x, first)
                is_own = some.column("is_own").to_numpy(zero_copy_only=False)  # agrees with itself, which says nothing
                left, right = (np.maximum(a, np.where(is_own, 0, b)) for a, b in zip(sides, agreement(x, own)))
                word, size = some.column("word").to_numpy(), some.column("size").to_numpy()
                columns = [*(some.column(c) for c in ("doc_id", "row", "word", "class_id", "kept")), pa.array((word - left).astype(np.int32)), pa.array((word + size + right).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return found.mapInArrow(read, GROWN)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = set(np.frombuffer(a, "<u4").tolist()), set(np.frombuffer(b, "<u4").tolist())
    return len(x & y) / max(1, len(x | y))


def _forest(sigs: list[int], contents_: list[bytes], parts: list[int], cross: bool, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs of ``similarity``; ``cross``: only pairs of different parts.

    Sets of a similarity share one of their rarest shingles, as many as they may differ in and one more: a node is compared
    with those nodes alone that it meets there, and with none that a link has reached before.
    """
    if len(sigs) <= FEW:
        return _forest_of_few(sigs, contents_, parts, cross, similarity)
    values = np.frombuffer(b"".join(contents_), "<u4").reshape(len(sigs), -1)
    distinct, codes = np.unique(values, return_inverse=True)
    codes, none = np.sort(codes.reshape(values.shape), axis=1), len(distinct)
    codes[:, 1:][codes[:, 1:] == codes[:, :-1]] = none  # repeats count once
    often = np.bincount(codes.ravel(), minlength=none + 1)[:none]
    rank = np.full(none + 1, none)
    rank[np.argsort(often, kind="stable")] = np.arange(none)
    codes = np.sort(rank[codes], axis=1)
    sizes = (codes < none).sum(axis=1)
    rarest = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    of = np.arange(codes.shape[1]) < rarest[:, None]
    listed, member = codes[of], np.nonzero(of)[0]
    order = np.argsort(listed, kind="stable")
    listed, member = listed[order], member[order]
    first, last = np.searchsorted(listed, codes), np.searchsorted(listed, codes, "right")
    left = (of & (last - first > 1)).any(axis=1)
    part, held, out = np.array(parts), np.zeros(none + 1, np.uint8), []
    for start in np.flatnonzero(left).tolist():
        reached, left[start] = [start] if left[start] else [], False
        while reached:
            x = reached.pop()
            near = np.concatenate([member[i:j] for i, j in zip(first[x, : rarest[x]].tolist(), last[x, : rarest[x]].tolist())])
            near = np.unique(near[left[near] & (part[near] != part[x])] if cross else near[left[near]])
            if not len(near):
                continue
            held[codes[x, : sizes[x]]] = 1
            both = held[codes[near]].sum(axis=1, dtype=np.int64)
            held[codes[x, : sizes[x]]] = 0
            hit = near[both >= similarity * (sizes[x] + sizes[near] - both)].tolist()
            left[hit] = False
            out += [(sigs[x], sigs[y]) for y in hit]
            reached += hit
    return out


def _forest_of_few(sigs: list[int], contents_: list[bytes], parts: list[int], cross: bool, similarity: float) -> list[tuple[int, int]]:
    sets = [frozenset(np.frombuffer(c, "<u4").tolist()) for c in contents_]
    up = list(range(len(sigs)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, x in enumerate(sets):
        for j in range(i):
            if cross and parts[i] == parts[j]:
                continue
            y = sets[j]
            both = len(x & y)
            if both >= similarity * (len(x) + len(y) - both) and top(i) != top(j):
                up[top(i)] = top(j)
                out.append((sigs[i], sigs[j]))
    return out


def verified_links(met: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: links among ``met(h, sig, content)``, which hold each (h, sig) once."""
    sizes = met.groupBy("h").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).select(dealt_anew("h").alias("h"), "chunks")
    met = met.join(sizes, "h").withColumn("part", F.pmod(F.xxhash64("sig"), "chunks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sig", "content")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> list[tuple[int, int]]:
            return _forest([r[0] for r in held], [r[1] for r in held], [r[2] for r in held], key[1] != key[2], similarity) if len(held) > 1 else []

        for batch in batches:
            out = []
            for h, i, j, part, sig, content in zip(*(batch.column(c).to_pylist() for c in ("h", "i", "j", "part", "sig", "content"))):
                if (h, i, j) != key:
                    out += links() if key else []
                    key, held = (h, i, j), []
                held.append((sig, content, part))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], []))], schema=schema)
        out = links() if key else []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], []))], schema=schema)

    # every group is bounded: two chunks at most
    dealt = met.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "sig")
    return dealt.mapInArrow(read, "a long, b long").distinct()


def _beside(found: DataFrame, own: DataFrame) -> DataFrame:
    """``sig, own_around``: what is around the first occurrence of each of ``own``; other rows do not reach an exchange."""
    places = own.select("sig", F.col("own.row").alias("row"), F.col("own.word").alias("word"))
    key = F.xxhash64("sig", "row", "word")
    bits = found.sparkSession.sparkContext.broadcast(filter_of(places.select(key.alias("key"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = may_hold(bits.value, batch.column("key").to_numpy())
            yield batch.select(["sig", "row", "word", "around"]).take(pa.array(hit))

    some = found.select("sig", "row", "word", "around", key.alias("key")).mapInArrow(read, "sig long, row long, word int, around binary")
    return some.join(places, ["sig", "row", "word"]).select("sig", F.col("around").alias("own_around"))


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, row, word, class_id, kept, start, end``: each occurrence of a paragraph of ``docs(doc_id, text)`` whose class occurs in another row.

    ``word`` is the number of its first word; ``class_id`` a number of the class; ``kept``
    marks the occurrence that stays, the first by doc_id (null ids last), row and word, and what
    overlaps it; ``start`` to ``end`` (exclusive) are its words and those beside it that agree with
    an earlier occurrence. Further copies in the first one's text do not stay. Null and empty texts, and
    those of fewer words than a shingle, have no paragraphs. Repeated rows are documents
    of their own. No rows: no rows. Other columns are not read.
    """
    all_ = written(paragraphs(docs).drop("doc_id", "word"), "paragraphs")
    bands = F.explode(F.array(*[f"h{b}" for b in range(BANDS)]))
    keyed = all_.select("row", "sig", bands.alias("h"))
    shared = keyed.groupBy("h").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low != high")
    shared = shared.select(dealt_anew("h").alias("h"))  # neighbours in one text overlap and meet: those alone are left out
    met_at_all = written(keyed.join(shared, "h", "left_semi").select("h", "sig").distinct(), "paragraphs-met")
    several = met_at_all.groupBy("h").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low != high")
    met = written(met_at_all.join(several.select(dealt_anew("h").alias("h")), "h", "left_semi"), "paragraphs-several")
    wanted = written(met.select("sig").distinct(), "paragraphs-wanted")
    held = written(contents(docs, wanted), "paragraph-contents")  # written: a join may read a side once more for its filter, and this one reads the texts
    links = written(verified_links(met.join(held.select(dealt_anew("sig").alias("sig"), "content"), "sig").select("h", "sig", "content"), similarity), "paragraph-links")
    roots = written(components(links), "paragraph-roots")

    rows = all_.groupBy("sig").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    known = rows.join(roots.withColumnRenamed("node", "sig"), "sig", "left").where("low != high or root is not null")
    known = written(known.select("sig", F.coalesce("root", "sig").alias("class_id")), "paragraph-classes")
    delete(all_, met, met_at_all, wanted, held, links, roots)
    found = written(occurrences(docs, known.select("sig")), "paragraphs-everywhere")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "word")
    own = found.groupBy("sig").agg(F.min(place).alias("own"), F.min("row").alias("low"), F.max("row").alias("high"))
    own = written(own.join(known.withColumn("sig", dealt_anew("sig")), "sig"), "paragraphs-own")  # the first occurrence of each
    first = own.groupBy("class_id").agg(F.min(F.struct("own", "sig")).alias("x"), (F.min("low") != F.max("high")).alias("apart")).where("apart")
    first = first.select(dealt_anew("class_id").alias("class_id"), F.col("x.own").alias("first"), F.col("x.sig").alias("first_sig"))
    own = written(own.join(first, "class_id").select("sig", "class_id", "own", "first", "first_sig"), "paragraphs-first")
    beside = written(_beside(found, own), "paragraphs-beside")
    other = own.where("sig != first_sig").select("sig", "first_sig").join(beside.select(dealt_anew("sig").alias("first_sig"), F.col("own_around").alias("first_around")), "first_sig")
    own = own.join(beside, "sig").join(other.select(dealt_anew("sig").alias("sig"), "first_around"), "sig", "left")
    own = own.select(dealt_anew("sig").alias("sig"), "class_id", "own", "first", "own_around", F.coalesce("first_around", "own_around").alias("first_around"))
    kept = (F.col("first.row") == F.col("row")) & (F.col("word") < F.col("first.word") + WORDS)
    is_own = (F.col("own.row") == F.col("row")) & (F.col("own.word") == F.col("word"))
    return grown(found.join(own, "sig").select("doc_id", "row", "word", "size", "class_id", kept.alias("kept"), is_own.alias("is_own"), "around", "own_around", "first_around"))


def removals(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document with repeats: ``doc_id, row, spans, removed_words, class_ids``.

    ``spans``: merged runs of words to remove, ``first-end`` (end exclusive), comma-joined; it is
    empty for a document that only holds the occurrences that stay. ``class_ids``: sorted.
    """
    found = repeated_paragraphs(docs, similarity)
    one = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_set("class_id")).alias("class_ids"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.struct("start", "end")))).alias("parts"),
    )

    joined = lambda run: F.struct(run[0]["start"].alias("start"), F.array_max(F.transform(run, lambda p: p["end"])).alias("end"))
    merged = F.when(F.size("parts") > 0, F.transform(runs(F.col("parts"), touching=True), joined)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    one = one.withColumn("runs", merged)
    spans = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return one.select("doc_id", "row", spans.alias("spans"), total.alias("removed_words"), "class_ids")
