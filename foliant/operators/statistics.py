"""Statistics: weighted percentiles and modes, boilerplate, Markdown audits, similarity probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window


def weighted_percentile(rows: DataFrame, by: list[str], value: str, weight: str, share: float) -> DataFrame:
    """The least value at which the running weight passes ``share`` of the total.

    Where it meets that exactly the mean with the next value is taken. Weights of equal values
    are added first, so a hot value is one row.
    """
    sums = rows.where(F.col(weight) > 0).groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    order = Window.partitionBy(*by).orderBy("v")
    run = sums.withColumns({"run": F.sum("w").over(order), "total": F.sum("w").over(Window.partitionBy(*by)), "next": F.lead("v").over(order)})
    goal = F.col("total") * share
    first = run.where(F.col("run") >= goal).groupBy(*by).agg(F.min_by(F.struct("v", "run", "next", "total"), "v").alias("x"))
    exact = (F.col("x.run") == F.col("x.total") * share) & F.col("x.next").isNotNull()
    return first.select(*by, F.when(exact, (F.col("x.v") + F.col("x.next")) / 2).otherwise(F.col("x.v")).alias("percentile"))


def dominant_value(rows: DataFrame, by: list[str], value: str, weight: str, order: str) -> DataFrame:
    """The value of the largest total weight; of equals the one seen first by ``order``."""
    sums = rows.groupBy(*by, F.col(value).alias("dominant")).agg(F.sum(weight).alias("w"), F.min(order).alias("seen"))
    return sums.groupBy(*by).agg(F.max_by("dominant", F.struct(F.col("w").alias("w"), (-F.col("seen")).alias("s"))).alias("dominant"))


def boilerplate_lines(docs: DataFrame, top: int = 12, least: int = 8, most: int = 200, share: float = 0.5) -> DataFrame:
    """``line, n_docs``: trimmed lines in at least ``max(2, documents * share + 1)`` documents, the ``top`` commonest."""
    line = F.explode(F.split("text", "\n"))
    lines = docs.select("doc_id", line.alias("raw")).select("doc_id", F.trim("raw").alias("line"))
    counted = lines.where(F.length("line").between(least, most)).distinct().groupBy("line").agg(F.count("*").alias("n_docs"))
    floor = docs.agg(F.greatest(F.lit(2), F.floor(F.count("*") * share) + 1).alias("floor"))
    kept = counted.crossJoin(F.broadcast(floor)).where("n_docs >= floor")  # one row
    return kept.select("line", "n_docs").orderBy(F.desc("n_docs"), "line").limit(top)


def markdown_audit(docs: DataFrame) -> DataFrame:
    """A row of counts for each document: headings, bold lines, tables, bullets, marks, heading density, verdict."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    tokens = F.floor(F.length("text") / 3)
    out = docs.select(
        "doc_id", F.length("text").alias("chars"), count("(?m)^#{1,6} +[^ ]").alias("headings"), count(r"(?m)^\*\*[^*\n]+\*\*$").alias("bold_lines"),
        count(r"(?m)^\|").alias("table_lines"), count(r"(?m)^[-*+] ").alias("bullets"), count("<!-- *page: *[0-9]+ *-->").alias("page_marks"), tokens.cast("long").alias("tokens"),
    )
    density = F.round((F.col("headings") + F.col("bold_lines")) * 1000.0 / F.greatest("tokens", F.lit(1)), 4)
    verdict = F.when(F.col("headings") + F.col("bold_lines") == 0, "no headings").when(F.col("headings") == 0, "bold only").otherwise("headings")
    return out.withColumns({"density": density, "verdict": verdict})


#: Vectors of a block at most, and of a block that is worth a task; rows and columns of the products that are held at once.
BLOCK, LEAST, SIDE = 32768, 512, 512


def _norms(z: np.ndarray) -> np.ndarray:
    total = np.zeros(len(z))
    for d in range(z.shape[1]):
        total += z[:, d].astype(float) ** 2
    return total


def _units(z: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (z / np.sqrt(norms)[:, None]).astype(np.float32)


def _cosines(x: np.ndarray, y: np.ndarray, norms: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows ``i`` of ``x`` and ``j`` of ``y`` in double precision, dimension by dimension."""
    dot = np.zeros(len(i))
    for d in range(x.shape[1]):
        dot += x[i, d].astype(float) * y[j, d]
    return np.clip(dot / np.sqrt(norms[0][i] * norms[1][j]), -1, 1)


def _margin(size: int) -> float:
    """What products of unit vectors in single precision can be wrong by."""
    return 1e-5 + 2e-7 * size


def _true(held: np.ndarray) -> np.ndarray:
    """Places of the true among many false: eight are read at once."""
    whole = len(held) // 8 * 8
    at = np.flatnonzero(held[:whole].view("u8"))
    at = np.concatenate([(at[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(held))])
    return at[held[at]]


def _near(x: np.ndarray, y: np.ndarray, least: float, within: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the units ``x`` and ``y`` whose cosine may be ``least``, and their products, some at a time; ``within``: ``y`` is ``x``, a pair comes once."""
    floor, found = np.float32(least - _margin(x.shape[1])), []
    for low in range(0, len(x), SIDE):
        for left in range(low if within else 0, len(y), SIDE):
            product = x[low : low + SIDE] @ y[left : left + SIDE].T
            at = _true((product >= floor).ravel())
            r, c = np.divmod(at, product.shape[1])
            kept = r < c if within and low == left else slice(None)
            found.append((r[kept] + low, c[kept] + left, product.ravel()[at][kept]))
            if left + SIDE >= len(y) or sum(len(f[0]) for f in found) >= SIDE * SIDE:
                yield tuple(map(np.concatenate, zip(*found)))
                found = []


def _close(x: np.ndarray, y: np.ndarray, least: float, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x`` and ``y`` of a cosine of ``least`` and the cosines, some at a time; ``within``: ``y`` is ``x``, a pair comes once.

    Products of single precision leave out what their error cannot explain; the rest is computed in double precision.
    """
    norms = _norms(x), _norms(y)
    for r, c, _ in _near(_units(x, norms[0]), _units(y, norms[1]), least, within):
        for some in range(0, len(r), 1 << 16):
            i, j = r[some : some + (1 << 16)], c[some : some + (1 << 16)]
            cosine = _cosines(x, y, norms, i, j)
            held = cosine >= least
            yield i[held], j[held], cosine[held]


def _reach(x: np.ndarray, y: np.ndarray, norms: tuple[np.ndarray, np.ndarray], least: float, r: np.ndarray, c: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Which of the rows of ``_near`` reach ``least``; only those within the products' error of it are computed again."""
    held = product >= least + _margin(x.shape[1])
    for some in np.array_split(unsure := np.flatnonzero(~held), len(unsure) // (1 << 16) + 1):
        held[some] = _cosines(x, y, norms, r[some], c[some]) >= least
    return held


def _vectors(table: DataFrame, vector: str, **columns: str) -> DataFrame:
    """``columns``, ``v`` and its ``size`` of rows with a vector that is not null or zero and holds only finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    number = lambda x: x.cast("double")
    kind = "float" if table.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    held = table.select(*[F.col(c).alias(name) for name, c in columns.items()], F.col(vector).cast(f"array<{kind}>").alias("v")).where("key is not null and v is not null")
    return held.where(F.forall("v", lambda x: finite(number(x))) & F.exists("v", lambda x: number(x) * number(x) > 0)).withColumn("size", F.size("v"))


def _dealt(rows: DataFrame, blocks: int, groups: list[str], tasks: int) -> DataFrame:
    """Rows by the pairs of blocks ``i, j`` that they take part in, their own block as ``own``; one with ``i`` equal to ``j``."""
    own, other = F.col("own"), F.col("other")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("key", "v"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.withColumns({"i": F.least(own, other), "j": F.greatest(own, other)}).drop("other").repartition(tasks, *groups, "i", "j")


def _blocks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The vectors of a group of ``_dealt``, the places of its first block's and of its second block's rows, and whether these are one block."""
    own, i, j = (rows.column(c).to_numpy() for c in ("own", "i", "j"))
    v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
    return v, np.flatnonzero(own == i), np.flatnonzero(own == j), bool(i[0] == j[0])


def cosine_duplicates(table: DataFrame, key: str, vector: str, least: float = 0.97) -> DataFrame:
    """``a, b, cosine``: pairs of at least this cosine, ``a`` less than ``b``.

    Vectors are dealt to blocks, and each two blocks are compared by matrix products in one task. Vectors that are
    null or zero or hold a null or what is not finite take no part, nor do null keys; vectors of different sizes are not compared.
    """
    held = _vectors(table, vector, key=key)
    n = held.count()
    blocks = max(1, min(6, n // LEAST), -(-n // BLOCK))
    dealt = _dealt(held, blocks, ["size"], blocks * (blocks + 1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        v, first, second, within = _blocks(rows)
        keys = rows.column("key").combine_chunks()
        for x, y, cosine in _close(v[first], v[second], least, within) if len(first) and len(second) else ():
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(first[x])), keys.take(pa.array(second[y])), pa.array(cosine)], names=["a", "b", "cosine"])

    name = held.schema["key"].dataType.simpleString()
    pairs = dealt.groupBy("size", "i", "j").applyInArrow(compare, f"a {name}, b {name}, cosine double")
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def wasted_slots(ranked: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``query_id, wasted``: hits that repeat one ranked before them; ``ranked(query_id, rank, key)``."""
    first = ranked.select("query_id", F.col("rank").alias("r1"), F.col("key").alias("k1"))
    both = duplicates.select(F.col("a").alias("k1"), F.col("b").alias("key")).union(duplicates.select("b", "a"))
    hits = ranked.join(both, "key").join(first, ["query_id", "k1"]).where("r1 < rank").select("query_id", "rank").distinct()
    return ranked.select("query_id").distinct().join(hits.groupBy("query_id").agg(F.count("*").alias("wasted")), "query_id", "left").withColumn("wasted", F.coalesce("wasted", F.lit(0)))


def vector_repeats(table: DataFrame, by: str, key: str, vector: str, least: float = 0.97) -> DataFrame:
    """``query_id, wasted``: ``wasted_slots`` of the pairs of ``cosine_duplicates`` if each ``by`` ranks its rows by ``key``.

    Only vectors of one ``by`` are compared, equal ones as the first of them, and one that repeats an earlier one is not
    compared again in its task. If rows of a key have different vectors, all pairs are made, since any of them counts.
    """
    held = _vectors(table, vector, key=key, query_id=by)
    _, repeated, differ = _repeated(held, "v")
    if differ:
        rank = F.row_number().over(Window.partitionBy(by).orderBy(key))
        return wasted_slots(table.select(F.col(by).alias("query_id"), F.col(key).alias("key"), rank.alias("rank")), cosine_duplicates(table, key, vector, least))
    held = held.where("query_id is not null")
    rows, queries, most = held.groupBy("query_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.coalesce(F.max("count"), F.lit(0))).first()
    blocks = max(1, min(3, most // (8 * LEAST)), -(-most // BLOCK))
    tasks = max(-(-rows * blocks // BLOCK), min(queries * blocks * (blocks + 1), 200), 1)
    counted = held.groupBy("size", "query_id", "key", "v").agg(F.count("*").alias("n")) if repeated else held.withColumn("n", F.lit(1).cast("long"))
    alike = counted.groupBy("size", "query_id", "v").agg(F.min_by("n", "key").alias("n"), (F.sum("n") - F.min_by("n", "key")).alias("more"), F.min("key").alias("key"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        v, first, second, within = _blocks(rows)
        keys, n, more = rows.column("key").combine_chunks(), rows.column("n").to_numpy(), rows.column("more").to_numpy()
        order = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        norms, all_ = _norms(v), np.arange(len(n))
        units, both, found = _units(v, norms), (norms, norms), np.zeros(len(n), bool)
        for earlier, later in [(first, second)] if within else [(first, second), (second, first)]:
            earlier = earlier[np.argsort(order[earlier])]
            for low in range(0, len(earlier), SIDE):
                some = earlier[low : low + SIDE]
                later = later[~found[later] & (order[later] > order[some[0]])]
                for r, c, product in _near(units[some], units[later], least):
                    r, c = some[r], later[c]
                    before = order[r] < order[c]
                    r, c = r[before], c[before]
                    found[c[_reach(v, v, both, least, r, c, product[before])]] = True
        more = more * (_cosines(v, v, both, all_, all_) >= least) * within
        kept = np.flatnonzero(found | (more > 0))
        yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().take(pa.array(kept)) for c in ("query_id", "key")), pa.array((n * found)[kept]), pa.array(more[kept])], names=["query_id", "key", "n", "more"])

    kinds = {f.name: f.dataType.simpleString() for f in alike.schema}
    dealt = _dealt(alike, blocks, ["size", "query_id"], tasks)
    found = dealt.groupBy("size", "query_id", "i", "j").applyInArrow(find, f"query_id {kinds['query_id']}, key {kinds['key']}, n long, more long")
    each = found.groupBy("query_id", "key").agg((F.max("n") + F.max("more")).alias("n")).groupBy("query_id").agg(F.sum("n").alias("wasted"))
    return table.select(F.col(by).alias("query_id")).distinct().join(each, "query_id", "left").withColumn("wasted", F.coalesce("wasted", F.lit(0).cast("long")))


def fingerprints(items: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """``by, fingerprint``: 16 hex digits of the SHA-1 of the texts in order."""
    one = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x"))
    return one.select(by, F.substring(F.sha1(F.array_join(F.transform("x", lambda t: t[text]), "\n")), 1, 16).alias("fingerprint"))


def spread(items: DataFrame, order: str, limit: int) -> DataFrame:
    """``limit`` items evenly spaced by ``order``, in order."""
    n = items.count()
    if n <= limit:
        return items
    at = F.row_number().over(Window.orderBy(order)) - 1
    picked = [i * n // limit for i in range(limit)]
    return items.withColumn("_at", at).where(F.col("_at").isin(picked)).drop("_at")


def duplication(duplicates: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, chunks, repeated, pairs, across``: how much of each document repeats elsewhere.

    ``duplicates(a, b)`` are pairs of like chunks, ``chunks(key, doc_id)`` all of them. Repeated: chunks that are in any pair;
    pairs: those that touch the document, once each; across: those of them with another document.
    """
    first, second = (chunks.select(F.col("key").alias(k), F.col("doc_id").alias(f"doc_{k}")) for k in ("a", "b"))
    met = duplicates.select("a", "b").join(first, "a").join(second, "b")
    ends = met.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("doc_a").alias("doc_id")), F.struct(F.col("b").alias("key"), F.col("doc_b").alias("doc_id")))).alias("x"), "a", "b", (F.col("doc_a") != F.col("doc_b")).alias("across"))
    touched = ends.select("x.key", "x.doc_id", "a", "b", "across")
    repeated = touched.groupBy("doc_id").agg(F.count_distinct("key").alias("repeated"))
    pairs = touched.select("doc_id", "a", "b", "across").distinct().groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum(F.col("across").cast("long")).alias("across"))
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sizes.join(repeated, "doc_id", "left").join(pairs, "doc_id", "left").select("doc_id", "chunks", zero("repeated"), zero("pairs"), zero("across"))


def _repeated(rows: DataFrame, *kept: str) -> tuple[int, bool, bool]:
    """The number of keys, whether some rows share a key, and whether some of those differ in ``kept``."""
    one = rows.select("key", F.xxhash64(*kept).alias("h")).groupBy("key").agg(F.count("*").alias("n"), (F.min("h") != F.max("h")).alias("differ"))
    found = one.agg(F.count("*").alias("keys"), F.max("n").alias("most"), F.max("differ").alias("differ")).first()
    return found.keys, (found.most or 0) > 1, bool(found.differ)


def vector_duplication(table: DataFrame, key: str, doc: str, vector: str, least: float = 0.97) -> DataFrame:
    """``duplication`` of the pairs of ``cosine_duplicates``, which are counted where they are found.

    Equal vectors of a document are one, with their number; no pair leaves its task. A row repeated whole counts once. If
    rows of a key differ, their pairs have to be told apart by key: then all pairs are made.
    """
    held = _vectors(table, vector, key=key, doc=doc)
    keys, repeated, differ = _repeated(held, "doc", "v")
    sizes = table.groupBy(F.col(doc).alias("doc_id")).agg(F.count("*").alias("chunks"))
    if differ:
        row = F.struct(F.col(key).alias("key"), F.col(doc).alias("doc"))
        pairs = cosine_duplicates(table.where(F.col(key).isNotNull()).select(row.alias("row"), vector), "row", vector, least).where("a.key != b.key")
        end = lambda c: F.struct(F.col(f"{c}.doc").alias("doc_id"), F.col(f"{c}.key").alias("key"))
        ends = pairs.select(F.explode(F.array(end("a"), end("b"))).alias("x"), F.col("a.key").alias("a"), F.col("b.key").alias("b"), (F.col("a.doc") != F.col("b.doc")).cast("long").alias("across"))
        met = ends.groupBy("x.doc_id").agg(F.count_distinct("x.key").alias("repeated"))
        pairs = ends.select("x.doc_id", "a", "b", "across").distinct().groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum("across").alias("across"))
        found = met.join(pairs, "doc_id")
    else:
        once = held.dropDuplicates(["key"]) if repeated else held
        alike = once.groupBy("size", "v", "doc").agg(F.min("key").alias("key"), F.count("*").alias("n"))
        blocks = max(1, min(6, keys // LEAST), -(-keys // BLOCK))
        dealt = _dealt(alike, blocks, ["size"], blocks * (blocks + 1))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(list(batches)).combine_chunks()
            v, first, second, within = _blocks(rows)
            n, docs = rows.column("n").to_numpy(), rows.column("doc").combine_chunks()
            code = docs.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            norms, all_ = _norms(v), np.arange(len(n))
            units, both = _units(v, norms), (norms, norms)
            own, across, met = np.zeros(len(n), "i8"), np.zeros(len(n), "i8"), np.zeros(len(n), bool)
            weighed = lambda at, by: np.bincount(at, n[by], len(n)).astype("i8")
            for r, c, product in _near(units[first], units[second], least, within) if len(first) and len(second) else ():
                r, c = first[r], second[c]
                held = _reach(v, v, both, least, r, c, product)
                r, c = r[held], c[held]
                met[r] = met[c] = True
                apart = code[r] != code[c]
                own += weighed(r[~apart], c[~apart])
                r, c = r[apart], c[apart]
                own += weighed(r, c) + weighed(c, r)
                known = (code[r] >= 0) & (code[c] >= 0)
                across += weighed(r[known], c[known]) + weighed(c[known], r[known])
            own, across = own * n, across * n
            if within:
                copies = (n > 1) & (_cosines(v, v, both, all_, all_) >= least)
                own += copies * (n * (n - 1) // 2)
                met |= copies
            kept = pa.array(np.flatnonzero(met))
            yield pa.RecordBatch.from_arrays([docs.take(kept), rows.column("key").combine_chunks().take(kept), *(pa.array(x[met]) for x in (n, own, across))], names=["doc_id", "key", "n", "pairs", "across"])

        kinds = {f.name: f.dataType.simpleString() for f in alike.schema}
        counted = dealt.groupBy("size", "i", "j").applyInArrow(count, f"doc_id {kinds['doc']}, key {kinds['key']}, n long, pairs long, across long")
        each = counted.groupBy("doc_id", "key").agg(F.max("n").alias("n"), F.sum("pairs").alias("pairs"), F.sum("across").alias("across"))
        found = each.groupBy("doc_id").agg(F.sum("n").alias("repeated"), F.sum("pairs").alias("pairs"), F.sum("across").alias("across"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sizes.join(found, "doc_id", "left").select("doc_id", "chunks", zero("repeated"), zero("pairs"), zero("across"))


def audit_depth(nodes: DataFrame) -> DataFrame:
    """``doc_id, nodes, depth, top, longest_path``: the tree that a document's headings would make, of ``trees.heading_nodes``."""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.sum((F.col("depth") == 1).cast("long")).alias("top"), F.max(F.size("path")).alias("longest_path"))
