"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns a unit vector by fast Hadamard transforms with random signs and hashes it
to the nearest signed axis. A query probes the buckets of its nearest axes in each table;
what it meets there is ranked by the exact inner product in double precision. The number
of probes is fitted on a bounded sample of the vectors, by measured recall; where nothing less
reaches it, every bucket is probed, which is an exact scan.

Equal vectors are one class with the smallest of its ids, so no bucket holds copies. A
bucket with many classes is dealt to chunks, and so are the queries that probe it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from foliant.llm.components import dealt_anew
from foliant.llm.storage import written

TABLES = 12
#: Bound of the vectors that the number of probes is fitted on, and of the queries among them.
SAMPLE, SAMPLE_QUERIES = 4096, 256
RECALL = 0.96
#: Candidates that a group returns beside those asked for, as scores are computed anew before they are ranked.
SPARE = 4
#: Classes and queries that meet in one group.
CHUNK, QUERY_CHUNK = 4096, 16384
MATCHES = "query_id long, rank int, vec_id long, score double"


class Hash:
    """The random rotations; the same for the same width and seed."""

    def __init__(self, width: int, polytopes: int = 1, seed: int = 17) -> None:
        self.dims = 1 << max(1, (width - 1).bit_length())
        self.polytopes = polytopes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (TABLES, polytopes, 3, self.dims))

    def turned(self, x: np.ndarray, table: int, polytope: int) -> np.ndarray:
        y = np.zeros((len(x), self.dims))
        y[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for sign in self.signs[table, polytope]:
            y = y * sign
            h = 1
            while h < self.dims:  # a Hadamard transform in dims * log(dims) steps
                z = y.reshape(len(x), -1, 2, h)
                y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), 2).reshape(len(x), self.dims)
                h *= 2
            y /= self.dims**0.5
        return np.concatenate((y, -y), axis=1)

    def buckets(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """For each vector its ``probes`` nearest buckets, nearest first."""
        near = [self.turned(x, table, p) for p in range(self.polytopes)]
        if self.polytopes == 1:
            return np.argsort(-near[0], axis=1, kind="stable")[:, :probes]
        most = min(2 * self.dims, 32)
        first, second = (np.argsort(-y, axis=1, kind="stable")[:, :most] for y in near)
        total = np.take_along_axis(near[0], first, 1)[:, :, None] + np.take_along_axis(near[1], second, 1)[:, None, :]
        best = np.argsort(-total.reshape(len(x), -1), axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(first, best // most, 1) * 2 * self.dims + np.take_along_axis(second, best % most, 1)


def fit_probes(sample: np.ndarray, hash_: Hash, k: int) -> int:
    """The fewest probes a table of one polytope with which a sample's own neighbours are found.

    More vectors bring neighbours closer, so recall on all of them is higher.
    """
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    exact = queries @ sample.T
    k = min(k + 1, len(sample))
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    most = 2 * hash_.dims  # all buckets of one polytope
    first = np.full(best.shape, most)  # the probe that finds each neighbour
    for t in range(TABLES):
        own, probes = hash_.buckets(sample, t, 1)[:, 0], hash_.buckets(queries, t, most)
        same = own[best][:, :, None] == probes[:, None, :]
        first = np.minimum(first, np.where(same.any(2), same.argmax(2), most))
    found = np.array([(first < p).mean() for p in range(1, most + 1)])
    return int(np.argmax(found >= RECALL)) + 1


def vectors(table: DataFrame, vec_id: str, embedding: str, width: int, kind: str) -> DataFrame:
    """``vec_id, v`` (bytes of the padded vector) of the rows that take part."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("e").to_pylist()):
                x = np.array([np.nan if c is None else c for c in x], dtype=kind)
                if np.isfinite(x).all() and x.any():
                    y = np.zeros(width, dtype=kind)
                    y[: len(x)] = x + 0.0
                    ids.append(i)
                    out.append(y.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).mapInArrow(read, "vec_id long, v binary").distinct()


def nearest(table: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each row whose ``vec_id`` is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``, ties to the smaller ``vec_id``; fewer rows where
    there are fewer candidates. Vectors that are null, zero, or hold a null or a non-finite
    component take no part, nor do rows with a null id. A shorter vector counts as padded with
    zeros. A row that is repeated counts once. No rows: no rows. Other columns are not read.
    """
    spark = table.sparkSession
    element = table.schema[embedding].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    width = table.agg(F.max(F.size(embedding))).first()[0] or 0
    if width < 1:
        return spark.createDataFrame([], MATCHES)
    rows = written(vectors(table, vec_id, embedding, width, kind), "ann-vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)  # Spark cuts each group to k + 1 rows before the exchange
    classes = written(kept.groupBy("v").agg(F.min("vec_id").alias("cid"), F.collect_list("vec_id").alias("ids")), "ann-classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], MATCHES)
    asked = written(rows.where(F.col("vec_id") % every == 0).join(classes.select("v", "cid"), "v").select("vec_id", "cid"), "ann-queries")
    queries = asked.select("cid").distinct().join(classes.select("cid", "v"), "cid")

    hash_ = Hash(width)
    share = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / n) * (1 << 20)) + 1
    sample = b"".join(bytes(r["v"]) for r in classes.where(share).select("v").limit(2 * SAMPLE).collect())
    found = np.frombuffer(sample, kind).reshape(-1, width).astype(np.float64)
    probes = fit_probes(found, hash_, k) if len(found) else 1

    hashed_schema = pa.schema([("t", pa.int32()), ("bucket", pa.int64()), ("cid", pa.int64()), ("v", pa.binary())])

    def hashed(probes: int):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.frombuffer(b"".join(batch.column("v").to_pylist()), kind).reshape(-1, width).astype(np.float64)
                for t in range(TABLES):
                    b = hash_.buckets(x, t, probes)
                    row = np.repeat(np.arange(len(x)), b.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(b.ravel().astype(np.int64)), batch.column("cid").take(pa.array(row)), batch.column("v").take(pa.array(row))], schema=hashed_schema)

        return read

    columns = "t int, bucket long, cid long, v binary"
    index = classes.select("cid", "v").mapInArrow(hashed(1), columns)
    probed = queries.select("cid", "v").mapInArrow(hashed(probes), columns)
    sizes = index.groupBy("t", "bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asking = probed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("parts"))
    dealt = F.broadcast(written(sizes.join(asking, ["t", "bucket"]), "ann-buckets"))  # at most tables * buckets rows
    key = ["t", "bucket", "chunk", "part"]
    number = F.xxhash64("cid")
    index = index.join(dealt, ["t", "bucket"]).withColumn("chunk", F.pmod(number, "chunks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    probed = probed.join(dealt, ["t", "bucket"]).withColumn("part", F.pmod(number, "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"cid": [], "near": [], "scores": []}
        if len(left) and len(right):
            c = np.frombuffer(b"".join(left["v"]), kind).reshape(-1, width).astype(np.float64)
            ids = left["cid"].to_numpy()
            order = np.argsort(ids, kind="stable")
            c, ids = c[order], ids[order]
            for i in range(0, len(right), 512):
                some = right.iloc[i : i + 512]
                q = np.frombuffer(b"".join(some["v"]), kind).reshape(-1, width).astype(np.float64)
                best = _top(q @ c.T, min(k + 1 + SPARE, len(ids)))
                out["cid"] += some["cid"].tolist()
                out["near"] += list(ids[best])
                out["scores"] += list(_products(q, c, best))
        return pd.DataFrame(out)

    met = index.select(*key, "cid", "v").groupBy(key).cogroup(probed.select(*key, "cid", "v").groupBy(key)).applyInPandas(rank, "cid long, near array<long>, scores array<double>")

    def merge(one: pd.DataFrame) -> pd.DataFrame:
        near, scores = np.concatenate(one["near"].to_list()), np.concatenate(one["scores"].to_list())
        near, first = np.unique(near, return_index=True)
        scores = scores[first]
        best = np.lexsort((near, -scores))[: k + 1]
        return pd.DataFrame({"cid": one["cid"].iloc[0], "near": near[best], "score": scores[best]})

    best = met.groupBy("cid").applyInPandas(merge, "cid long, near long, score double")
    members = classes.select(F.col("cid").alias("near"), "ids")
    best = best.join(members, "near").select("cid", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    lists = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    lists = lists.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")).select(dealt_anew("cid").alias("cid"), "found")
    out = asked.withColumnRenamed("vec_id", "query_id").join(lists, "cid")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _products(q: np.ndarray, c: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The product of each row of ``q`` with its rows ``best`` of ``c``.

    One pair has one value: a product of matrices may differ in the last bit with their shapes.
    """
    out = np.empty(best.shape)
    step = max(1, (1 << 21) // max(1, best.shape[1] * q.shape[1]))
    for i in range(0, len(q), step):
        out[i : i + step] = np.einsum("ij,ikj->ik", q[i : i + step], c[best[i : i + step]])
    return out


def _top(s: np.ndarray, m: int) -> np.ndarray:
    """Columns of the ``m`` largest of each row; at the least kept score the first columns stay."""
    if s.shape[1] <= m:
        return np.argsort(-s, axis=1, kind="stable")
    least = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
    above = s > least
    tied = (s == least) & (np.cumsum(s == least, axis=1) <= m - above.sum(axis=1, keepdims=True))
    chosen = np.nonzero(above | tied)[1].reshape(len(s), m)
    order = np.argsort(-np.take_along_axis(s, chosen, 1), axis=1, kind="stable")
    return np.take_along_axis(chosen, order, 1)
