"""A document store of Parquet tables in versions: documents, pages, nodes, passages, postings.

Files lie in ``<root>/<table>/v=<version>/bucket=<bucket>/`` and are never written again; ``bucket`` is a
hash of the document's id. A version is a manifest, ``<root>/_versions/<number>.json``, that names for
each table and bucket the version whose files hold it. An upsert writes the buckets of the documents it
names under a new number and then puts the manifest in place by one rename: until then, and after a
failure at any point, readers see the version before, whole. A reader holds a version by its number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = ["pages", "nodes", "passages", "postings", "lengths", "passage_postings", "passage_lengths", "documents"]
#: Tables whose files are sorted within a bucket, so that a filter skips row groups.
SORTED = {"postings": "term", "passage_postings": "term"}
BUCKETS = 64
Manifest = dict[str, dict[str, int]]


class Folder:
    """Small files and folders of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        """What lies in a folder; nothing where there is none."""
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that is not there yet, all at once."""
        draft, path = self._path(f"{name}.{id(text):x}.draft"), self._path(name)
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(path) or not self.fs.rename(draft, path):
            self.fs.delete(draft, False)
            raise FileExistsError(f"{self.root}/{name}: another writer was first")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Store:
    spark: SparkSession
    root: str
    #: The version that is read; the newest at each read if none is named.
    version: int | None = None

    @property
    def folder(self) -> Folder:
        return Folder(self.spark, self.root)

    def versions(self) -> list[int]:
        """The numbers of the versions that are complete, rising."""
        return [int(n[:-5]) for n in self.folder.names("_versions") if n.endswith(".json")]

    def newest(self) -> int:
        return max(self.versions(), default=0)

    def held(self) -> Store:
        """This store at the version that is the newest now; later writes are not seen."""
        return self if self.version is not None else replace(self, version=self.newest())

    def manifest(self) -> Manifest:
        number = self.newest() if self.version is None else self.version
        return json.loads(self.folder.read(f"_versions/{number:08d}.json")) if number else {}

    def table(self, name: str) -> DataFrame | None:
        """A table of the store with its ``bucket``, or None before anything was written."""
        return self._read(name, self.manifest())

    def _read(self, name: str, manifest: Manifest, buckets: set[int] | None = None) -> DataFrame | None:
        if name not in manifest:
            return None
        base = f"{self.root.rstrip('/')}/{name}"
        reader = self.spark.read.option("basePath", base).option("mergeSchema", "true")
        held = {int(b): v for b, v in manifest[name].items() if buckets is None or int(b) in buckets}
        if not held:  # a table without rows keeps its columns
            version, bucket = next(((v, int(b)) for b, v in manifest[name].items()), (None, None))
            return None if version is None else reader.parquet(f"{base}/v={version}/bucket={bucket}").where("false").drop("v")
        return reader.parquet(*(f"{base}/v={v}/bucket={b}" for b, v in sorted(held.items()))).drop("v")

    def documents(self, status: str = "completed") -> DataFrame | None:
        docs = self.table("documents")
        return None if docs is None else docs.where(F.col("status") == status).drop("bucket")

    def of_document(self, name: str, doc_id: str) -> DataFrame | None:
        """Rows of one document, from its bucket alone."""
        bucket = self.spark.range(1).select(_bucket(F.lit(doc_id))).first()[0]
        rows = self._read(name, self.manifest(), {bucket})
        return None if rows is None else rows.where(F.col("doc_id") == doc_id).drop("bucket")

    def _write(self, name: str, number: int, manifest: Manifest, gone: DataFrame, fresh: DataFrame | None) -> None:
        """Write what becomes of a table's touched buckets under a new version, and name it in ``manifest``."""
        touched = {r["bucket"] for r in gone.select(_bucket(F.col("doc_id")).alias("bucket")).distinct().collect()}  # BUCKETS at most
        old = self._read(name, manifest, touched)
        now = None if old is None else old.join(gone.select("doc_id"), "doc_id", "left_anti")
        if fresh is not None:
            fresh = fresh.withColumn("bucket", _bucket(F.col("doc_id")))
            now = fresh if now is None else now.unionByName(fresh, allowMissingColumns=True)
        if now is None:
            return
        path = f"{name}/v={number}"
        self.folder.delete(path)  # of a writer that failed
        rows = now.repartition("bucket").sortWithinPartitions("bucket", *([SORTED[name]] if name in SORTED else []))
        rows.write.partitionBy("bucket").parquet(f"{self.root.rstrip('/')}/{path}")
        made = {int(n.removeprefix("bucket=")) for n in self.folder.names(path) if n.startswith("bucket=")}
        kept = {b: v for b, v in manifest.get(name, {}).items() if int(b) not in touched}
        manifest[name] = kept | {str(b): number for b in made}

    def _commit(self, changes: Iterator[tuple[str, DataFrame, DataFrame | None]]) -> int:
        """Write changes of tables, ``(name, gone, fresh)``, as one version."""
        number = self.newest() + 1
        manifest = replace(self, version=number - 1).manifest()
        for name, gone, fresh in changes:
            self._write(name, number, manifest, gone, fresh)
        self.folder.put(f"_versions/{number:08d}.json", json.dumps(manifest, sort_keys=True))
        return number

    def upsert(self, tables: dict[str, DataFrame]) -> int:
        """Write documents with their other tables; what was there of the same ids goes. Returns the version."""
        ids = tables["documents"].select("doc_id").distinct()
        return self._commit((name, ids, tables[name]) for name in TABLES if name in tables)

    def delete(self, doc_ids: list[str]) -> dict[str, str]:
        """Remove documents from all tables at once; a status for each id. Nothing goes unless all ids are fit."""
        if not 0 < len(doc_ids) <= 10 or any(not d or "/" in d or ".." in d for d in doc_ids):
            raise ValueError("one to ten plain ids are needed")
        docs = self.documents()
        known = set() if docs is None else {r["doc_id"] for r in docs.where(F.col("doc_id").isin(doc_ids)).select("doc_id").collect()}
        if known:
            gone = self.spark.createDataFrame([(d,) for d in known], "doc_id string")
            self._commit((name, gone, None) for name in TABLES)
        return {d: "deleted" if d in known else "not found" for d in doc_ids}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the files that none of the ``keep`` newest versions names; readers of older ones must have ended."""
        numbers = self.versions()
        kept = numbers[-max(1, keep) :]
        used = {(t, v) for n in kept for t, buckets in replace(self, version=n).manifest().items() for v in buckets.values()}
        folder = self.folder
        gone = [f"{t}/v={v}" for t in TABLES for v in (int(n[2:]) for n in folder.names(t) if n.startswith("v=")) if (t, v) not in used and v <= kept[-1]] if kept else []
        for name in [f"_versions/{n:08d}.json" for n in numbers if n not in kept] + gone:
            folder.delete(name)
        return gone


def _bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(BUCKETS)).cast("int")
