"""Change detection, idempotent upserts and what goes stale with a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def change_set(before: DataFrame, after: DataFrame, key: str = "path", facts: tuple[str, ...] = ("size", "mtime")) -> DataFrame:
    """``key, change`` (added, changed, removed) between two listings; unchanged ones are left out."""
    old = before.select(F.col(key), F.struct(*facts).alias("old"))
    new = after.select(F.col(key), F.struct(*facts).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return old.join(new, key, "full_outer").withColumn("change", change).where("change is not null").select(key, "change")


def content_key(text: str | Column, features: str = "") -> Column:
    """SHA-256 of a text and what was asked to be done with it."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit("\n" + features)), 256)


def to_index(docs: DataFrame, indexed: DataFrame, features: str = "") -> DataFrame:
    """``docs(name, text)`` whose name is new or whose content differs from ``indexed(name, content_hash)``."""
    return docs.withColumn("content_hash", content_key("text", features)).join(indexed.select("name", "content_hash"), ["name", "content_hash"], "left_anti")


def upserted(current: DataFrame, fresh: DataFrame, key: str = "name") -> DataFrame:
    """``current`` with the rows of ``fresh`` in place of those of the same key."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def ancestors(path: str | Column) -> Column:
    """All directories above a path, the root as ''."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def stale_directories(changes: DataFrame) -> DataFrame:
    """``dir``: every directory above a changed path."""
    return changes.select(F.explode(ancestors("path")).alias("dir")).distinct()


def merged_manifests(manifests: DataFrame) -> DataFrame:
    """Files of several corpora as one listing: ``manifests(corpus, path, ...)`` keyed ``corpus/path``."""
    return manifests.withColumn("path", F.concat_ws("/", "corpus", "path"))


def file_key(path: str | Column) -> Column:
    """The name of a file's stored tree: 16 hex digits of its path's SHA-1."""
    return F.substring(F.sha1(F.col(path) if isinstance(path, str) else path), 1, 16)
