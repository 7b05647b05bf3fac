"""Sources: Markdown folders, listings, question sets, nested records, logs, PDF hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foliant.operators.joins import spread

QUESTION = "id string, question string, expected string, doc array<string>, extra map<string,string>"


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, text`` of a folder's Markdown files, however deep: UTF-8, wrong bytes replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").load(folder)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "^﻿", "")
    return raw.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), text.alias("text")).orderBy("path")


def listing(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None, most: int | None = None) -> DataFrame:
    """``path, name, parent, ext, size, mtime`` of files by suffix, without those that have an excluded path part."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    root = folder.rstrip("/").split("://")[-1]
    path = F.regexp_replace("path", rf"^[a-z]+:/*{root.lstrip('/').replace('.', '[.]')}/", "")
    out = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    parts = F.split("path", "/")
    out = out.withColumns({"name": F.element_at(parts, -1), "parent": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), "ext": F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))})
    if include:
        out = out.where(F.col("ext").isin([x.lower() for x in include]))
    if exclude:
        out = out.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in exclude])))
    out = out.orderBy("path")
    return out.limit(most) if most else out


def carried_listing(spark: SparkSession, folder: str, before: DataFrame | None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``listing`` with ``content_hash`` of each file, and ``carried``: whether that comes from ``before``, an earlier result of this.

    A file of the same path, size and time as before is not opened; its entry is carried over. Files that are gone
    have no row. Keep the result (``store.written``, a table) as ``before`` of the next scan.
    """
    from foliant.operators.changes import content_key

    now = listing(spark, folder, include, exclude)
    known = spark.createDataFrame([], "path string, size long, mtime timestamp, content_hash string") if before is None else before.select("path", "size", "mtime", "content_hash")
    met = now.join(known, ["path", "size", "mtime"], "left").withColumn("carried", F.col("content_hash").isNotNull())
    fresh = _texts(spark, folder, met.where("not carried").select("path")).select("path", content_key("text").alias("_hash"))
    return met.join(fresh, "path", "left").withColumn("content_hash", F.coalesce("content_hash", "_hash")).drop("_hash")


def changed_files(spark: SparkSession, folder: str, before: DataFrame | None, include: list[str] | None = None) -> DataFrame:
    """``path, name, text`` of the files that are new or have another size or time than in ``before(path, size, mtime)``; others are not opened."""
    now = listing(spark, folder, include)
    changed = now if before is None else now.join(before.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    return _texts(spark, folder, changed.select("path"))


def _texts(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """``path, name, text`` of files by path: tasks open the files of their own rows."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(folder)).toString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        local = base.startswith("file:")  # names may hold signs that a URI must not
        files, root = (fs.LocalFileSystem(), "/" + base.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(base)
        for frame in frames:
            for path in frame["path"]:
                with files.open_input_stream(f"{root}/{path}") as stream:
                    text = stream.read().decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n").removeprefix("\ufeff")
                yield pd.DataFrame({"path": [path], "name": [path.rpartition("/")[2]], "text": [text]})

    return spread(paths).mapInPandas(read, "path string, name string, text string")


def _questions(rows: DataFrame) -> DataFrame:
    """Blank questions go, missing ids are ``Q001`` on, repeated ids are an error."""
    have = rows.columns
    get = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    doc = F.lit(None).cast("array<string>")
    if "doc" in have:
        doc = F.col("doc").cast("array<string>") if isinstance(rows.schema["doc"].dataType, T.ArrayType) else F.when(F.col("doc").isNotNull(), F.array(F.col("doc").cast("string")))
    extra = [c for c in have if c not in ("id", "question", "expected", "doc", "_n")]
    more = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]) if extra else F.create_map().cast("map<string,string>")
    out = rows.where(F.trim("question") != "").select(F.coalesce(get("id", "string"), F.format_string("Q%03d", F.col("_n"))).alias("id"), F.trim("question").alias("question"), get("expected", "string").alias("expected"), F.coalesce(doc, F.array().cast("array<string>")).alias("doc"), F.map_filter(more, lambda _, v: v.isNotNull()).alias("extra"))
    twice = out.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated question ids: {', '.join(r['id'] for r in twice)}")
    return out


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``id, question, expected, doc, extra`` of a ``.json``, ``.jsonl``, ``.csv`` or text file; text lines after ``#`` are comments."""
    from pyspark.sql import Window

    if path.endswith(".json"):
        rows = spark.read.json(path, multiLine=True)
        rows = rows.select(F.explode("questions").alias("q")).select("q.*") if "questions" in rows.columns else rows
    elif path.endswith(".jsonl"):
        rows = spark.read.json(path)
    elif path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        rows = spark.read.text(path).select(F.trim("value").alias("question")).where(~F.startswith("question", F.lit("#")) & (F.col("question") != ""))
    if "question" not in rows.columns:
        raise ValueError("a question set needs a column 'question'")
    order = Window.orderBy(F.monotonically_increasing_id())  # a question set is small
    return _questions(rows.withColumn("_n", F.row_number().over(order)))


def field(record: str | Column, path: str) -> Column:
    """Strings at a dotted path of a JSON text; ``[]`` after a name spreads its list: ``data.items[].id``."""
    record = F.col(record) if isinstance(record, str) else record
    now = F.array(record)
    for part in path.split("."):
        name, spread = part.removesuffix("[]"), part.endswith("[]")
        now = F.filter(F.transform(now, lambda x: F.get_json_object(x, f"$.{name}")), lambda x: x.isNotNull())
        if spread:
            now = F.flatten(F.transform(now, lambda x: F.transform(F.from_json(x, "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), v.cast("string")))))
    return now


def first_field(record: str | Column, paths: list[str]) -> Column:
    """The first value that any of the alternative paths gives."""
    return F.coalesce(*[F.try_element_at(field(record, p), F.lit(1)) for p in paths])


def log(spark: SparkSession, path: str, schema: str, failed: bool | None = None, record_id: str | None = None) -> DataFrame:
    """A JSON-lines log, newest first; lines that are no records are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if failed is not None:
        rows = rows.where(F.col("ok") != failed)
    if record_id is not None:
        rows = rows.where(F.col("id") == record_id)
    return rows.orderBy(F.desc("ts"))


def extracted(spark: SparkSession, folder: str, page_texts: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """``path, page, markdown`` by a function from a file's bytes to its pages' texts; a task for each file.

    A file that the function fails on gives one row with ``error``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [(path, n, text, None) for n, text in enumerate(page_texts(bytes(content)), 1)]
                except Exception as e:  # a file's fault is data here
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "page", "markdown", "error"]).astype({"page": "Int32"})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return raw.select("path", "content").mapInPandas(run, "path string, page int, markdown string, error string")


def with_page_marks(content: str, spans: list[tuple[int, int]]) -> str:
    """A document's text with a page mark at the offset of each page ``(number, offset)``, put in from the end."""
    for number, offset in sorted(spans, key=lambda s: -s[1]):
        content = f"{content[:offset]}<!-- page: {number} -->\n{content[offset:]}"
    return content
