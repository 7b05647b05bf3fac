"""Append-only logs of JSON lines, a folder for each, with rotation by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 64 << 20


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    return jvm_path, jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def append(records: DataFrame, path: str, most_bytes: int = MOST_BYTES, kept: int = 1) -> None:
    """Append ``records`` to the log at ``path``; one that has ``most_bytes`` becomes ``path.1`` first.

    ``kept``: how many old logs stay, the newest is ``.1``.
    """
    spark = records.sparkSession
    jvm_path, fs = _file_system(spark, path)
    if fs.exists(jvm_path(path)) and fs.getContentSummary(jvm_path(path)).getLength() >= most_bytes:
        fs.delete(jvm_path(f"{path}.{kept}"), True)
        for n in (n for n in range(kept - 1, 0, -1) if fs.exists(jvm_path(f"{path}.{n}"))):
            fs.rename(jvm_path(f"{path}.{n}"), jvm_path(f"{path}.{n + 1}"))
        if kept:
            fs.rename(jvm_path(path), jvm_path(f"{path}.1"))
        else:
            fs.delete(jvm_path(path), True)
    records.write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str, old: int = 0) -> DataFrame:
    """The records of a log and of up to ``old`` logs before it; lines that are no records are dropped."""
    jvm_path, fs = _file_system(spark, path)
    found = [p for p in (path, *(f"{path}.{n}" for n in range(1, old + 1))) if fs.exists(jvm_path(p))]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found)
