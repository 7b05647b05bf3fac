"""Intermediate tables in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``. Only where a session of one machine
names none (tests, a laptop) a folder is made and set; on a cluster that is an error. Tables
written here survive a lost executor, unlike cached or locally checkpointed data.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, also set as the session's checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="foliant-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (in any case), like ``name``."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of this module before the driver ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def drop_others(spark: SparkSession, folder: str, ending: str) -> None:
    """Delete the files of ``folder``, if there is one, whose names do not end so."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(jvm_path) if system.exists(jvm_path) else ():
        if not status.getPath().getName().endswith(ending):
            system.delete(status.getPath(), False)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: the lineage ends here.

    ``df`` without rows or with any nullability comes back with the same columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(*tables: DataFrame) -> None:
    """Delete written tables that are not read again."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            drop_path(table.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` through a reliable checkpoint, whose files Spark's cleaner can remove."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
