"""A corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and is given what the stage before it wrote. All but
the last return the columns of ``docs``, as they are and whatever others there are. Null and
empty texts are documents without words: the classifier scores them, all of them are one class of
near-duplicates, and what is left of them holds no item and no personal data. Very long texts are
read whole. Repeated rows are near-duplicates of each other. No documents: no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import contamination, pii, quality, wide_simhash
from foliant.llm.packing import pack_best_fit
from foliant.llm.storage import free_name, fresh_path
from foliant.operators.joins import spread


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on the labels of these documents.

    Without labels all stay. A null text is scored as an empty one.
    """
    labels = quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.fit(docs, labels)
    if model.weights is None:
        return docs
    return docs.where(model.column("text") >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, Jaccard similarity 0.8, links chain.

    The one with the smallest ``doc_id`` stays (null last).
    """
    return wide_simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; without items all stay."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars``, if there is one, follows the new text. A null text stays null."""
    given = {c: free_name(docs, f"given_{c}") for c in docs.columns if c.lower() in ("pii_base", "pii_spans")}
    found = pii.redact(pii.with_spans(docs.withColumnsRenamed(given)))
    if "n_chars" in docs.columns:
        length = F.when(F.size("pii_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(given.get(c, c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 ids; an empty or null text is its end id alone."""
    return pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best-fit packing", pack),
]
#: The classifier, the latent space and the tokenizer are beyond SQL; tests hold each stage against its brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
