"""Evaluation of retrieval: judging hits, ranks, recall and MRR, resumed batches, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from foliant.functions.arrays import scan
from foliant.functions.text import col


def numbers_of(text: str | Column) -> Column:
    """Distinct numbers of a text as decimals: separators of thousands go, 38.00 is 38."""
    found = F.regexp_extract_all(F.regexp_replace(col(text), "(?<=[0-9]),(?=[0-9]{3})", ""), F.lit(r"[0-9]{1,18}(?:\.[0-9]{1,8})?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: n.cast("decimal(28,8)")))


def mentions(expected: str | Column, text: str | Column) -> Column:
    """Whether all numbers of ``expected`` are in ``text``; if it has none, whether its words are."""
    expected, text = col(expected), col(text)
    wanted = numbers_of(expected)
    squeeze = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    return F.when(F.size(wanted) > 0, F.size(F.array_except(wanted, numbers_of(text))) == 0).otherwise(F.contains(squeeze(text), squeeze(expected)))


def judged(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``hits(query_id, rank, page, text)`` with ``relevant``: a gold page, or else the expected answer's mention.

    ``questions(query_id, expected, pages)``; null where neither is known.
    """
    gold = F.size(F.coalesce("pages", F.array().cast("array<int>"))) > 0
    relevant = F.when(gold, F.array_contains("pages", F.col("page"))).when(F.trim("expected") != "", mentions("expected", "text"))
    return hits.join(questions.select("query_id", "expected", "pages"), "query_id").withColumn("relevant", relevant).drop("expected", "pages")


def first_ranks(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``query_id, first_rank`` of judged questions; null where no hit is relevant (or the search failed)."""
    ranks = hits.where("relevant").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return questions.select("query_id").join(ranks, "query_id", "left")


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: ``judged, recall_<k>, mrr`` over ``ranks(query_id, first_rank)``; no rank counts as a miss."""
    recalls = [F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("judged"), *recalls, F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def last_records(records: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last record of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return records.withColumn("_r", rank).where("_r = 1").drop("_r")


def to_resume(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Questions whose last record is missing or has an error."""
    done = last_records(records).where("error is null")
    return questions.join(done.select(F.col("id").alias("query_id")), "query_id", "left_anti")


def failed_queries(log: DataFrame, limit: int) -> DataFrame:
    """The newest failed records of ``log(ts, id, ok, error)``."""
    return log.where(~F.col("ok")).orderBy(F.desc("ts"), "id").limit(limit)


def call_stats(calls: DataFrame) -> DataFrame:
    """Calls, retried calls and total milliseconds by kind of ``calls(kind, attempts, ms)``."""
    return calls.groupBy("kind").agg(F.count("*").alias("calls"), F.sum((F.col("attempts") > 1).cast("long")).alias("retried"), F.sum("ms").alias("total_ms"))


def calc_suspects(answers: DataFrame) -> DataFrame:
    """``answers(query_id, answer, tools)`` that speak of growth or shares without having calculated."""
    words = r"(?i)%|percent|growth|increase[ds]?|decrease[ds]?|ratio|同比|增长|下降|占比"
    return answers.where(~F.array_contains("tools", "calculate") & F.col("answer").rlike(words))


def prefetch(ranked: DataFrame, budget: int = 60_000) -> DataFrame:
    """Ranked pages with ``kept``: characters that fit a budget by rank; one page is cut, later ones have none.

    ``ranked(query_id, rank, text)``.
    """
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(budget) - before, F.lit(0))
    return ranked.withColumn("kept", F.least(F.length("text"), room).cast("long")).withColumn("text", F.substr("text", F.lit(1), F.col("kept").cast("int")))


def within_budget(ranked: DataFrame, budget: int = 20_000, each: int = 2_600) -> DataFrame:
    """Sections by rank until the total passes the budget: from the first that does not fit, none."""
    size = F.least(F.length("text"), F.lit(each))
    total = F.sum(size).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("size", size.cast("long")).withColumn("total", total.cast("long")).where(F.col("total") <= budget)


def skip_to_fit(pages: DataFrame, budget: int = 95_000) -> DataFrame:
    """``pages(query_id, ord, size)`` with ``taken``: the first always, then each that still fits.

    A page that does not fit is skipped and smaller ones after it may be taken: a fold over a
    request's pages, of which there are at most thousands.
    """

    def step(done: Column, x: Column) -> tuple[Column, Column]:
        takes = done["none"] | (done["used"] + x["size"] <= budget)
        return F.struct((done["used"] + F.when(takes, x["size"]).otherwise(0)).alias("used"), F.lit(False).alias("none")), F.struct(x["ord"].alias("ord"), x["size"].alias("size"), takes.alias("taken"))

    one = pages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), F.col("size").cast("long").alias("size")))).alias("x"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("none"))
    return one.select("query_id", F.explode(scan(F.col("x"), zero, step, "struct<ord:int,size:bigint,taken:boolean>")).alias("x")).select("query_id", "x.*")


def image_pages(wanted: DataFrame, docs: DataFrame, limit: int = 3) -> DataFrame:
    """``wanted(query_id, ord, doc_id, page)`` once each, of linked documents, within their pages, at most ``limit``."""
    first = wanted.groupBy("query_id", "doc_id", "page").agg(F.min("ord").alias("ord"))
    known = first.join(docs.where("linked").select("doc_id", "pages"), "doc_id").where(F.col("page").between(1, F.col("pages")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))
    return known.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "page")


def context_blocks(ranked: DataFrame) -> DataFrame:
    """``query_id, context``: kept pages in rank order, each under its name and page."""
    head = F.concat(F.lit("[["), F.col("name"), F.lit(" p."), F.col("page").cast("string"), F.lit("]]\n"), F.col("text"))
    one = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("block")))).alias("x"))
    return one.select("query_id", F.array_join(F.transform("x", lambda b: b["block"]), "\n\n").alias("context"))
