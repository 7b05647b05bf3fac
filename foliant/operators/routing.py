"""Routing: path rules, aliases, report types, candidates, and the scope of a question.

Rules are small tables (a row for each pattern) and are joined by their size: a policy is
written by hand. Documents and paths may be many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window

from foliant.functions.text import col, question_terms, word_form
from foliant.operators.joins import small
from foliant.sources.staging import written


def glob_regex(pattern: str | Column) -> Column:
    """A shell pattern as a whole-text regular expression: ``*``, ``?``, ``[...]``."""
    quoted = F.regexp_replace(F.lower(col(pattern)), r"([.^$+(){}|\\])", r"\\$1")
    out = F.regexp_replace(F.replace(F.replace(quoted, F.lit("*"), F.lit("\u0001")), F.lit("?"), F.lit(".")), r"\[!", "[^")
    return F.concat(F.lit("(?s)^"), F.replace(out, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def path_matches(pattern: str | Column, path: str | Column) -> Column:
    """Lenient: a part of the path, or a shell pattern of the whole path or of a segment."""
    pattern, path = F.lower(F.trim(col(pattern))), F.lower(F.trim(col(path)))
    wild = pattern.rlike(r"[*?\[]")
    hit = F.regexp_like(path, glob_regex(pattern)) | F.exists(F.split(path, "/"), lambda s: F.regexp_like(s, glob_regex(pattern)))
    return (pattern != "") & (path != "") & F.when(wild, hit).otherwise(F.contains(path, pattern))


def segment_matches(pattern: str | Column, path: str | Column) -> Column:
    """Strict: a shell pattern of a whole segment; with a slash, of the whole path or its beginning."""
    pattern, path = F.lower(F.trim(col(pattern))), F.lower(F.trim(col(path)))
    deep = F.regexp_like(path, glob_regex(pattern)) | F.startswith(path, F.concat(F.regexp_replace(pattern, "/+$", ""), F.lit("/")))
    return (pattern != "") & (path != "") & F.when(F.contains(pattern, F.lit("/")), deep).otherwise(F.exists(F.split(path, "/"), lambda s: F.regexp_like(s, glob_regex(pattern))))


def weighted_paths(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """``paths(path, ...)`` with the sum of matching weights and the label of the strongest (the first of equals).

    ``weights(ord, pattern, weight, label)``.
    """
    w = weights.select("ord", "pattern", "weight", F.coalesce("label", "pattern").alias("label"))
    hits = paths.select("path").distinct().join(small(w), path_matches("pattern", "path"))
    best = hits.groupBy("path").agg(F.sum("weight").alias("weight"), F.max_by("label", F.struct("weight", -F.col("ord"))).alias("label"))
    return paths.join(best, "path", "left").withColumns({"weight": F.coalesce("weight", F.lit(0)), "label": F.coalesce("label", F.lit(""))})


def without_excluded(paths: DataFrame, excludes: DataFrame) -> DataFrame:
    """``paths`` that no pattern of ``excludes(pattern)`` takes out."""
    hit = paths.select("path").distinct().join(small(excludes.select("pattern")), segment_matches("pattern", "path")).select("path").distinct()
    return paths.join(hit, "path", "left_anti")


def alias_terms(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id, term, weight``: members of touched groups that the question does not name.

    ``aliases(group_id, term)``: a group is touched if the question holds any of its terms.
    """
    groups = aliases.groupBy("group_id").agg(F.collect_set(F.lower("term")).alias("terms"))
    touched = questions.join(small(groups), F.exists("terms", lambda t: F.contains(F.lower("query"), t)))
    missing = touched.select("query_id", "query", F.explode("terms").alias("term")).where(~F.contains(F.lower("query"), F.col("term")))
    return missing.select("query_id", "term", F.lit(2).alias("weight")).distinct()


def report_type_of(files: DataFrame, types: DataFrame) -> DataFrame:
    """``report_type`` of ``files(path, folder, name)``: the first type whose folder, then alias, matches.

    ``types(ord, key, kind, term)``: kind is ``folder`` (equal, any case) or ``alias`` (a word of the name).
    """
    folder = (F.col("kind") == "folder") & (F.lower("folder") == F.lower("term"))
    named = F.concat(F.lit(" "), F.regexp_replace(word_form("name"), "[^a-z0-9]+", " "), F.lit(" "))
    alias = (F.col("kind") == "alias") & F.contains(named, F.concat(F.lit(" "), word_form("term"), F.lit(" ")))
    hits = files.join(small(types), folder | alias)
    best = hits.groupBy("path").agg(F.min_by("key", F.struct((F.col("kind") != "folder").cast("int").alias("a"), "ord")).alias("report_type"))
    return files.join(best, "path", "left")


def candidate_scores(questions: DataFrame, candidates: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``query_id, path, score`` of every candidate ``(path, text, weight)`` for every question ``(query_id, query)``.

    The weight, 3 for each year of the question in path or text, 1 for each term in the path
    and the term's weight in the text. ``extra(query_id, term, weight)`` adds terms.
    """
    years = F.array_distinct(F.regexp_extract_all("query", F.lit("(?:19|20)[0-9]{2}"), F.lit(0)))
    terms = questions.select("query_id", F.explode(question_terms("query")).alias("t")).select("query_id", F.lower("t.term").alias("term"), F.col("t.weight").alias("points"))
    if extra is not None:
        terms = terms.unionByName(extra.select("query_id", F.lower("term").alias("term"), F.col("weight").alias("points")))
    asked = questions.withColumn("years", years).join(terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "points")).alias("terms")), "query_id", "left")
    pairs = candidates.crossJoin(small(asked))  # a stated question set against all candidates
    path, text = F.lower("path"), F.lower(F.coalesce("text", F.lit("")))
    of_years = F.aggregate("years", F.lit(0), lambda a, y: a + F.when(F.contains("path", y) | F.contains(text, y), 3).otherwise(0))
    of_terms = F.aggregate(F.coalesce("terms", F.array().cast("array<struct<term:string,points:int>>")), F.lit(0), lambda a, t: a + F.contains(path, t["term"]).cast("int") + F.when(F.contains(text, t["term"]), t["points"]).otherwise(0))
    return pairs.select("query_id", "path", (F.col("weight") + of_years + of_terms).alias("score"))


def best_directories(scored: DataFrame, most: int = 4) -> DataFrame:
    """Candidates with a question's best score if it is not 0, ``most`` of them, the last paths first."""
    found = scored.where("score != 0")
    best = found.groupBy("query_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("path"))
    return found.join(best, ["query_id", "score"]).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most)


def best_files(scored: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` best files of a question, equals by path; only the first if none has points."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= most)  # each partition keeps its best before the exchange
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top.withColumn("best", best).where((F.col("best") > 0) | (F.col("rank") == 1)).drop("best")


def best_sections(questions: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """Sections by 1 for each term in the title and a half for each in the summary."""
    terms = questions.select("query_id", F.transform(question_terms("query"), lambda t: F.lower(t["term"])).alias("terms"))
    pairs = nodes.crossJoin(small(terms))  # a stated question set
    title, summary = F.lower("title"), F.lower(F.coalesce("summary", F.lit("")))
    score = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.contains(title, t).cast("double") + 0.5 * F.contains(summary, t).cast("double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ord"))
    return pairs.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "doc_id", "ord", "title", "score", "rank")


def section_text(sections: DataFrame, lines: DataFrame, most: int = 6000) -> DataFrame:
    """``sections(doc_id, ord, start, end)`` of lines with ``text``: their lines, cut to ``most`` characters."""
    inside = F.col("line_no").between(F.col("start"), F.col("end"))
    each = sections.select("doc_id", "ord", "start", "end").join(lines.select("doc_id", "line_no", F.col("text").alias("line")), "doc_id").where(inside)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return each.groupBy("doc_id", "ord", "start", "end").agg(F.left(text, F.lit(most)).alias("text"))


def numbered_names(files: DataFrame, most: int = 99) -> DataFrame:
    """``path, name, unique_name``: of files of one name the first by path keeps it, the others get ``_1`` to ``_99`` before the ending; null beyond."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1
    stem, ending = F.regexp_extract("name", r"(?s)^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(?s)^(.*?)(\.[^.]*)?$", 2)
    unique = F.when(nth == 0, F.col("name")).when(nth <= most, F.concat(stem, F.lit("_"), nth.cast("string"), ending))
    return files.select("path", "name").withColumn("unique_name", unique)


def files_under(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Files of ``files(path)`` below any of ``dirs(dir)``; the empty directory holds all."""
    inside = (F.col("dir") == "") | (F.col("path") == F.col("dir")) | F.startswith("path", F.concat(F.col("dir"), F.lit("/")))
    return files.join(small(dirs.select("dir")), inside, "left_semi").orderBy("path")


def route_scopes(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, doc_id, reason``: the documents each question may see.

    ``questions(query_id, years, first_half, types)`` and ``docs(doc_id, year, half, report_type)``:
    a year, or report type, that a document has and the question excludes, takes it out;
    unknown ones stay. Years select with the year after them. First-half questions see interim
    documents only if there are any. A question that would see none sees all.
    """
    # a report on a year may be dated the year after
    in_years = F.col("year").isNull() | (F.size("years") == 0) | F.exists("years", lambda y: (F.col("year") == y) | (F.col("year") == y + 1))
    of_type = F.col("report_type").isNull() | (F.size("types") == 0) | F.array_contains("types", F.col("report_type"))
    first = F.coalesce("half", F.lit(0)) == 1
    # what a document may see hangs on three facts of it: questions are met by those, not by documents
    kinds = docs.select("year", "half", "report_type").distinct()
    ok = kinds.crossJoin(small(questions)).withColumn("ok", in_years & of_type).withColumn("interim", F.col("ok") & F.col("first_half") & first)
    facts = ok.groupBy("query_id").agg(F.max("interim").alias("any_interim"), F.max("ok").alias("any_ok"))
    asks = (F.size("years") > 0) | (F.size("types") > 0) | F.col("first_half")
    seen = F.when(F.col("any_interim"), F.col("interim") | (F.col("ok") & F.col("half").isNull())).otherwise(F.col("ok"))
    routed = ok.join(facts, "query_id").withColumn("seen", seen).where(F.col("seen") | ~F.col("any_ok"))
    reason = F.when(~asks, "no filter").when(~F.col("any_ok"), "nothing matched").otherwise("filtered")
    routed = routed.select("query_id", "year", "half", "report_type", reason.alias("reason"))
    d, r = docs.alias("d"), routed.alias("r")
    same = F.col("d.year").eqNullSafe(F.col("r.year")) & F.col("d.half").eqNullSafe(F.col("r.half")) & F.col("d.report_type").eqNullSafe(F.col("r.report_type"))
    return d.join(r, same).select("r.query_id", "d.doc_id", "r.reason")


def route_stats(routes: DataFrame) -> DataFrame:
    """``reason, questions, documents`` over routes."""
    return routes.groupBy("reason").agg(F.count_distinct("query_id").alias("questions"), F.count("*").alias("documents"))


def outside_scope(reads: DataFrame, routes: DataFrame) -> DataFrame:
    """``reads(query_id, doc_id)`` of documents that the route of the question does not hold."""
    return reads.join(routes.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def listing(docs: DataFrame, offset: int = 0, limit: int = 50, name: str | None = None, report_type: str | None = None) -> DataFrame:
    """Documents newest first, then by id, with ``total`` and ``has_more``; at most 50 at a time."""
    if name is not None:
        docs = docs.where(F.col("name") == name)
    if report_type is not None:
        docs = docs.where(F.col("report_type") == report_type)
    total = docs.count()
    limit = min(50, max(1, limit))
    page = docs.orderBy(F.desc("created_at"), "doc_id").offset(max(0, offset)).limit(limit)
    return page.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(offset + limit < total)})


def newest_of_name(docs: DataFrame) -> DataFrame:
    """``name, doc_id``: the newest document of each name, the larger id of equals."""
    return docs.groupBy("name").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"))


def clashing_names(files: DataFrame) -> DataFrame:
    """``path, name, unique_name``: a name that several have gets as few folders before it as tell them apart."""
    parts = F.split("path", "/")
    each = files.select("path", F.reverse(parts).alias("up"), F.size(parts).alias("n"))
    tails = each.select("path", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "up").withColumn("tail", F.array_join(F.reverse(F.slice("up", F.lit(1), F.col("k"))), "_"))
    alone = F.count("*").over(Window.partitionBy("k", "tail")) == 1
    best = tails.withColumn("alone", alone).groupBy("path").agg(F.min_by("tail", F.when(F.col("alone"), F.col("k")).otherwise(F.col("k") + 1000)).alias("unique_name"))
    return best.withColumn("name", F.element_at(F.split("path", "/"), -1)).select("path", "name", "unique_name")


#: Nodes of a level that a question is shown, those that it keeps, and levels it goes down.
SHOWN, BEAM, LEVELS = 90, 4, 8


def descended(questions: DataFrame, nodes: DataFrame, choose: Callable[[DataFrame], DataFrame] | None = None, beam: int = BEAM, shown: int = SHOWN, levels: int = LEVELS) -> DataFrame:
    """``query_id, doc_id, node_id, level, score``: where a descent through section trees, a level at a time, ends for each question.

    ``questions(query_id, query, doc_id)`` name the documents that a question begins in, ``nodes(doc_id, node_id, parent_id,
    ord, title, summary)`` are their trees. Of a level's nodes the ``shown`` best by terms are put before
    ``choose(query_id, query, doc_id, node_id, title, summary, score)``, which returns ``query_id, doc_id, node_id`` of its
    picks; picks that were not shown do not count, and where it picks nothing the best by terms is taken. The ``beam`` best picks go on
    to their children; one without children, or that is on the last level, is an end. Each question that has
    a document with nodes ends in one node at least.
    """
    spark = questions.sparkSession
    terms = questions.select("query_id", "query", "doc_id").distinct().withColumn("terms", F.transform(question_terms("query"), lambda t: F.lower(t["term"])))
    rows = nodes.select("doc_id", "node_id", "parent_id", "ord", "title", F.coalesce("summary", F.lit("")).alias("summary"))
    score = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.contains(F.lower("title"), t).cast("double") + 0.5 * F.contains(F.lower("summary"), t).cast("double"))
    held = rows.select("doc_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct().withColumn("goes_on", F.lit(True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ord", "node_id")
    now = terms.join(rows.where("parent_id is null"), "doc_id")
    out = None
    for level in range(1, levels + 1):
        seen = written(now.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown), "descent")
        if not seen.limit(1).count():
            break
        best = seen.where("rank = 1").select("query_id", "doc_id", "node_id")
        if choose is None:
            top = seen.groupBy("query_id").agg(F.max("score").alias("score"))
            picks = seen.join(top, ["query_id", "score"]).select("query_id", "doc_id", "node_id")
        else:
            asked = choose(seen.select("query_id", "query", "doc_id", "node_id", "title", "summary", "score"))
            picks = written(asked.select("query_id", "doc_id", "node_id").distinct().join(seen.select("query_id", "doc_id", "node_id"), ["query_id", "doc_id", "node_id"], "left_semi"), "picks")
            picks = picks.unionByName(best.join(picks.select("query_id"), "query_id", "left_anti"))
        kept = seen.join(picks, ["query_id", "doc_id", "node_id"], "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= beam)
        kept = written(kept.join(held, ["doc_id", "node_id"], "left").drop("rank", "place"), "descent")
        ends = kept.where(F.lit(level == levels) | F.col("goes_on").isNull()).select("query_id", "doc_id", "node_id", F.lit(level).alias("level"), "score")
        out = ends if out is None else out.unionByName(ends)
        down = kept.where("goes_on").select("query_id", "query", "terms", "doc_id", F.col("node_id").alias("parent_id"))
        now = down.join(rows, ["doc_id", "parent_id"])
    return out if out is not None else spark.createDataFrame([], f"query_id {questions.schema['query_id'].dataType.simpleString()}, doc_id {nodes.schema['doc_id'].dataType.simpleString()}, node_id string, level int, score double")
