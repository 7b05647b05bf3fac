"""The scope of a question from what is known of documents: period, report type of the policy, company and region.

Questions are a stated set; they meet the distinct facts of documents, not the documents, and
documents are joined with the facts that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from foliant.functions.periods import REPORT_TYPES, period_year, question_periods
from foliant.functions.text import contains_term, squeezed, word_form
from foliant.operators.joins import small

#: Words of a question on a first half and on a whole year, what a company's name may lack, regions that mean all.
FIRST_HALF = r"(?i)上半年|半年|中报|中期报告|中期业绩|中期(?!股息|派息)|(?<![a-z])(?:H1|1H)(?![a-z])|interim(?!\s+dividend)|first half|half[- ]year|six months|6 months"
WHOLE_YEAR = r"(?i)全年|年度报告|(?<!半)年报|full[- ]year|annual"
FORMS = r"(?i)\b(?:group|holdings?|limited|ltd|co|inc|corp(?:oration)?|plc|company)\b\.?|股份有限公司|有限公司|集团|控股|公司|[()（）,，.、]"
EVERYWHERE = r"(?i)集团|group|global|全球|consolidated|合并|全公司"
FACTS = ["year", "report_type", "company", "region"]


def _named(texts: DataFrame, key: str, text: Column, types: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``key, type, ord``: the types of ``types(ord, key, kind, term)`` that each text names by a term of these kinds."""
    rules = small(types.where(F.col("kind").isin(*kinds)).select("ord", F.col("key").alias("type"), word_form("term").alias("term")))
    return texts.select(key, text.alias("_text")).join(rules, contains_term("term", "_text", whole=True) & (F.col("term") != "")).select(key, "type", "ord").distinct()


def document_types(files: DataFrame, types: DataFrame, splits: DataFrame) -> DataFrame:
    """``files(path, name, ...)`` with ``report_type`` and ``report_type_source`` (``folder``, ``filename`` or null).

    The first folder of the path that holds a type's folder keyword decides, the first such type of the policy; a type that
    ``splits(key, sub)`` gives way to the one sub-type that the file's name names. Else the first type whose alias or
    file keyword the name holds, or whose key it is.
    """
    stem = word_form(F.regexp_replace("name", r"(?i)\.(?:pdf|md|markdown)$", ""))
    parts = F.split(F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/")), "/")
    folders = files.select("path", F.posexplode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("at", "folder")).withColumn("folder", word_form("folder"))
    rules = small(types.where("kind = 'folder'").select("ord", F.col("key").alias("type"), word_form("term").alias("term")).where("term != ''"))
    held = folders.join(rules, contains_term("term", "folder")).groupBy("path").agg(F.min_by("type", F.struct("at", "ord")).alias("_folder"))
    keys = types.select("ord", F.col("key").alias("type")).distinct()
    by_name = _named(files, "path", stem, types, ("alias", "filename")).unionByName(files.select("path", stem.alias("_text")).join(small(keys), F.col("_text") == word_form("type")).select("path", "type", "ord")).distinct()
    named = by_name.groupBy("path").agg(F.min_by("type", "ord").alias("_name"), F.collect_set("type").alias("_all"))
    subs = splits.groupBy(F.col("key").alias("_folder")).agg(F.collect_set("sub").alias("_subs"))
    met = files.join(held, "path", "left").join(named, "path", "left").join(small(subs), "_folder", "left")
    finer = F.array_intersect(F.coalesce("_subs", F.array().cast("array<string>")), F.coalesce("_all", F.array().cast("array<string>")))
    kind = F.when(F.col("_folder").isNotNull(), F.when(F.size(finer) == 1, finer[0]).otherwise(F.col("_folder"))).otherwise(F.col("_name"))
    source = F.when(F.col("_folder").isNotNull(), "folder").when(F.col("_name").isNotNull(), "filename")
    return met.withColumns({"report_type": kind, "report_type_source": source}).select(*[c for c in files.columns if c not in ("report_type", "report_type_source")], "report_type", "report_type_source")


def question_facts(questions: DataFrame, types: DataFrame | None = None, splits: DataFrame | None = None, adjacent: bool = True) -> DataFrame:
    """``query_id, query, years, allowed, first_half, named, covering`` of ``questions(query_id, query)``.

    Allowed: the years and, with ``adjacent``, those after them, whose reports hold comparisons. Named: types of the policy by an
    alias; covering: these and the types that split into one of them.
    """
    years = F.transform(question_periods("query"), lambda y: y.cast("int"))
    rows = questions.select("query_id", "query", F.array_sort(F.array_distinct(years)).alias("years"))
    allowed = F.array_distinct(F.concat("years", F.transform("years", lambda y: y + 1))) if adjacent else F.col("years")
    rows = rows.withColumns({"allowed": F.array_sort(allowed), "first_half": F.col("query").rlike(FIRST_HALF) & ~F.col("query").rlike(WHOLE_YEAR)})
    none = F.array().cast("array<string>")
    if types is None:
        return rows.withColumns({"named": none, "covering": none})
    named = _named(questions, "query_id", word_form("query"), types, ("alias",)).withColumnRenamed("type", "key").drop("ord")
    wider = named if splits is None else named.unionByName(named.withColumnRenamed("key", "sub").join(small(splits.select("key", "sub")), "sub").select("query_id", "key"))
    sets = named.groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("named")).join(wider.groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("covering")), "query_id")
    return rows.join(sets, "query_id", "left").withColumns({"named": F.coalesce("named", none), "covering": F.coalesce("covering", none)})


def _spellings(values: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``value, names``: each value in lower case, without the forms of companies, and what a group of aliases has for either."""
    low = F.lower("value")
    rows = values.select("value", F.array_distinct(F.array(low, squeezed(F.lower(F.regexp_replace("value", FORMS, " "))))).alias("names"))
    if aliases is not None:
        groups = aliases.groupBy("group_id").agg(F.collect_set(F.lower("term")).alias("group"))
        met = rows.select("value", "names").join(small(groups), F.arrays_overlap("names", "group"), "left")
        rows = met.groupBy("value").agg(F.array_distinct(F.flatten(F.collect_list(F.concat("names", F.coalesce("group", F.array().cast("array<string>")))))).alias("names"))
    return rows.withColumn("names", F.filter("names", lambda n: F.length(n) >= 2))


def _mentions(questions: DataFrame, values: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``query_id, value``: the values that a question names, ASCII ones as words."""
    quoted = lambda n: F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(n, r"([^a-z0-9\s])", r"\\$1"), F.lit("(?![a-z0-9])"))
    low = F.lower("query")
    hit = F.exists("names", lambda n: F.when(n.rlike(r"^[\x00-\x7f]+$"), F.regexp_like(low, quoted(n))).otherwise(F.contains(low, n)))
    return _spellings(values, aliases).join(small(questions.select("query_id", "query")), hit).select("query_id", "value")


def routed(questions: DataFrame, docs: DataFrame, types: DataFrame | None = None, splits: DataFrame | None = None, aliases: DataFrame | None = None, adjacent: bool = True) -> tuple[DataFrame, DataFrame]:
    """``routes(query_id, reason, years, first_half, named)`` of every question, and ``scopes(query_id, doc_id)`` of those that are ``routed``.

    ``docs(doc_id, period, report_type, company, region)``; the last two may be missing. A question without a year
    (``no_period``), documents without any period (``no_meta``) and years that none has (``no_match``) are no scope: all is
    searched. Else documents of the allowed years stay, and those of unknown ones. A first-half question keeps of the
    built-in report types the interim ones, if there are any. Then the type, the company and the region narrow, each only if the question
    names one that is left; documents without the fact stay, as do group-level regions.
    """
    for c in ("company", "region"):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("string"))
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    rows = docs.select("doc_id", period_year("period").alias("year"), *[blank(c).alias(c) for c in FACTS[1:]])
    facts = rows.select(*FACTS).distinct()
    asked = question_facts(questions, types, splits, adjacent)
    of_query = Window.partitionBy("query_id")
    some = lambda c: F.max(F.coalesce(c, F.lit(False))).over(of_query)
    pairs = facts.crossJoin(small(asked))  # a stated question set against distinct facts
    in_years = F.col("year").isNull() | F.array_contains("allowed", F.col("year"))
    interim = F.col("year").isNull() | (F.array_contains("allowed", F.col("year")) & ((F.col("report_type") == "interim") | F.col("report_type").isNull() | ~F.col("report_type").isin(*REPORT_TYPES)))
    pairs = pairs.withColumns({"a": in_years, "b": interim, "dated": some(F.col("year").isNotNull())})
    only = F.col("first_half") & some(F.col("b") & (F.col("report_type") == "interim"))
    pairs = pairs.withColumn("in", F.when(only, F.col("b")).otherwise(F.col("a")))
    pairs = pairs.withColumn("known", some(F.col("in") & F.col("year").isNotNull()))
    typed = F.coalesce(F.array_contains("covering", F.col("report_type")), F.lit(False))
    pairs = pairs.withColumn("in", F.col("in") & (~some(F.col("in") & typed) | typed | F.col("report_type").isNull()))
    for c in ("company", "region"):
        said = _mentions(asked, facts.select(F.col(c).alias("value")).where("value is not null").distinct(), aliases).withColumnsRenamed({"value": c}).withColumn("said", F.lit(True))
        pairs = pairs.join(said, ["query_id", c], "left").withColumn("said", F.coalesce("said", F.lit(False)))
        stays = F.col("said") | F.col(c).isNull() | (F.col("region").rlike(EVERYWHERE) if c == "region" else F.lit(False))
        pairs = pairs.withColumn("in", F.col("in") & (~some(F.col("in") & F.col("said")) | stays)).drop("said")
    reason = F.when(F.size("years") == 0, "no_period").when(~F.col("dated"), "no_meta").when(~F.col("known"), "no_match").otherwise("routed")
    pairs = pairs.withColumn("reason", reason)
    found = asked.join(pairs.select("query_id", "reason").distinct(), "query_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.size("years") == 0, "no_period").otherwise("no_meta")))
    kept = pairs.where(F.col("in") & (F.col("reason") == "routed")).select("query_id", *[F.col(c).alias(f"_{c}") for c in FACTS])
    same = F.lit(True)
    for c in FACTS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return found.select("query_id", "reason", "years", "first_half", "named"), rows.join(kept, same).select("query_id", "doc_id")
