"""Citations in answers: read, resolved to documents, replaced by numbered links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.arrays import let
from foliant.functions.text import col
from foliant.operators.joins import small

#: The two forms of a citation.
SEMICOLON_TAG = r"<doc=([^;<>]+);page=(\d+)(?:;block(?:_id)?=([^;<>]+))?>"
CITE_TAG = r"<cite\s([^<>]*)>(?:([^<>]*)</cite>)?"
FOUND = "array<struct<document:string,page:int,block_id:string>>"


def _entry(document: Column, page: Column, block: Column) -> Column:
    block = F.trim(block)
    return F.struct(F.trim(document).alias("document"), F.regexp_extract(page, r"^\s*([0-9]+)\s*(?:-|$)", 1).try_cast("int").alias("page"), F.when(block != "", block).alias("block_id"))


def _attribute(attributes: Column, name: str) -> Column:
    return F.regexp_extract(attributes, rf"(?s)\b{name}=([\"'])(.*?)\1", 2)


def _of_semicolons(tag: Column) -> Column:
    return _entry(*(F.regexp_extract(tag, SEMICOLON_TAG, g) for g in (1, 2, 3)))


def _of_attributes(tag: Column) -> Column:
    own = F.regexp_extract(tag, CITE_TAG, 1)
    return _entry(_attribute(own, "doc"), _attribute(own, "page"), _attribute(own, "block"))


def cited(text: str | Column) -> Column:
    """Array of ``document, page, block_id``: each citation once, those with semicolons first, in order.

    The page is the first of a range; a tag without a document or a page from 1 on is none. Null: none.
    """
    tags = lambda p: F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(p), F.lit(0))
    both = F.concat(F.transform(tags(SEMICOLON_TAG), _of_semicolons), F.transform(tags(CITE_TAG), _of_attributes))
    return F.array_distinct(F.filter(both, lambda c: (c["document"] != "") & (c["page"] > 0))).cast(FOUND)


def linked(text: str | Column, prefix: str = "citation") -> Column:
    """The text with each tag as a link to its number: ``[[1]](#citation-01)``; what a tag encloses stays after it."""
    raw = col(text)

    def replaced(entries: Column) -> Column:
        def link(entry: Column) -> Column:
            number = F.array_position(entries, entry).cast("string")
            return F.concat(F.lit("[["), number, F.lit(f"]](#{prefix}-"), F.lpad(number, 2, "0"), F.lit(")"))

        def step(done: Column, tag: Column) -> Column:
            entry = F.when(tag.startswith("<doc="), _of_semicolons(tag)).otherwise(_of_attributes(tag))
            good = F.array_position(entries, entry) > 0
            return F.when(good, F.replace(done, tag, F.concat(link(entry), F.regexp_extract(tag, CITE_TAG, 2)))).otherwise(done)

        tags = F.array_distinct(F.regexp_extract_all(raw, F.lit(f"{SEMICOLON_TAG}|{CITE_TAG}"), F.lit(0)))
        return F.aggregate(tags, raw, step)

    return F.when(raw.isNotNull(), let(cited(raw), replaced))


def resolved(answers: DataFrame, docs: DataFrame, prefix: str = "citation") -> DataFrame:
    """``answer_id, index, anchor, document, page, block_id, doc_id, candidates`` of ``answers(answer_id, text)``.

    ``docs(doc_id, name)``: a name of one document gives its id; an unknown one none; of a name that
    several have ``candidates`` are the ids, and ``doc_id`` is null: the caller must choose.
    """
    each = answers.select("answer_id", F.posexplode(cited("text")).alias("n", "c"))
    each = each.select("answer_id", (F.col("n") + 1).alias("index"), F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("n") + 1).cast("string"), 2, "0")).alias("anchor"), "c.*")
    asked = each.select(F.col("document").alias("name")).distinct()
    named = docs.join(small(asked), "name", "left_semi").groupBy(F.col("name").alias("document")).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    one = F.size("ids") == 1
    return each.join(named, "document", "left").select("answer_id", "index", "anchor", "document", "page", "block_id", F.when(one, F.col("ids")[0]).alias("doc_id"), F.when(F.size("ids") > 1, F.col("ids")).alias("candidates"))
