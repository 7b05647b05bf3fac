"""The facade: index documents, search them, read them, route questions, evaluate.

Every call answers with DataFrames or, for tool use, with a dict that never raises.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliant.functions import calc
from foliant.functions.periods import name_facts
from foliant.functions.policy import Policy
from foliant.functions.python_text import as_column, close_names, heading_before
from foliant.functions.snippets import best_place, snippet
from foliant.functions.text import page_tags, tokens
from foliant.operators import bm25, changes, citations, evaluate, pages, passages, routing, scopes as scopes_, trees
from foliant.sources.staging import delete, written
from foliant.sources.store import Store


@dataclass
class Tool:
    """A function that may be called by name with JSON arguments."""

    name: str
    description: str
    schema: dict
    run: Callable[..., object]
    guidance: str = ""


JSON_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object"}


def schema_of(run: Callable[..., object]) -> dict:
    """The JSON schema of a function's parameters, from its signature."""
    properties, required = {}, []
    for name, p in inspect.signature(run).parameters.items():
        kind = str(p.annotation).split("|")[0].split("[")[0].strip().removeprefix("<class '").removesuffix("'>")
        properties[name] = {"type": JSON_TYPES.get(kind, "string")}
        if p.default is inspect.Parameter.empty:
            required.append(name)
        elif p.default is not None:
            properties[name]["default"] = p.default
    return {"type": "object", "properties": properties, "required": required}


def outline_parts(nodes: list[dict], most: int) -> list[list[dict]]:
    """A forest in parts of about ``most`` characters of JSON: whole nodes side by side, larger ones by their children."""
    parts: list[list[dict]] = [[]]
    room = most
    for node, alone in _pieces(nodes, most):
        size = len(json.dumps(node, ensure_ascii=False))
        if parts[-1] and (alone or size > room):
            parts.append([])
            room = most
        parts[-1].append(node)
        room = 0 if alone else room - size
    return parts


def _pieces(nodes: list[dict], most: int) -> Iterator[tuple[dict, bool]]:
    """Each node; one that is too large as copies of itself with a part of its children, which stand alone."""
    for node in nodes:
        shell = {k: v for k, v in node.items() if k != "nodes"}
        if len(json.dumps(node, ensure_ascii=False)) <= most or "nodes" not in node:
            yield node, False
        else:
            room = max(most - len(json.dumps(shell, ensure_ascii=False)), most // 2)
            yield from (({**shell, "nodes": part}, True) for part in outline_parts(node["nodes"], room))


@dataclass
class Library:
    spark: SparkSession
    root: str
    store: Store = field(init=False)
    tools: dict[str, Tool] = field(default_factory=dict)
    policy: Policy = field(default_factory=Policy)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)
        calls = {
            "search_pages": self.search_pages, "browse_documents": self.browse, "get_document": self.get_document, "get_document_structure": self.structure,
            "get_page_content": self.page_content, "remove_document": self.remove, "calculate": calc.evaluate, "resolve_citations": self.resolve_citations,
        }
        for name, run in calls.items():
            self.tools.setdefault(name, Tool(name, (run.__doc__ or "").split("\n")[0], schema_of(run), run))

    def index(self, files: DataFrame, page_chars: int = pages.PAGE_CHARS) -> int:
        """Index ``files(name, text)``; files whose content is known already are left. Returns how many were not.

        With a column ``path`` files of one name in two folders are two documents. Report types are those of the
        policy by folder and name, then by the name alone; columns ``company``, ``region``, ``period`` and ``report_type`` of
        ``files`` are kept and go before what a name says.
        """
        known = self.store.documents()
        path = F.coalesce("path", "name") if "path" in files.columns else F.col("name")
        given = [c for c in ("company", "region", "period", "report_type") if c in files.columns]
        fresh = files.withColumns({"content_hash": changes.content_key("text"), "doc_id": changes.file_key(path), "path": path})
        if known is not None:
            fresh = fresh.join(known.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
        fresh = fresh.select("doc_id", "name", "path", "text", "content_hash", *given)
        n = fresh.count()
        if n:
            fresh = written(fresh, "library-files")
            paged = written(pages.pages(fresh, page_chars), "library-pages")  # read by five tables
            nodes = trees.page_tree(pages.lines(fresh, page_chars, mask=True), fresh.select("doc_id", F.col("name").alias("title")))
            cut = written(passages.passages(paged), "library-passages")
            counts = paged.groupBy("doc_id").agg(F.max("page").alias("page_num"))
            docs = self._described(fresh.drop("text"), given).join(counts, "doc_id", "left")
            docs = docs.withColumns({"status": F.lit("completed"), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})
            self.store.upsert({"documents": docs.withColumn("index_version", F.lit(bm25.VERSION)), "pages": paged.withColumn("tags", page_tags("markdown")), "nodes": nodes, "passages": cut} | _index_tables(paged, cut))
            delete(fresh, paged, cut)
        return n

    def _described(self, files: DataFrame, given: list[str]) -> DataFrame:
        """``doc_id, name, content_hash, period, report_type, report_type_source, company, region`` of ``files``."""
        rows = files.withColumnsRenamed({c: f"_{c}" for c in given})
        configured: Column | None = None
        half: bool | Column = False
        rows = rows.withColumn("report_type_source", F.lit(None).cast("string"))
        if self.policy.report_types:
            rules = self.policy.tables(self.spark)
            rows = scopes_.document_types(rows, rules["types"], rules["splits"]).withColumnRenamed("report_type", "_configured")
            configured = F.col("_configured")
            half = F.coalesce(configured.isin(*self.policy.halves), F.lit(False)) if self.policy.halves else False
        facts = name_facts("name", configured, half)
        known = lambda c: F.col(f"_{c}").cast("string") if c in given else F.lit(None).cast("string")
        rows = rows.withColumn("f", facts)
        return rows.select("doc_id", "name", "content_hash", F.coalesce(known("period"), "f.period").alias("period"), F.coalesce(known("report_type"), "f.report_type").alias("report_type"), "report_type_source", known("company").alias("company"), known("region").alias("region"))

    def routed_search(self, queries: DataFrame, k: int = 5, match: str = "page") -> DataFrame:
        """``search`` of each question within the documents that its period, report type, company and region name; with ``reason``.

        A question that names no scope is searched in all documents.
        """
        docs = self.store.documents()
        if docs is None:
            return self.search(queries, k).withColumn("reason", F.lit("no_meta"))
        rules = self.policy.tables(self.spark)
        routes, scopes = scopes_.routed(queries.select("query_id", "query"), docs, rules["types"], rules["splits"], rules["aliases"])
        routes = written(routes.select("query_id", "reason"), "routes")
        own = queries.join(routes.where("reason = 'routed'").select("query_id"), "query_id", "left_semi")
        free = queries.join(routes.where("reason != 'routed'").select("query_id"), "query_id", "left_semi")
        found = self.search(own, k, scopes, match).unionByName(self.search(free, k, None, match))
        return found.join(routes, "query_id")

    def _index_is_current(self, docs: DataFrame) -> None:
        """Make the index of documents anew that has another version or is missing."""
        old = docs if "index_version" not in docs.columns else docs.where(~F.col("index_version").eqNullSafe(F.lit(bm25.VERSION)))
        ids = old.select("doc_id")
        if self.store.table("postings") is not None and not ids.limit(1).count():
            return
        of = lambda name: self.store.table(name).drop("bucket").join(ids, "doc_id", "left_semi")
        self.store.upsert({"documents": old.withColumn("index_version", F.lit(bm25.VERSION))} | _index_tables(of("pages"), of("passages")))

    def _stored_index(self, prefix: str, docs: DataFrame) -> bm25.Index:
        """The stored index of the documents that are listed."""
        listed = docs.select("doc_id")
        found = (self.store.table(prefix + t).drop("bucket").join(listed, "doc_id", "left_semi") for t in ("postings", "lengths"))
        return bm25.Index(*found)

    def search(self, queries: DataFrame, k: int = 5, scopes: DataFrame | None = None, match: str = "page") -> DataFrame:
        """``query_id, rank, doc_id, name, page, score, label, section, node_id, snippet`` of the best pages.

        ``queries(query_id, query)``; ``match``: ``page`` or ``passage``. Ranks come from the stored
        index alone; sections and snippets are made for the hits alone.
        """
        paged, docs = self.store.table("pages"), self.store.documents()
        if paged is None or docs is None:
            return self.spark.createDataFrame([], "query_id string, rank int, doc_id string, name string, page int, score double, label string, section string, node_id string, snippet string")
        self._index_is_current(docs)
        docs = self.store.documents()
        found = bm25.index_scores(self._stored_index("", docs), queries, scopes)
        if match == "passage":
            within = bm25.index_scores(self._stored_index("passage_", docs), queries, scopes)
            where = self.store.table("passages").select("doc_id", "page", _passage_unit().alias("unit"))
            hits = bm25.best_passages(within, found, where, k)
        else:
            hits = bm25.top_k(found, k)
        hits = hits.withColumnRenamed("unit", "page").join(queries, "query_id").join(paged.select("doc_id", "page", "markdown", "label"), ["doc_id", "page"]).join(docs.select("doc_id", "name"), "doc_id")
        place = as_column(lambda t, q: heading_before(t, best_place(t, q)), "string")
        piece = as_column(snippet, "string")
        hits = hits.withColumns({"heading": place("markdown", "query"), "snippet": piece("markdown", "query")})
        out = trees.section_for(hits, self.store.table("nodes").drop("bucket"))
        return out.select("query_id", "rank", "doc_id", "name", "page", "score", "label", "section", "node_id", "snippet")

    def _resolve(self, name: str) -> dict:
        docs = self.store.documents()
        found = [] if docs is None else docs.where((F.col("name") == name) | (F.col("doc_id") == name)).orderBy(F.desc("created_at"), F.desc("doc_id")).limit(1).collect()
        if not found:
            close = [] if docs is None else self._close_names(name, docs)
            raise LookupError(f"no document {name!r}; close: {', '.join(close) or 'none'}")
        return found[0].asDict()

    def _close_names(self, name: str, docs: DataFrame, most: int = 3) -> list[str]:
        """The names most like ``name`` among all: each partition names its best, of which the best are taken."""

        def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"name": close_names(name, frame["name"].tolist(), most)}, dtype="string")

        found = docs.select("name").where("name is not null").distinct().mapInPandas(best, "name string")
        held: list[str] = []
        for r in found.toLocalIterator():
            held = close_names(name, sorted({*held, r["name"]}), most)
        return held

    def search_pages(self, query: str, doc_name: str | None = None, top_k: int = 5) -> list[dict]:
        """The best pages for a query, of one document or of all; at most 20."""
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        scope = self.spark.createDataFrame([("q", self._resolve(doc_name)["doc_id"])], "query_id string, doc_id string") if doc_name else None
        return [r.asDict() for r in self.search(asked, min(20, max(1, top_k)), scope).orderBy("rank").collect()]

    def browse(self, offset: int = 0, limit: int = 20, report_type: str | None = None) -> list[dict]:
        """Documents, the newest first, each with ``total`` and ``has_more`` of the listing."""
        docs = self.store.documents()
        return [] if docs is None else [r.asDict() for r in routing.listing(docs, offset, limit, report_type=report_type).collect()]

    def resolve_citations(self, answer: str) -> dict:
        """An answer with numbered links for its citations, and each citation with the id of its document."""
        docs = self.store.documents()
        known = self.spark.createDataFrame([], "doc_id string, name string") if docs is None else docs.select("doc_id", "name")
        asked = self.spark.createDataFrame([("a", answer)], "answer_id string, text string")
        found = [r.asDict() for r in citations.resolved(asked, known).orderBy("index").collect()]
        for c in found:
            if c["candidates"]:
                raise LookupError(f"several documents are named {c['document']!r}: {', '.join(c['candidates'])}")
        return {"answer": asked.select(citations.linked("text")).first()[0], "citations": [{k: v for k, v in c.items() if k not in ("answer_id", "candidates")} for c in found]}

    def get_document(self, name: str) -> dict:
        """A document's facts."""
        return self._resolve(name)

    def structure(self, name: str, part: int = 1, most: int = 95_000) -> dict:
        """A part of a document's outline, nested; a node that outgrows a part is shown in several, each with some of its children."""
        nodes = self.store.of_document("nodes", self._resolve(name)["doc_id"]).orderBy("ord").select("node_id", "parent_id", "title", "start", "end").collect()
        made: dict[str, dict] = {}
        tops: list[dict] = []
        for n in nodes:
            made[n["node_id"]] = own = {"node_id": n["node_id"], "title": n["title"], "start": n["start"], "end": n["end"]}
            (made[n["parent_id"]].setdefault("nodes", []) if n["parent_id"] in made else tops).append(own)
        parts = outline_parts(tops, most)
        return {"part": part, "parts": len(parts), "nodes": parts[min(max(1, part), len(parts)) - 1]}

    def page_content(self, name: str, pages: str, budget: int = 95_000) -> dict:
        """Pages by a list such as ``1-3,7``: the first always, then each that fits."""
        from foliant.functions.text import pages_of

        doc = self._resolve(name)
        spec = self.spark.createDataFrame([(pages,)], "s string").select(pages_of("s").alias("p")).first()["p"]
        if spec is None:
            raise ValueError(f"not a list of pages: {pages!r}")
        rows = self.store.of_document("pages", doc["doc_id"]).where(F.col("page").isin(spec)).select(F.lit("q").alias("query_id"), F.col("page").alias("ord"), F.length("markdown").alias("size"), "markdown")
        taken = evaluate.skip_to_fit(rows, budget).where("taken").select("ord")
        return {"pages": [{"page": r["ord"], "markdown": r["markdown"]} for r in rows.join(taken, "ord").orderBy("ord").collect()], "out_of_range": [p for p in spec if p > (doc["page_num"] or 0)]}

    def remove(self, names: list[str]) -> dict[str, str]:
        """Remove up to ten documents: all names are looked up first."""
        ids = {n: self._resolve(n)["doc_id"] for n in names}
        done = self.store.delete(list(ids.values()))
        return {n: done[i] for n, i in ids.items()}

    def call_tool(self, name: str, arguments: dict | str | None = None) -> dict:
        """Call a tool by name; whatever goes wrong comes back as an error."""
        try:
            given = json.loads(arguments) if isinstance(arguments, str) else dict(arguments or {})
            given = {k: {"true": True, "false": False}.get(v, v) if isinstance(v, str) else v for k, v in given.items()}
            if name not in self.tools:
                return {"success": False, "error": f"unknown tool {name!r}", "errorCode": "UNKNOWN_TOOL"}
            return {"success": True, "result": self.tools[name].run(**given)}
        except (TypeError, ValueError, LookupError) as e:
            return {"success": False, "error": str(e), "errorCode": "INVALID_INPUT"}
        except Exception as e:  # a tool call never raises
            return {"success": False, "error": f"{type(e).__name__}: {e}"[:500], "errorCode": "FAILED"}

    def context(self, questions: DataFrame, k: int = 5, budget: int = 60_000) -> DataFrame:
        """``query_id, context``: the best pages of each question within a budget of characters, cited by page."""
        hits = self.search(questions, k)
        text = self.store.table("pages").select("doc_id", "page", F.col("markdown").alias("text"))
        return evaluate.context_blocks(evaluate.prefetch(hits.join(text, ["doc_id", "page"]), budget).where("kept > 0"))

    def evaluated(self, questions: DataFrame, k: int = 5, scopes: DataFrame | None = None) -> DataFrame:
        """One row of recall and MRR over ``questions(query_id, query, expected, pages)``."""
        hits = self.search(questions.select("query_id", "query"), k, scopes)
        text = self.store.table("pages").select("doc_id", "page", F.col("markdown").alias("text"))
        judged = evaluate.judged(hits.join(text, ["doc_id", "page"]), questions)
        known = questions.where((F.size("pages") > 0) | (F.trim("expected") != ""))
        return evaluate.metrics(evaluate.first_ranks(judged, known), (1, 3, k))


def _passage_unit() -> Column:
    """A number for each passage of a document, in order: the page above 32 bits for the passage."""
    return F.shiftleft(F.col("page").cast("long"), 32) + F.col("passage_no")


def _index_tables(paged: DataFrame, cut: DataFrame) -> dict[str, DataFrame]:
    """The stored tables of the keyword index of pages and passages."""
    units = paged.select("doc_id", F.col("page").alias("unit"), F.col("markdown").alias("text"))
    within = cut.select("doc_id", _passage_unit().alias("unit"), "text")
    return {
        "postings": bm25.postings(units), "lengths": bm25.unit_lengths(units),
        "passage_postings": bm25.postings(within), "passage_lengths": bm25.unit_lengths(within),
    }


def register_sql(spark: SparkSession) -> None:
    """Functions for SQL text: ``foliant_plain``, ``foliant_snippet``, ``foliant_calc``, ``foliant_passages``."""
    from pyspark.sql.functions import udtf

    from foliant.operators.passages import plain, split

    spark.udf.register("foliant_plain", as_column(plain, "string"))
    spark.udf.register("foliant_snippet", as_column(snippet, "string"))
    spark.udf.register("foliant_calc", as_column(lambda e: calc._answer(e, "{}"), "string"))

    @udtf(returnType="passage_no int, start int, end int, text string")
    class Passages:
        def eval(self, markdown: str):
            for n, (a, b, t) in enumerate(split(markdown or "")):
                yield n, a, b, t

    spark.udtf.register("foliant_passages", Passages)


__all__ = ["Library", "Tool", "register_sql", "tokens"]
