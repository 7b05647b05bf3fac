"""Registered queries of single rules: of trees, of routing, of texts and of layout, each over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from foliant.functions import rects, text
from foliant.functions.periods import question_periods, report_type
from foliant.operators import evaluate, layout, pages as pages_, routing, scopes, statistics, tree_rules, trees
from foliant.plans.queries import CTREE, HEADINGS, NODES, customer_tree, document_markdown, orders_as_nodes, query, set_lines, table
from foliant.sources.staging import fresh_path
from foliant.sources.store import Store

# Texts


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, '.', '. . . . . .'), '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g')) AS digest FROM documents""")
def dot_leaders(spark, sf_dir):
    """Documents whose stops are drawn out as leaders are."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.folded_leaders(F.replace("text", F.lit("."), F.lit(". . . . . .")))).alias("digest"))


@query(r"""WITH t AS (SELECT DISTINCT lang AS term FROM documents) SELECT page_id, count(*) AS terms FROM (SELECT page_id, lower(html) AS h FROM pages) JOIN t ON regexp_matches(h, '(^|[^a-z])' || term || '([^a-z]|$)') GROUP BY page_id""")
def terms_in_pages(spark, sf_dir):
    """How many of the languages of documents stand in each page as words."""
    terms = table(spark, sf_dir, "documents").select(F.col("lang").alias("term")).distinct()
    found = table(spark, sf_dir, "pages").select("page_id", "html").join(routing.small(terms), text.contains_term("term", "html", whole=True))
    return found.groupBy("page_id").agg(F.count("*").alias("terms"))


@query(r"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(t, '\p{Lu}')) AS upper, len(regexp_extract_all(t, '\p{Ll}')) AS lower, len(regexp_extract_all(t, '\p{Nd}')) AS digits, len(regexp_extract_all(t, '\p{P}')) AS punctuation FROM c)
SELECT doc_id, upper::INT AS upper, lower::INT AS lower, digits::INT AS digits, punctuation::INT AS punctuation FROM n""")
def char_class_counts(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", text.char_classes("text").alias("c"))
    return c.select("doc_id", "c.upper", "c.lower", "c.digits", "c.punctuation")


@query(HEADINGS.split(",\nh AS")[0] + """ SELECT doc_id, 0 AS tables, 0 AS table_rows, (1 + max(n))::INT AS headings FROM k GROUP BY doc_id""")
def extractor_statistics(spark, sf_dir):
    s = document_markdown(spark, sf_dir).select("doc_id", text.markdown_stats("text").alias("s"))
    return s.select("doc_id", *[F.col(f"s.{c}").cast("int").alias(c) for c in ("tables", "table_rows", "headings")])


@query("""SELECT o_orderkey, '[' || CASE o_orderkey % 4 WHEN 0 THEN 'quarterly' WHEN 1 THEN 'interim' WHEN 2 THEN 'annual' ELSE 'other' END || ' · ' || year(o_orderdate) || ']' AS label, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS created FROM orders""")
def document_labels(spark, sf_dir):
    """Types that are named in four ways, and times in UTC."""
    o = table(spark, sf_dir, "orders")
    named = F.element_at(F.array(*map(F.lit, ["Quarter report", "six months to June", "Annual review", "press release"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    year = F.year("o_orderdate").cast("string")
    label = F.concat(F.lit("["), F.concat_ws(" · ", report_type(named, F.lit(None).cast("string")), year), F.lit("]"))
    return o.select("o_orderkey", label.alias("label"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created"))


@query("""SELECT o_orderkey, list_distinct([year(o_orderdate)::VARCHAR, '20' || right((year(o_orderdate) + o_orderkey % 2)::VARCHAR, 2)]).list_sort().array_to_string(',') AS years FROM orders WHERE year(o_orderdate) >= 2000
UNION ALL SELECT o_orderkey, list_sort([year(o_orderdate)::VARCHAR, '20' || right((year(o_orderdate) + o_orderkey % 2)::VARCHAR, 2)]).array_to_string(',') FROM orders WHERE year(o_orderdate) < 2000""")
def question_years(spark, sf_dir):
    """Questions on a year in four figures and on a fiscal one in two."""
    o, year = table(spark, sf_dir, "orders"), F.year("o_orderdate")
    asked = F.concat(F.lit("results of "), year.cast("string"), F.lit(" against FY"), F.substring((year + (F.col("o_orderkey") % 2)).cast("string"), 3, 2))
    return o.select("o_orderkey", F.array_join(F.array_sort(question_periods(asked)), ",").alias("years"))


# Trees


@query(HEADINGS + """ SELECT doc_id, ord, "start" AS first, coalesce(lead("start") OVER (PARTITION BY doc_id ORDER BY "start") - 1, max("end") OVER (PARTITION BY doc_id))::INT AS last, 'Page ' || ord AS title FROM h""")
def page_marker_chapters(spark, sf_dir):
    """Lines of documents with a page mark at each of their headings: a chapter for each."""
    lines = pages_.lines(document_markdown(spark, sf_dir))
    nodes = trees.heading_nodes(lines)
    last = lines.groupBy("doc_id").agg(F.max("line_no").alias("last_line"))
    marks = nodes.select("doc_id", F.col("start").alias("line_no"), F.col("ord").alias("page")).join(last, "doc_id")
    return trees.page_marker_chapters(marks).select("doc_id", "ord", F.col("start").alias("first"), F.col("end").alias("last"), "title")


@query(NODES + """, f AS (SELECT doc_id, count(*) AS n, (doc_id % 5 + 1) AS pages, avg(CASE WHEN doc_id % 3 = 0 AND ord % 2 = 0 THEN 1 ELSE 0 END) AS fake FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 3 * pages THEN 'too many nodes' WHEN fake > 0.25 THEN 'too many fake titles' END AS reason FROM f""")
def bad_trees(spark, sf_dir):
    """Orders as nodes, some with figures for titles, over few pages."""
    nodes = orders_as_nodes(spark, sf_dir).withColumn("title", F.when((F.col("doc_id") % 3 == 0) & (F.col("ord") % 2 == 0), "12.5%").otherwise(F.col("title")))
    counts = nodes.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 5 + 1).alias("pages"), F.lit("layout").alias("toc_source"))
    return trees.bad_tree_reason(nodes, counts)


@query(NODES + """, f AS (SELECT doc_id, count(*) AS top, (doc_id % 7 * 9 + 5) AS pages FROM n GROUP BY doc_id) SELECT doc_id, top, top > greatest(15.0, pages / 3) AND top < 0.8 * pages AS flat FROM f""")
def flat_tops(spark, sf_dir):
    nodes = orders_as_nodes(spark, sf_dir)
    counts = nodes.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 7 * 9 + 5).alias("pages"))
    return trees.flat_top(nodes, counts).select("doc_id", F.col("top").cast("long").alias("top"), "flat")


@query(NODES + """, g AS (SELECT doc_id, count(*) AS n, min_by(title, ord) AS first FROM n GROUP BY doc_id) SELECT doc_id, CASE WHEN n >= 2 THEN first || ' + ' || (n - 1) || ' more' END AS title FROM g""")
def union_titles(spark, sf_dir):
    one = orders_as_nodes(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("x"))
    return one.select("doc_id", trees.short_union_name(F.transform("x", lambda t: t["title"])).alias("title"))


@query(NODES + """, g AS (SELECT doc_id, min(s) AS first FROM n GROUP BY doc_id) SELECT doc_id, title, s AS page FROM n UNION ALL SELECT doc_id, 'Preface', 1 FROM g WHERE first > 1""")
def late_prefaces(spark, sf_dir):
    items = orders_as_nodes(spark, sf_dir).select("doc_id", "title", F.col("start").alias("page"))
    return trees.add_preface(items)


@query(CTREE + """, a AS (SELECT doc_id, node_id, parent_id FROM leaf UNION ALL SELECT doc_id, node_id, NULL FROM top),
small AS (SELECT parent_id FROM leaf GROUP BY doc_id, parent_id HAVING 3 + 2 * count(*) < 120) SELECT a.doc_id, a.node_id, CASE WHEN a.parent_id IS NULL AND a.node_id IN (SELECT parent_id FROM small) THEN (SELECT count(*) FROM leaf WHERE leaf.doc_id = a.doc_id AND leaf.parent_id = a.node_id) ELSE 0 END AS folded FROM a WHERE a.parent_id IS NULL OR a.parent_id NOT IN (SELECT parent_id FROM small)""")
def token_thinned(spark, sf_dir):
    """Nations of three tokens and customers of two: nations under 120 are folded."""
    nodes = trees.with_path_ids(customer_tree(spark, sf_dir)).withColumn("own_tokens", F.when(F.col("depth") == 1, 3).otherwise(2))
    return tree_rules.thinned(nodes, 120).select("doc_id", "node_id", F.col("folded").cast("long").alias("folded"))


@query(CTREE + """, m AS (SELECT top.doc_id, top.node_id, top.e - top.s + 1 AS span, 1 + greatest(max(leaf.e - leaf.s + 1), coalesce(max(rest.pages), 0)) AS cost FROM top JOIN leaf ON leaf.doc_id = top.doc_id AND leaf.parent_id = top.node_id LEFT JOIN rest ON rest.doc_id = top.doc_id AND rest.node_id = top.node_id GROUP BY top.doc_id, top.node_id, top.s, top.e),
gone AS (SELECT doc_id, node_id FROM m WHERE span <= cost) SELECT doc_id, node_id FROM top UNION ALL SELECT leaf.doc_id, leaf.node_id FROM leaf ANTI JOIN gone ON gone.doc_id = leaf.doc_id AND gone.node_id = leaf.parent_id""")
def merged_trees(spark, sf_dir):
    return trees.merged(customer_tree(spark, sf_dir)).select("doc_id", "node_id")


@query(HEADINGS + """ SELECT doc_id, count(*) AS nodes, max(depth)::INT AS depth, 1::BIGINT AS top, max(depth)::INT AS longest_path FROM h GROUP BY doc_id""")
def audit_of_headings(spark, sf_dir):
    return statistics.audit_depth(trees.heading_nodes(pages_.lines(document_markdown(spark, sf_dir))))


# Routing and budgets


@query("""WITH q AS (SELECT r_regionkey AS query_id, lower(r_name) AS term FROM region), n AS (SELECT p_brand AS doc_id, p_partkey AS ord, p_name || ' ' || lower((SELECT min(r_name) FROM region WHERE r_regionkey = p_partkey % 5)) AS title, CASE WHEN p_partkey % 3 = 0 THEN 'in ' || (SELECT min(r_name) FROM region WHERE r_regionkey = p_partkey % 4) END AS summary FROM part),
w AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(term, '[a-z]{3,}'))) AS term FROM q), s AS (SELECT query_id, doc_id, ord, sum(CASE WHEN contains(lower(title), term) THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(summary, '')), term) THEN 0.5 ELSE 0 END) AS score FROM w, n GROUP BY ALL)
SELECT query_id, doc_id, ord, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS rank FROM s) WHERE rank <= 3""")
def best_sections(spark, sf_dir):
    """Regions asked for in parts as sections, whose titles and summaries name regions in turn."""
    region = table(spark, sf_dir, "region")
    names = F.broadcast(region.select(F.col("r_regionkey").alias("k"), F.lower("r_name").alias("low"), "r_name"))  # five rows
    nodes = table(spark, sf_dir, "part").join(names, F.col("p_partkey") % 5 == F.col("k")).drop("k", "r_name").join(names.select("k", F.col("r_name").alias("other")), F.col("p_partkey") % 4 == F.col("k"))
    nodes = nodes.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(" "), "low").alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("in "), "other")).alias("summary"))
    return routing.best_sections(region.select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("query")), nodes).select("query_id", "doc_id", "ord", "score", "rank")


@query("""WITH f AS (SELECT source || '/' || lang || '/' || doc_id AS path FROM documents), d AS (SELECT DISTINCT source || '/' || lang AS dir FROM documents WHERE doc_id % 7 = 0) SELECT path FROM f WHERE EXISTS (SELECT 1 FROM d WHERE starts_with(path, dir || '/'))""")
def files_under_folders(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dirs = docs.where("doc_id % 7 = 0").select(F.concat_ws("/", "source", "lang").alias("dir")).distinct()
    return routing.files_under(docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")), dirs)


@query("""WITH RECURSIVE li AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents),
r AS (SELECT doc_id, 1 AS ord, length(line) AS used, true AS taken FROM li WHERE ord = 1 UNION ALL SELECT r.doc_id, li.ord, r.used + CASE WHEN r.used + length(line) <= 900 THEN length(line) ELSE 0 END, r.used + length(line) <= 900 FROM r JOIN li ON li.doc_id = r.doc_id AND li.ord = r.ord + 1)
SELECT doc_id AS query_id, count(*) FILTER (taken) AS taken, max(ord) FILTER (taken)::INT AS last FROM r GROUP BY doc_id""")
def content_budget(spark, sf_dir):
    """Lines of each document within 900 characters: the first always, then each that still fits."""
    lines = set_lines(spark, sf_dir, 1 << 30).select(F.col("doc_id").alias("query_id"), (F.col("k") + 1).alias("ord"), F.length("text").alias("size"))
    return evaluate.skip_to_fit(lines, 900).where("taken").groupBy("query_id").agg(F.count("*").alias("taken"), F.max("ord").alias("last"))


@query("""SELECT doc_id AS query_id, doc_id % 3 AS kind FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 < 2""")
def calc_suspects(spark, sf_dir):
    """Answers of three wordings, of which every other one was calculated."""
    d = table(spark, sf_dir, "documents")
    words = F.when(F.col("doc_id") % 3 == 0, "profit growth was high").when(F.col("doc_id") % 3 == 1, "12% of the sum").otherwise("it was good")
    answers = d.select(F.col("doc_id").alias("query_id"), words.alias("answer"), F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("calculate"))).otherwise(F.array(F.lit("search_pages"))).alias("tools"))
    return evaluate.calc_suspects(answers).select("query_id", (F.col("query_id") % 3).alias("kind"))


TYPES = [(0, "pack", "folder", "src1"), (1, "news", "alias", "daily"), (2, "web", "folder", "src2"), (3, "fine", "alias", "fr")]


@query("""WITH f AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN 'Daily ' ELSE 'Day ' END || lang || ' ' || doc_id || '.md' AS name FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(source, '(^|[^a-z])src1') THEN CASE WHEN doc_id % 5 = 0 THEN 'news' ELSE 'pack' END WHEN regexp_matches(source, '(^|[^a-z])src2') THEN 'web' WHEN doc_id % 5 = 0 THEN 'news' WHEN lang = 'fr' THEN 'fine' END AS report_type,
CASE WHEN regexp_matches(source, '(^|[^a-z])src[12]') THEN 'folder' WHEN doc_id % 5 = 0 OR lang = 'fr' THEN 'filename' END AS report_type_source FROM f""")
def document_types(spark, sf_dir):
    """Types of a policy by folders (sources), refined by names, and by names alone."""
    types = spark.createDataFrame(TYPES, "ord int, key string, kind string, term string")
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, "Daily ").otherwise("Day "), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".md"))
    files = d.select("doc_id", F.concat("source", F.lit("/"), name).alias("path"), name.alias("name"))
    return scopes.document_types(files, types, spark.createDataFrame([("pack", "news")], "key string, sub string")).select("doc_id", "report_type", "report_type_source")


ASKED = [(1, "profit of 1995"), (2, "profit in the first half of 1993 and in 1996"), (3, "profit of 1994 in the Building Report"), (4, "profit of FY97 in machinery"), (5, "profit"), (6, "profit of 2070")]


@query("""WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate) END AS y, CASE o_orderkey % 4 WHEN 0 THEN 'annual' WHEN 1 THEN 'interim' WHEN 2 THEN 'building' END AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN c_mktsegment END AS company FROM orders JOIN customer ON c_custkey = o_custkey),
q(query_id, allowed, half, kind, company) AS (VALUES (1, [1995, 1996], false, NULL, NULL), (2, [1993, 1994, 1996, 1997], true, NULL, NULL), (3, [1994, 1995], false, 'building', 'BUILDING'), (4, [2097, 2098], false, NULL, 'MACHINERY'), (6, [2070, 2071], false, NULL, NULL)),
a AS (SELECT d.*, q.query_id, q.half, q.kind AS k, q.company AS c, y IS NULL OR list_contains(allowed, y) AS ok FROM d, q),
b AS (SELECT *, ok AND (y IS NULL OR NOT half OR kind = 'interim' OR kind IS NULL OR kind = 'building') AS i1 FROM a), c AS (SELECT *, CASE WHEN half AND bool_or(i1 AND kind = 'interim') OVER w THEN i1 ELSE ok END AS i2 FROM b WINDOW w AS (PARTITION BY query_id)),
e AS (SELECT *, bool_or(i2 AND y IS NOT NULL) OVER w AS known, i2 AND (NOT bool_or(i2 AND coalesce(kind = k, false)) OVER w OR kind IS NULL OR coalesce(kind = k, false)) AS i3 FROM c WINDOW w AS (PARTITION BY query_id)),
g AS (SELECT *, i3 AND (NOT bool_or(i3 AND coalesce(company = c, false)) OVER w OR company IS NULL OR coalesce(company = c, false)) AS i4 FROM e WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id FROM g WHERE known AND i4""")
def scoped_documents(spark, sf_dir):
    """Six questions on years, a half, a type and companies against orders as documents with segments for companies."""
    o, key = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")), F.col("o_orderkey")
    docs = o.select(key.alias("doc_id"), F.when(key % 11 != 0, F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"))).alias("period"), F.when(key % 4 == 0, "annual").when(key % 4 == 1, "interim").when(key % 4 == 2, "building").alias("report_type"), F.when(key % 3 != 0, F.col("c_mktsegment")).alias("company"))
    types = spark.createDataFrame([(0, "building", "alias", "Building Report")], "ord int, key string, kind string, term string")
    return scopes.routed(spark.createDataFrame(ASKED, "query_id int, query string"), docs, types)[1]


# Layout and storage


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_linenumber * 10.0::DOUBLE AS y, 20.0 + l_quantity AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_partkey) AS nth FROM lineitem), p AS (SELECT *, lag(x) OVER o AS x2, lag(y) OVER o AS y2, lag(w) OVER o AS w2 FROM r WINDOW o AS (PARTITION BY l_orderkey ORDER BY nth))
SELECT l_orderkey, nth, greatest(least(x + w, x2 + w2) - greatest(x, x2), 0) AS shared, round(greatest(least(x + w, x2 + w2) - greatest(x, x2), 0) * greatest(15 - abs(y - y2), 0) / (15 * least(w, w2)), 6) AS overlap, CASE WHEN abs(x - x2) <= 2 THEN 'left' WHEN abs(x + w - x2 - w2) <= 2 THEN 'right' WHEN abs(x + w / 2 - x2 - w2 / 2) <= 2 THEN 'centre' END AS aligned FROM p WHERE x2 IS NOT NULL""")
def rectangles(spark, sf_dir):
    """Line items as boxes 15 high, one 10 above the other: what each shares with the one before it."""
    li = table(spark, sf_dir, "lineitem")
    box = rects.rect("l_quantity", F.col("l_quantity") * 2 + 20, F.col("l_linenumber") * 10.0 + 15, F.col("l_linenumber") * 10.0)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")
    pairs = li.select("l_orderkey", F.row_number().over(order).cast("long").alias("nth"), box.alias("a"))
    pairs = pairs.withColumn("b", F.lag("a").over(Window.partitionBy("l_orderkey").orderBy("nth"))).where("b is not null")
    a, b = F.col("a"), F.col("b")
    return pairs.select("l_orderkey", "nth", rects.shared_width(a, b).alias("shared"), F.round(rects.overlap(a, b), 6).alias("overlap"), rects.aligned(a, b, 2.0).alias("aligned"))


@query("""WITH li AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents), p AS (SELECT doc_id, n // 40 AS page, CASE WHEN (n // 40) % 3 = 2 THEN 1 ELSE 0 END AS wide FROM li GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS pages, sum(wide)::BIGINT AS landscape, CASE WHEN quantile_cont(CASE WHEN wide = 1 THEN 800.0 ELSE 600.0 END, 0.5) IS NULL THEN 0 ELSE quantile_cont(CASE WHEN wide = 1 THEN 800.0 ELSE 600.0 END, 0.5) END AS width FROM p GROUP BY doc_id),
l AS (SELECT doc_id, quantile_cont(least(length(line), 90) * 5.0, 0.5) AS line_width FROM li GROUP BY doc_id) SELECT doc_id, pages, landscape, width::DOUBLE AS width, line_width::DOUBLE AS line_width FROM s JOIN l USING (doc_id)""")
def document_statistics(spark, sf_dir):
    """Lines of documents set on pages of 40, of which every third is wide."""
    lines = set_lines(spark, sf_dir, 40)
    wide = F.col("page") % 3 == 0
    pages = lines.select("doc_id", "page").distinct().select("doc_id", "page", F.when(wide, 800.0).otherwise(600.0).alias("width"), F.lit(700.0).alias("height"))
    boxes = lines.select("doc_id", "page", F.lit(50.0).alias("left"), (50 + F.least(F.length("text"), F.lit(90)) * 5.0).alias("right"), F.lit(10.0).alias("font_size"), "text")
    return layout.document_statistics(boxes, pages).select("doc_id", "pages", "landscape", "width", "line_width")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb FROM e a JOIN e b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.45),
t AS (SELECT la AS label, a AS key, a, b, la <> lb AS across FROM p UNION ALL SELECT lb, b, a, b, la <> lb FROM p), d AS (SELECT label, count(DISTINCT key) AS repeated FROM t GROUP BY label), n AS (SELECT label, count(*) AS pairs, sum(across::INT)::BIGINT AS across FROM (SELECT DISTINCT label, a, b, across FROM t) GROUP BY label)
SELECT label AS doc_id, chunks, coalesce(repeated, 0) AS repeated, coalesce(pairs, 0) AS pairs, coalesce(across, 0)::BIGINT AS across FROM (SELECT label, count(*) AS chunks FROM embeddings GROUP BY label) LEFT JOIN d USING (label) LEFT JOIN n USING (label)""")
def duplication_probe(spark, sf_dir):
    return statistics.vector_duplication(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 0.45)


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR || 'x' ELSE doc_id::VARCHAR END AS key, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS round, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id::VARCHAR, 1, md5(coalesce(text, '')) FROM documents WHERE doc_id % 3 <> 0""")
def store_round_trip(spark, sf_dir):
    """Documents written to a store, a third of them written anew under other names, and all read back."""
    store = Store(spark, fresh_path(spark, "store"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("completed").alias("status"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("number"))
    one = lambda rows, round_, suffix: {"documents": rows.select("doc_id", "status", F.concat("doc_id", F.lit(suffix)).alias("key"), F.lit(round_).alias("round")), "pages": rows.select("doc_id", F.lit(1).alias("page"), F.md5("text").alias("digest"))}
    store.upsert(one(docs, 1, ""))
    store.upsert(one(docs.where("number % 3 = 0"), 2, "x"))
    return store.documents().join(store.table("pages").drop("bucket"), "doc_id").select("key", "round", "digest")
