"""The registered query of each operator of this package, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import bpe, conversations, pii, quality, secrets
from foliant.llm.ann import nearest
from foliant.llm.contamination import leaks
from foliant.llm.negatives import hard_negatives, quantized
from foliant.llm.packing import pack_best_fit
from foliant.llm.paragraphs import removals
from foliant.llm.sharding import shard_by_bytes
from foliant.llm.simhash import near_duplicates
from foliant.llm.sstable import token_tables
from foliant.operators.joins import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one in fewer parts than there are cores is dealt to all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return dealt.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("pii_base", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed("pii_base"), 256).alias("base_sha256"), pii.listed("pii_spans").alias("spans"))


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents")).drop("row")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    found = quality.classify(docs, model)
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", F.floor(F.length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), *ranks).drop("text")
    back = bpe.decoded(tokens, *ranks)
    return back.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(original), original)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantized(vectors, label), F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_latent_decontamination, op3_simhash_near_dedup, op4_cross_polytope_ann, op5_histogram_sort_sharding,
        op6_pii_spans, op7_paragraph_minhash, op8_quality_classifier, op9_secret_scan, op10_token_tables,
        op11_byte_level_bpe, op12_conversation_repair, op13_hard_negatives,
    )
}
#: The CRC-32 of a text of ASCII signs, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"


def _path(path: str, cost: str, letter: str, line: str | None) -> str:
    """A path of the oracle below, one edit longer: its cost, its audit and the lines it keeps."""
    kept = f"list_append({path}.l, {line})" if line else f"{path}.l"
    return f"CASE WHEN {path} IS NOT NULL THEN {{'c': ({path}.c + {cost})::BIGINT, 'w': {path}.w || '{letter}', 'l': {kept}}} END"


def _repair_sql() -> str:
    """Turn by turn for all conversations at once: the least path in each of four states (n, s, u, a)."""
    ins = lambda inner: f"SELECT * EXCLUDE (a), least(a, {_path('u', '3', 'I', repr('assistant:'))}) AS a FROM (SELECT * EXCLUDE (u), least(u, {_path('least(n, s, a)', '3', 'I', repr('user:'))}) AS u FROM ({inner}))"
    taken = lambda path, i, role: f"CASE WHEN NOT blank AND NOT again THEN CASE WHEN i = '{i}' THEN {_path(path, 'more', 'K', 'line')} ELSE {_path(path, '3 + more', 'R', repr(role + ':') + ' || text')} END END"
    gone = {x: _path(x, "4", "D", None) for x in "nsua"}
    turn = "SELECT r.*, f.text, f.i, f.blank, f.again, f.role || ':' || f.text AS line, CASE WHEN f.cut THEN 3 ELSE 0 END AS more FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1"
    opened = f"CASE WHEN NOT blank AND NOT again AND i = 's' THEN {_path('n', 'more', 'K', 'line')} END"
    step = f"SELECT conv_id, pos + 1, {gone['n']}, least({gone['s']}, {opened}), least({gone['u']}, {taken('least(n, s, a)', 'u', 'user')}), least({gone['a']}, {taken('u', 'a', 'assistant')}) FROM ({ins(turn)})"
    none = "NULL::STRUCT(c BIGINT, w VARCHAR, l VARCHAR[])"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format(key)} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AND NOT blank AS again, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, pos, blank, again, cut AND NOT blank AND NOT again AS cut, before FROM g),
r(conv_id, pos, n, s, u, a) AS (SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'w': '', 'l': []::VARCHAR[]}}, {none}, {none}, {none} FROM f UNION ALL {step}),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS pos FROM f GROUP BY conv_id),
b AS (SELECT conv_id, pos, least(n, a) AS best FROM ({ins('SELECT * FROM r')}))
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.w, '') AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM x.conv_id AND b.pos = t.pos"""  # fmt: skip


NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 3"""  # fmt: skip
#: The others are not expressible in SQL on whole tables; each is tested against brute force, a round trip or held-out rows.
ORACLE_SQL = {"op12_conversation_repair": _repair_sql(), "op13_hard_negatives": NEGATIVES_SQL}
