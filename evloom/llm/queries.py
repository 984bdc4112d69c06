"""Registered queries of the corpus operators and, where SQL can express one, the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.llm import (bpe, chat_format, hard_negatives, line_dedup, near_dedup, packing, pairwise_quality, pii, quality_rules, scan_search,
                        substring_dedup, topk_search, toxicity)
from evloom.llm.tables import table
from evloom.llm.vocabulary import read_added, read_ranks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def _ranks() -> bytes:
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


LINES = r"""WITH d AS (SELECT *, string_split(text, chr(10)) AS ls, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS ts FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ts) + 1)) AS p, unnest(ts) AS t FROM d),
x AS (SELECT doc_id, p, length(t) AS n, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) > 1 AND length(t) >= 40 AS alone, lag(t) OVER o || chr(10) || t AS pair FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
y AS (SELECT *, pair IS NOT NULL AND row_number() OVER (PARTITION BY pair ORDER BY doc_id, p) > 1 AS tied FROM x),
z AS (SELECT *, coalesce(lead(tied) OVER (PARTITION BY doc_id ORDER BY p), false) AS ties FROM y),
r AS (SELECT doc_id, p, n, sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM z WHERE alone OR tied OR ties),
gone AS (SELECT doc_id, list(p) AS ps FROM (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id, run) AS size FROM r) s WHERE size >= 40 GROUP BY 1)
SELECT d.doc_id, array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT coalesce(list_contains(ps, i), false)), lambda i: ls[i]), chr(10)) AS text,
  lang, source, n_chars, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed_lines FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id"""
NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
g AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c AS (SELECT doc_id AS node, doc_id AS low FROM s UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(low) AS component_id FROM c GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON node = doc_id"""
SEARCH = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D!-/:-@\[-`{-~]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1),
k AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM documents) AS av),
r AS (SELECT q.doc_id AS query_id, f.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score
  FROM (SELECT DISTINCT doc_id, term FROM t WHERE doc_id % 50 = 0) q JOIN f ON f.term = q.term JOIN df ON df.term = f.term JOIN dl ON dl.doc_id = f.doc_id, k GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM r)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 10"""
CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length(role) + length(text) + 17 + len(regexp_extract_all(role, p)) + len(regexp_extract_all(text, p)) AS chars FROM t, (SELECT '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>' AS p) v)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM x GROUP BY 1"""


@query("op2_line_dedup", LINES)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(table(spark, sf_dir, "documents"), key="corpus")


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_near_dedup", NEAR)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), _ranks(), public_tokenizers.PATTERN)
    return bpe.decode(coded, _ranks()).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_topk_search", SEARCH)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = topk_search.search(docs, docs.where(F.col("doc_id") % 50 == 0))
    return found.withColumn("score", F.round("score", 6))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = toxicity.score(docs.select("doc_id", "text"), *toxicity.train(docs, labels.where(~held_out)), name="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _ranks(), public_tokenizers.PATTERN,
                        added=read_added(public_tokenizers.path("byte_bpe_50k.json")))


@query("op8_chat_format", CHAT)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra), _ranks(), public_tokenizers.PATTERN), _ranks())


SCAN = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY 1) x, k),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN f ON f.term = q.term JOIN w ON w.term = q.term JOIN d ON d.doc_id = f.doc_id, k GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""
NEGATIVES = r"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) x WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""


@query("op11_scan_search", SCAN)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_hard_negatives", NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("op13_pairwise_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = pairwise_quality.score(docs.select("doc_id", "text"), pairwise_quality.train(docs, labels.where(~held_out)), name="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
