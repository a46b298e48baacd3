"""The registered queries of the training-data operators; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language, line_dedup, mixing, perplexity, pii, simhash, topk, toxicity
from .base import crc_mod, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return language.predict(docs, language.train(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net, ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, decoded="decoded")
    return ids.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("new_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, p.place AS place, p.line AS line, translate(trim(p.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'place': i, 'line': x})) AS p FROM documents)
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.place, l.line, f.first_doc IS NOT NULL AND f.first_doc <> l.doc_id AS dropped FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op2_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    made = chat.format_pairs(turns.withColumnRenamed("conv_id", "pair_id"), chat.swapped_replies(turns))
    text = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["length"], x["learn"])), ",")
    return made.select("pair_id", "prompt_turns", "prompt", "chosen", text("chosen_mask").alias("chosen_mask"), "rejected", text("rejected_mask").alias("rejected_mask"), "usable")


OP2_SQL = r"""
WITH last AS (
  SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS n FROM conversations WHERE role = 'assistant') WHERE n = 1
), sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT c.conv_id, 1, c.turn, c.role, CASE WHEN l.turn IS NOT NULL THEN o.text ELSE c.text END
  FROM conversations c LEFT JOIN last l ON l.conv_id = c.conv_id AND l.turn = c.turn AND c.role = 'assistant' LEFT JOIN last o ON o.conv_id = c.conv_id + 1
  WHERE l.turn IS NULL OR o.turn IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS learn FROM sides
), met AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, c.shown IS NOT DISTINCT FROM r.shown AS same
  FROM (SELECT * FROM placed WHERE side = 0) c FULL JOIN (SELECT * FROM placed WHERE side = 1) r ON c.pair_id = r.pair_id AND c.k = r.k
), prefix AS (
  SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS n FROM met GROUP BY pair_id
)
SELECT p.pair_id, p.n AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND k <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND k > n), '') AS chosen,
  coalesce(string_agg(length(shown) || ':' || learn, ',' ORDER BY k) FILTER (side = 0 AND k > n), '') AS chosen_mask,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 1 AND k > n), '') AS rejected,
  coalesce(string_agg(length(shown) || ':' || learn, ',' ORDER BY k) FILTER (side = 1 AND k > n), '') AS rejected_mask,
  coalesce(bool_or(learn = 1) FILTER (side = 0 AND k > n), false) AND coalesce(bool_or(learn = 1) FILTER (side = 1 AND k > n), false) AS usable
FROM prefix p JOIN placed x ON x.pair_id = p.pair_id GROUP BY p.pair_id, p.n
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_email`` to ``n_phone`` and ``base_sha256`` are of the base spans, ``n_spans`` and ``spans`` of all."""
    found = pii.find(table(spark, sf_dir, "documents"))
    seeds = F.filter("spans", lambda x: x["seed"])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(seeds, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(seeds), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_perplexity": op1_perplexity, "op2_chat_preferences": op2_chat_preferences, "op3_line_dedup": op3_line_dedup, "op4_pii": op4_pii, "op5_mixing": op5_mixing, "op6_simhash": op6_simhash, "op7_language": op7_language, "op8_toxicity": op8_toxicity, "op9_byte_bpe": op9_byte_bpe, "op10_topk": op10_topk}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_preferences": OP2_SQL, "op3_line_dedup": OP3_SQL, "op10_topk": OP10_SQL}
