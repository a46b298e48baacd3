"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the network rejects go.
2. line_dedup: lines of ten or more characters stay in the smallest document that holds them.
3. simhash: of each group of near-duplicates the document with the smallest id stays (rows that
   repeat its id stay with it).
4. mixing: documents come as often as the mix takes them; the one at which the mix of a source
   ends is cut there; documents without words go.
5. byte_bpe: token ids, with digests of the ids and of the bytes decoded from them.

All stages but the last return the columns of ``documents``.

Defined cases: a row with a null or empty text is not toxic by itself (the network scores it as a
window without words), keeps its null through line dedup, has fingerprint zero, so that all such rows
are one group of near copies, and is never taken by the mix, as it has no words. A null ``doc_id`` stands
after all others: in line dedup all such rows count as one document, and of a near-duplicate group
whose ids are all null every row stays, since no id tells them apart; in a group that has an id they
go. Rows that repeat an id and a text stay together until the mix, which takes each row as a document of its own.
Other columns, whatever their names, are carried. An empty table gives an empty result. Each stage's
table is deleted once the next one is written, so that two of them at most are on disk.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe, line_dedup, mixing, simhash, toxicity
from quillmesh.llm.base import forget, staged, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net, docs.columns, "toxicity of the row")
    return scored.where(F.col("toxicity of the row") < toxicity.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("new_text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    fresh = {"text": text, "n_chars": n_chars}
    return cut.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = staged(simhash.near_duplicates(docs), "pipeline-groups")
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("stays"))
    named = docs.join(stay.hint("shuffle_hash"), docs["doc_id"] == stay["stays"], "left_semi")
    # Rows without an id are told apart by their fingerprint: they stay where no row of the group has an id.
    alone = found.where("component_id is null").select(F.col("fp").alias("alone")).distinct()
    places = [f"c{i}" for i in range(len(docs.columns))]
    marked = simhash.fingerprints(docs.where("doc_id is null"), keep=docs.columns).toDF(*places, "fp")
    return named.union(marked.join(alone, F.col("fp") == F.col("alone"), "left_semi").select(*places))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), decoded="decoded")
    return ids.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("mixing", mix), ("byte_bpe", tokenize)]

#: The trained network and the tokenizer have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
