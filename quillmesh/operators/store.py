"""The store's small operators: point reads, clearing, key-value rows, caches, glossary, roll-ups, rendering."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.intent import paraphrase_key
from .common import maybe_broadcast
from .ingest import glossary_chunks, upsert

#: Tables that clearing empties; repos and the graph stay.
CLEARED = ("chunks", "files", "enrichments")


def get(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the chunks in ``ids`` (chunk_id)."""
    return chunks.join(maybe_broadcast(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")


def exists(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, found) for every id asked."""
    own = chunks.select("chunk_id", F.lit(True).alias("known")).distinct()
    return ids.select("chunk_id").distinct().join(own, "chunk_id", "left").select("chunk_id", F.coalesce("known", F.lit(False)).alias("found"))


def clear(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables, those in ``CLEARED`` without rows."""
    return {name: df.limit(0) if name in CLEARED else df for name, df in tables.items()}


def set_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value rows (key, value): new values take the place of old ones."""
    return upsert(meta, new.select("key", "value"), "key")


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return row.value if row else None


def put_enrichments(cache: DataFrame, made: DataFrame) -> DataFrame:
    """Adds (content_hash, context_hash, enricher_id, embedding_text, cached_at); equal keys take the new text."""
    return upsert(cache, made.select(cache.columns), ["content_hash", "context_hash", "enricher_id"])


def paraphrase_hits(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known: query_id, query, paraphrases; unknown: query_id, query) by the query in lower case without outer blanks."""
    keyed = queries.select("query_id", "query", paraphrase_key(F.col("query")).alias("key"))
    return keyed.join(cache.select("key", "paraphrases"), "key").drop("key"), keyed.join(cache.select("key"), "key", "left_anti").drop("key")


def put_paraphrases(cache: DataFrame, made: DataFrame, most: int = 1000) -> DataFrame:
    """Cache rows (key, paraphrases, created_at) with those of ``made`` (query, paraphrases, created_at); when there
    would be more than ``most``, the older half goes."""
    fresh = made.select(paraphrase_key(F.col("query")).alias("key"), "paraphrases", "created_at")
    every = upsert(cache, fresh, "key")
    place = every.withColumn("nth_", F.row_number().over(W.orderBy(F.desc("created_at"), "key"))).withColumn("n_", F.count("*").over(W.partitionBy()))
    return place.where((F.col("n_") <= most) | (F.col("nth_") <= most // 2)).drop("nth_", "n_")


def add_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Glossary rows (term, definition, aliases, category); a term given again is defined anew."""
    return upsert(terms, new.where("term is not null and definition is not null"), "term")


def remove_terms(terms: DataFrame, names: DataFrame) -> DataFrame:
    return terms.join(names.select("term").distinct(), "term", "left_anti")


def index_terms(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """Chunks of the glossary that ``chunks`` does not hold yet, by id (the id changes with the definition)."""
    return glossary_chunks(terms).join(chunks.where("kind = 'glossary'").select("chunk_id"), "chunk_id", "left_anti")


def export_terms(terms: DataFrame) -> DataFrame:
    """(term, yaml): one entry of a glossary file per term, ready to be written as text in order of the term."""
    quote = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)  # noqa: E731  a JSON string is a YAML string
    line = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f"    {key}: "), quote(c)))
    aliases = F.when(F.size("aliases") > 0, F.concat(F.lit("    aliases: "), F.to_json("aliases")))
    entry = F.concat_ws("\n", F.concat(F.lit("  - term: "), quote(F.col("term"))), line("definition", F.col("definition")), aliases, line("category", F.col("category")))
    return terms.select("term", entry.alias("yaml")).orderBy("term")


def roll_up(runs: DataFrame) -> DataFrame:
    """One row over the repos' counters of an indexing run (repo and counts): sums, and how many repos there were."""
    counts = [c for c, t in runs.dtypes if c != "repo" and t in ("bigint", "int")]
    return runs.agg(F.countDistinct("repo").alias("repos"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts))


def tagged(cases: DataFrame, tag: str | None) -> DataFrame:
    """Evaluation cases with a tag; all without one."""
    return cases if tag is None else cases.where(F.array_contains("tags", tag))


def rendered(df: DataFrame, form: str = "table", most: int = 100) -> str:
    """The first ``most`` rows for people (``table``) or programs (``json``: one object a line)."""
    rows = df.limit(most).toJSON().collect() if form == "json" else None
    if rows is not None:
        return "\n".join(rows)
    taken = df.limit(most).collect()
    cells = [df.columns, *([("" if x is None else x if isinstance(x, str) else json.dumps(x, default=str)).replace("\n", " ")[:80] for x in r] for r in taken)]
    wide = [max(map(len, col)) for col in zip(*cells)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in cells)
