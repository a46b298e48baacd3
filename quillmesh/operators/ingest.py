"""Index maintenance without a table format: merges, deltas, freshness, eviction, graph diffs.

All of them are anti-joins and unions of immutable tables; ``swap`` writes a new version beside the old
one and only then points the ``CURRENT`` marker at it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .common import maybe_broadcast


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in the place of those with equal key; columns in ``keep`` stay as in ``old``.

    Nulls in a key are equal. Of several new rows with one key the greatest by all columns counts.
    """
    keys = [key] if isinstance(key, str) else key
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    every = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in new.columns)))
    fresh = new.withColumn("n_", every).where("n_ = 1").drop("n_")
    if keep:
        prior = old.select(*(F.col(k).alias(f"old_{k}") for k in keys), *(F.col(c).alias(f"old_{c}") for c in keep))
        on = [fresh[k].eqNullSafe(prior[f"old_{k}"]) for k in keys]
        fresh = fresh.join(prior, on, "left").select(*(F.coalesce(f"old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns))
    return old.join(fresh, same(old, fresh), "left_anti").unionByName(fresh)


def delete_paths(chunks: DataFrame, paths: DataFrame, by_repo: bool = False) -> DataFrame:
    return chunks.join(maybe_broadcast(paths), ["repo", "rel_path"] if by_repo else "rel_path", "left_anti")


def rename_paths(chunks: DataFrame, renames: DataFrame, repo: str | None = None) -> DataFrame:
    """Moves chunks (old_path -> new_path): path and id change, content and vectors stay. ``repo`` is the key that ids are made with."""
    moved = chunks.join(maybe_broadcast(renames), chunks["rel_path"] == renames["old_path"], "left")
    path = F.coalesce("new_path", "rel_path")
    fresh = F.when(F.col("new_path").isNotNull() & (F.col("new_path") != F.col("rel_path")), text.chunk_id(path, F.col("start_line"), F.col("end_line"), F.col("content_hash"), F.lit(repo) if repo else None)).otherwise(F.col("chunk_id"))
    return moved.withColumns({"chunk_id": fresh, "rel_path": path}).drop("old_path", "new_path")


def apply_deltas(chunks: DataFrame, deltas: DataFrame, incoming: DataFrame) -> DataFrame:
    """Renames, then deletes, then new and changed files. ``deltas``: action, rel_path, old_path."""
    renamed = rename_paths(chunks, deltas.where("action = 'rename'").select("old_path", F.col("rel_path").alias("new_path")))
    gone = deltas.where("action in ('delete', 'modify', 'add')").select("rel_path").distinct()
    fresh = incoming.join(maybe_broadcast(deltas.where("action in ('modify', 'add')").select("rel_path").distinct()), "rel_path", "left_semi")
    return delete_paths(renamed, gone).unionByName(fresh.select(renamed.columns))


def stale_chunks(current: DataFrame, stored: DataFrame, model: str, enricher: str | None = None) -> DataFrame:
    """Rows of ``current`` (chunk_id, content_hash) that the store does not hold with this hash, model and enricher."""
    same_enricher = F.coalesce("enricher_id", F.lit("noop")) == (enricher or "noop")
    fresh = stored.where((F.col("embedding_model") == model) & same_enricher).select("chunk_id", "content_hash")
    return current.join(fresh, ["chunk_id", "content_hash"], "left_anti")


def file_states(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``state``: new, changed, unchanged; and the stored rows that are gone as removed. Null attributes are not compared."""
    cols = ("mtime", "size_bytes", "enricher_id", "embedder_model")
    prior = stored.select("rel_path", F.lit(True).alias("known"), *(F.col(c).alias(f"old_{c}") for c in cols))
    both = current.withColumn("here", F.lit(True)).join(prior, "rel_path", "full_outer")
    differs = F.lit(False)
    for c in cols:
        differs |= F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    state = F.when(F.col("here").isNull(), "removed").when(F.col("known").isNull(), "new").when(differs, "changed").otherwise("unchanged")
    return both.select("rel_path", state.alias("state"))


def evict_unseen(chunks: DataFrame, seen: DataFrame) -> DataFrame:
    return chunks.join(seen.select("rel_path").distinct(), "rel_path", "left_semi")


def register_repos(repos: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert by normalized_key; first_indexed_at stays, null fields keep what is known."""
    prior = repos.select("normalized_key", *(F.col(c).alias(f"old_{c}") for c in repos.columns if c != "normalized_key"))
    both = prior.join(seen, "normalized_key", "full_outer")
    pick = lambda c: F.coalesce(f"old_{c}", c) if c == "first_indexed_at" else F.coalesce(c, f"old_{c}")
    return both.select("normalized_key", *(pick(c).alias(c) for c in repos.columns if c != "normalized_key"))


def backfill_repo(chunks: DataFrame, repo: str, paths: DataFrame) -> DataFrame:
    """Gives chunks without a repo to ``repo`` if one of the first five orphaned paths is among ``paths``."""
    sample = chunks.where("repo is null").select("rel_path").distinct().orderBy("rel_path").limit(5)
    mine = sample.join(paths, "rel_path", "left_semi").limit(1).count() > 0
    return chunks.withColumn("repo", F.coalesce("repo", F.lit(repo))) if mine else chunks


def cached_enrichment(chunks: DataFrame, cache: DataFrame, enricher: str) -> DataFrame:
    """Adds embedding_text from the cache (null: to be made); the key holds the context's hash, too."""
    own = cache.where(F.col("enricher_id") == enricher).select("content_hash", "context_hash", "embedding_text")
    return chunks.join(own, ["content_hash", "context_hash"], "left")


EDGE_KEY = ["source", "target", "relation", "source_file", "source_location"]


def graph_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key…, change): added, deleted, changed; nulls in a key count as empty."""
    filled = lambda df: df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in key), F.xxhash64(*(c for c in df.columns if c not in key)).alias("rest")) if set(df.columns) - set(key) else df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in key), F.lit(0).cast("long").alias("rest"))
    a, b = filled(old).withColumnRenamed("rest", "was"), filled(new).withColumnRenamed("rest", "now")
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select(*key, change.alias("change")).where(F.col("change").isNotNull())


def load_graph(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """New nodes; vectors already made for an unchanged label are kept."""
    kept = old_nodes.select("node_id", F.col("label").alias("old_label"), F.col("embedding").alias("old_embedding"))
    joined = new_nodes.join(kept, "node_id", "left")
    return joined.withColumn("embedding", F.when(F.col("old_label").eqNullSafe(F.col("label")), F.col("old_embedding"))).drop("old_label", "old_embedding")


def nodes_to_embed(nodes: DataFrame, model: str) -> DataFrame:
    """Nodes without a vector of this model, with the text to embed."""
    due = nodes.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))
    return due.select("node_id", F.concat_ws(": ", "community_label", "label").alias("text"))


def glossary_chunks(terms: DataFrame) -> DataFrame:
    """Terms (term, definition, aliases, category) as chunks of kind glossary."""
    ident = F.concat(F.lit("glossary:"), F.substring(text.sha256(F.concat("term", F.lit(":"), "definition")), 1, 16))
    content = F.concat_ws("\n", F.col("term"), F.when(F.size("aliases") > 0, F.concat(F.lit("Aliases: "), F.array_join("aliases", ", "))), F.col("definition"))
    return terms.where("term is not null and definition is not null").select(ident.alias("chunk_id"), F.lit("<glossary>").alias("rel_path"), F.lit("glossary").alias("kind"), F.col("term").alias("symbol"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), content.alias("content"))


def swap(df: DataFrame, root: str) -> str:
    """Writes ``df`` as a new version under ``root`` and makes it current; readers of the old one are not disturbed."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/CURRENT")
    return version


def current(spark: SparkSession, root: str, schema=None) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{version}")


def repo_stats(chunks: DataFrame, repos: DataFrame) -> DataFrame:
    """A row per repo: files and chunks (0 without any)."""
    per = chunks.groupBy("repo").agg(F.countDistinct("rel_path").alias("files"), F.count("*").alias("chunks"))
    return repos.join(per, "repo", "left").select(*repos.columns, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """(metric, value): totals, orphans, chunks by model and by enricher."""
    row = lambda metric, on: F.struct(metric.alias("metric"), on.alias("on"))
    always = F.lit(True)
    rows = F.array(
        row(F.lit("chunks"), always),
        row(F.lit("orphans"), F.col("repo").isNull()),
        row(F.concat(F.lit("model:"), "embedding_model", F.lit("/"), F.col("embedding_dim").cast("string")), always),
        row(F.concat(F.lit("enricher:"), F.coalesce("enricher_id", F.lit("(none)"))), always),
    )
    return chunks.select(F.explode(rows).alias("x")).groupBy("x.metric").agg(F.count_if("x.on").alias("value"))


