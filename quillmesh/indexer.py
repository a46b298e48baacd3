"""Indexing of repositories into versioned tables, whole or by what has changed.

A run skips files whose state is unchanged, then chunks whose hash, model and enricher are the
stored ones, then enrichments that the cache holds; only the rest is embedded. Each table is
written beside its old version and then made current, so a run that fails leaves the old one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import chunks as chunking
from .operators import enrich, ingest, store
from .operators.common import shared_dir, written

SCHEMAS = {
    "chunks": "repo string, rel_path string, language string, kind string, symbol string, parent_chunk_id string, start_line int, end_line int, content string, content_hash string, chunk_id string, "
    "context_hash string, embedding_text string, enricher_id string, embedding_model string, embedding_dim int, embedding array<float>",
    "files": "repo string, rel_path string, size_bytes long, mtime double, enricher_id string, embedder_model string, chunks long",
    "enrichments": "content_hash string, context_hash string, enricher_id string, embedding_text string, cached_at timestamp",
    "meta": "key string, value string",
    "runs": "repo string, mode string, files_visited long, files_skipped_fresh long, files_evicted long, chunks_seen long, chunks_embedded long, chunks_skipped_fresh long, chunks_enriched_from_cache long",
}


class Indexer:
    def __init__(self, spark: SparkSession, root: str | None = None, enricher: tuple[str, Callable[[DataFrame], DataFrame]] = ("noop", enrich.plain),
                 embedder: tuple[str, int, Callable[[Column], Column]] = ("hash", 64, text.hash_embedding)):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/index"
        self.enricher_id, self.enrich = enricher
        self.model, self.dim, self.embed = embedder

    def table(self, name: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/CURRENT")
        there = marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        return ingest.current(self.spark, f"{self.root}/{name}", empty.schema) if there else empty

    def _swap(self, name: str, df: DataFrame) -> None:
        ingest.swap(df.select(self.table(name).columns), f"{self.root}/{name}")

    def clear(self) -> None:
        for name, df in store.clear({n: self.table(n) for n in SCHEMAS}).items():
            self._swap(name, df)

    def last_head(self, repo: str) -> str | None:
        return store.get_meta(self.table("meta"), f"last_head:{repo}")

    def run(self, files: DataFrame, repo: str, mode: str = "auto", deltas: DataFrame | None = None, head: str | None = None) -> dict[str, int | str]:
        """Indexes ``files`` (rel_path, language, content, size_bytes, mtime) of ``repo``; the run's counters.

        ``deltas`` (action, rel_path, old_path) say what changed since the last head. ``incremental`` and
        ``auto`` use them if the repository was indexed before; otherwise, and for ``full``, all files are looked at.
        """
        by_delta = mode != "full" and deltas is not None and self.last_head(repo) is not None
        stored = self.table("chunks")
        own, others = stored.where(F.col("repo") == repo), stored.where(~F.col("repo").eqNullSafe(F.lit(repo)))
        known = self.table("files").where(F.col("repo") == repo)
        if by_delta:
            renames = deltas.where("action = 'rename'").select("old_path", F.col("rel_path").alias("new_path"))
            own = ingest.rename_paths(own, renames, repo)
            known = known.join(renames, known["rel_path"] == renames["old_path"], "left").withColumn("rel_path", F.coalesce("new_path", "rel_path")).drop("old_path", "new_path")
            touched = deltas.where("action in ('add', 'modify')").select("rel_path").distinct()
            gone = deltas.where("action = 'delete'").select("rel_path").distinct()
            files = files.join(touched, "rel_path", "left_semi")
        now = files.select("rel_path", F.col("mtime").cast("double").alias("mtime"), F.col("size_bytes").cast("long").alias("size_bytes"), F.lit(self.enricher_id).alias("enricher_id"), F.lit(self.model).alias("embedder_model"))
        states = written(ingest.file_states(now, known), "file-states")
        if by_delta:
            states = states.where("state <> 'removed'").unionByName(gone.withColumn("state", F.lit("removed")))
        due = states.where("state in ('new', 'changed')").select("rel_path")
        evicted = states.where("state = 'removed'").select("rel_path")
        made = chunking.dispatch(files.join(due, "rel_path", "left_semi").select("rel_path", "language", "content"), F.lit(repo))
        made = made.join(files.select("rel_path", "language"), "rel_path").withColumn("repo", F.lit(repo))
        made = written(made.withColumn("context_hash", F.sha2(F.concat_ws("|", "repo", "rel_path", F.coalesce("parent_chunk_id", F.lit("")), F.coalesce("symbol", F.lit(""))), 256)), "chunks-made")
        stale = ingest.stale_chunks(made, own, self.model, self.enricher_id)
        cached = ingest.cached_enrichment(stale, self.table("enrichments"), self.enricher_id).withColumnRenamed("embedding_text", "cached_text")
        told = self.enrich(cached).withColumn("embedding_text", F.coalesce("cached_text", "embedding_text"))
        ready = told.withColumns({"enricher_id": F.lit(self.enricher_id), "embedding_model": F.lit(self.model), "embedding_dim": F.lit(self.dim), "embedding": self.embed(F.col("embedding_text"))})
        ready = written(ready.select(*stored.columns, F.col("cached_text").isNotNull().alias("from_cache")), "chunks-ready")
        untouched = own.join(due.unionByName(evicted), "rel_path", "left_anti")
        fresh = own.join(made.select("chunk_id"), "chunk_id", "left_semi").join(ready.select("chunk_id"), "chunk_id", "left_anti").join(due, "rel_path", "left_semi")
        after = others.unionByName(untouched).unionByName(fresh).unionByName(ready.select(stored.columns))
        counts = {s: n for s, n in states.groupBy("state").count().collect()}  # four states at most
        seen, embedded, reused = made.count(), ready.count(), ready.where("from_cache").count()
        self._swap("enrichments", store.put_enrichments(self.table("enrichments"), ready.withColumn("cached_at", F.current_timestamp())))
        per_file = made.groupBy("rel_path").agg(F.count("*").alias("chunks"))
        new_files = now.join(due, "rel_path", "left_semi").join(per_file, "rel_path", "left").select(F.lit(repo).alias("repo"), "rel_path", "size_bytes", "mtime", "enricher_id", "embedder_model", F.coalesce("chunks", F.lit(0)).alias("chunks"))
        kept = known.join(due.unionByName(evicted), "rel_path", "left_anti").select(new_files.columns)
        rest = self.table("files").where(~F.col("repo").eqNullSafe(F.lit(repo)))
        self._swap("files", rest.unionByName(kept).unionByName(new_files))
        self._swap("chunks", after)
        if head is not None:
            self._swap("meta", store.set_meta(self.table("meta"), self.spark.createDataFrame([(f"last_head:{repo}", head)], SCHEMAS["meta"])))
        done = {
            "repo": repo, "mode": "incremental" if by_delta else "full", "files_visited": sum(n for s, n in counts.items() if s != "removed"), "files_skipped_fresh": counts.get("unchanged", 0),
            "files_evicted": counts.get("removed", 0), "chunks_seen": seen, "chunks_embedded": embedded, "chunks_skipped_fresh": seen - embedded, "chunks_enriched_from_cache": reused,
        }
        self._swap("runs", self.table("runs").unionByName(self.spark.createDataFrame([tuple(done.values())], SCHEMAS["runs"])))
        return done

    def refresh_graph(self, nodes: DataFrame, edges: DataFrame, loaded_at: float, graph_mtime: float, old_nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
        """(nodes with vectors, indexed documents with graph lines) if the graph is newer than what was loaded; else None.

        Vectors of nodes whose label did not change are kept; the others are embedded.
        """
        if graph_mtime <= loaded_at:
            return None
        prior = old_nodes if old_nodes is not None else nodes.withColumn("embedding", F.lit(None).cast("array<float>")).limit(0)
        loaded = ingest.load_graph(prior, nodes).withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(self.model)))
        due = ingest.nodes_to_embed(loaded, self.model).select("node_id", self.embed(F.col("text")).alias("fresh"))
        full = loaded.join(due, "node_id", "left").withColumns({"embedding": F.coalesce("fresh", "embedding"), "embedding_model": F.lit(self.model)}).drop("fresh")
        return full, enrich.augmented_documents(self.table("chunks"), full)
