"""Search as one engine: streams, query understanding, fusion, merging, and routing to the code graph.

Every step takes a batch of queries. An engine holds DataFrames and plain functions only, so a search
is one plan; what runs while a plan is built (intents present, gates) reads single rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..plans import intent
from . import graph, index, search
from .common import maybe_broadcast, ranked, written


def graph_vectors(nodes: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 20, least: float = 0.30) -> DataFrame:
    """(query_id, rank, chunk_id, score, node_id): graph nodes by cosine of at least ``least``, each as the tightest
    chunk around it, else its file's first; nodes without a chunk are dropped and the rest move up.

    ``nodes`` has an embedding, ``queries`` query_id and query_vec. Of nodes in one chunk the best stays.
    """
    near = search.dense(nodes.select(F.col("node_id").alias("vec_id"), "embedding"), queries, k, "cosine", least)
    own = nodes.join(maybe_broadcast(near.select(F.col("vec_id").alias("node_id")).distinct()), "node_id", "left_semi")
    met = near.withColumnRenamed("vec_id", "node_id").join(graph.hydrate(own, chunks).select("node_id", "chunk_id"), "node_id")
    best = met.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "score", "node_id")).alias("x"))
    flat = best.select("query_id", "chunk_id", F.col("x.rank").alias("was"), "x.score", "x.node_id")
    return ranked(flat, "query_id", "was", "chunk_id").select("query_id", "rank", "chunk_id", "score", "node_id")


@dataclass
class SearchEngine:
    """Streams over ``chunks`` (chunk_id, content, symbol, rel_path, language, kind, start_line, end_line, repo,
    parent_chunk_id and, if made, embedding). Models are functions of columns; None leaves a step out."""

    chunks: DataFrame
    index_root: str | None = None  #: folder of a stored index (ids are chunk ids); None: made for the search
    repos: DataFrame | None = None  #: normalized_key and what else is known of a repo
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    embed: Callable[[Column], Column] = text.hash_embedding
    hypothesis: Callable[[Column, Column], Column] | None = None
    expand: Callable[[Column], Column] | None = None
    paraphrases: Callable[[Column], Column] | None = None
    scorer: Callable[[Column, Column], Column] | None = None
    lanes: tuple[str, ...] = ("dense", "sparse", "symbol")
    widths: dict[str, int] = field(default_factory=lambda: {"dense": 50, "sparse": 50, "symbol": 20, "graph": 20})

    def vectors(self) -> DataFrame:
        made = F.col("embedding") if "embedding" in self.chunks.columns else self.embed(F.col("content"))
        return self.chunks.select("chunk_id", made.alias("embedding"))

    def stream(self, lane: str, asked: DataFrame, where: Column | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score) of one lane; a filter holds before ranking."""
        own = self.chunks if where is None else self.chunks.where(where)
        k = self.widths[lane]
        if lane == "sparse":
            if self.index_root is None:
                out = search.bm25(own, asked, k, "chunk_id", "content")
            else:
                allowed = None if where is None else own.select(F.col("chunk_id").alias("doc_id"))
                out = index.search(self.chunks.sparkSession, self.index_root, asked, k, phrases=True, allowed=allowed)
            return out.withColumnRenamed("doc_id", "chunk_id")
        if lane == "symbol":
            return search.symbol_match(own, asked, k).select("query_id", "rank", "chunk_id", "score")
        dense = intent.hypothetical(asked, self.hypothesis).select("query_id", self.embed(F.col("dense_query")).alias("query_vec"))
        if lane == "graph":
            return graph_vectors(self.nodes, own, dense, k).drop("node_id")
        vectors = self.vectors() if where is None else self.vectors().join(own.select("chunk_id"), "chunk_id", "left_semi")
        return search.dense(vectors.withColumnRenamed("chunk_id", "vec_id"), dense, k).withColumnRenamed("vec_id", "chunk_id")

    def lists(self, asked: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        some = intent.rewrite(asked.where(F.trim("query") != ""), self.expand)
        return search.rrf([self.stream(x, some, where) for x in self.lanes], k, own_scores=True)

    def variants(self, queries: DataFrame, decompose: bool) -> DataFrame:
        """(query_id, variant, query): the parts of compound queries, or the query and its paraphrases."""
        parts = intent.decompose(queries) if decompose else queries.select("query_id", F.lit(0).alias("variant"), "query")
        if self.paraphrases is None:
            return parts
        more = parts.withColumn("query", F.explode(F.concat(F.array("query"), F.coalesce(self.paraphrases(F.col("query")), F.array().cast("array<string>")))))
        return more.withColumn("variant", (F.row_number().over(W.partitionBy("query_id").orderBy("variant", "query")) - 1).cast("int"))

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, decompose: bool = True, merge: bool = True, promote: bool = False) -> DataFrame:
        """(query_id, rank, score, rel_path, start_line, end_line, snippet, ...) for ``queries`` (query_id, query).

        Steps: parts or paraphrases, three lanes each, fusion, second fusion over the parts, reranking of
        snippets, parents, adjacent hits as one, first k. Blank queries give nothing.
        """
        wide = max(2 * k, 50)
        parts = self.variants(queries, decompose)
        keyed = parts.select(F.struct("query_id", "variant").alias("query_id"), "query")
        hits = self.lists(keyed, wide, where)
        split = hits.select("query_id.query_id", "query_id.variant", "chunk_id", "rank", "score")
        n = parts.groupBy("query_id").agg(F.count("*").alias("n_parts"))
        place = F.struct("variant", F.col("rank").alias("place"), F.col("score").alias("own"))
        fused = split.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.col("rank") + search.RRF_K)), 9).alias("sum"), F.min(place).alias("first")).join(n, "query_id")
        score = F.when(F.col("n_parts") == 1, F.col("first.own")).otherwise(F.col("sum"))  # one part: as the lanes' fusion ranked it
        top = ranked(fused.withColumn("score", score), "query_id", F.desc("score"), "first.variant", "first.place", "chunk_id", k=wide)
        shown = self.hydrated(top.select("query_id", "rank", "chunk_id", "score"))
        if self.scorer is not None:
            shown = search.rerank(shown.join(queries.select("query_id", "query"), "query_id"), self.scorer, wide).drop("query", "old_rank", "rerank_score")
        if promote:
            moved = search.promote_parents(shown.select("query_id", "rank", "chunk_id", "score"), self.chunks)
            shown = self.hydrated(moved.select("query_id", "rank", "chunk_id", "score"))
        if merge:
            shown = search.merge_adjacent(shown)
        return shown.where(F.col("rank") <= k)

    def hydrated(self, hits: DataFrame) -> DataFrame:
        """Hits with their chunk's place, kind, symbol and snippet, and their repo (chunks without one keep null)."""
        cols = [c for c in ("rel_path", "language", "kind", "symbol", "start_line", "end_line", "repo") if c in self.chunks.columns]
        out = hits.join(self.chunks.select("chunk_id", *cols, text.snippet(F.col("content")).alias("snippet")), "chunk_id")
        return with_repos(out, self.repos) if self.repos is not None else out

    def smart(self, queries: DataFrame, k: int = 10, routed: bool = True) -> DataFrame:
        """(query_id, intent, confidence, rank, chunk_id, node_id, score): each query goes to the operator of its intent.

        Callers, tests, relations and traces come from the graph, nearest first, at 1 - 0.05 a place;
        symbols from the lookup at 1. Without a graph such a query is searched, at half its
        confidence; so is one whose subject the graph or the symbols do not hold.
        """
        asked = intent.route(queries) if routed else queries.select("*", F.lit("search_code").alias("intent"), F.lit(None).cast("string").alias("subject"), F.lit(1.0).alias("confidence"))
        asked = written(asked, "routed")
        there = {r.intent for r in asked.select("intent").distinct().collect()}  # a handful of names
        has_graph = self.nodes is not None and self.edges is not None and graph.loaded(self.nodes, self.edges)["graph"]
        of = lambda x: asked.where(F.col("intent") == x).select("query_id", F.col("subject").alias("name"))
        found = [self.symbol_hits(of("get_symbol"), k)] if "get_symbol" in there else []
        if has_graph and (mine := sorted(there & {"find_callers", "find_tests_for", "find_related"})):
            named = asked.where(F.col("intent").isin(mine))
            starts = graph.resolve(self.nodes, named.select("query_id", F.col("subject").alias("name"))).select("query_id", "node_id")
            starts = written(starts.join(named.select("query_id", "intent"), "query_id"), "starts")
            found += [self.graph_hits(name, starts.where(F.col("intent") == name).select("query_id", "node_id"), k) for name in mine]
        if has_graph and "trace_feature" in there:
            found.append(self.traced(of("trace_feature"), k))
        rest = asked
        if found:
            known = found[0]
            for f in found[1:]:
                known = known.unionByName(f)
            known = written(known, "graph-hits")
            rest = asked.join(known.select("query_id").distinct(), "query_id", "left_anti")
        lists = self.lists(rest.select("query_id", "query"), k).withColumn("node_id", F.lit(None).cast("string"))
        half = asked.select("query_id", F.lit("search_code").alias("intent"), F.when(F.col("intent") == "search_code", F.col("confidence")).otherwise(F.col("confidence") * 0.5).alias("confidence"))
        cols = ["query_id", "intent", "confidence", "rank", "chunk_id", "node_id", "score"]
        out = lists.join(half, "query_id").select(cols)
        return out.unionByName(known.join(asked.select("query_id", "intent", "confidence"), "query_id").select(cols)) if found else out

    def symbol_hits(self, asked: DataFrame, k: int) -> DataFrame:
        hits = search.symbol_lookup(self.chunks, asked, k)
        return hits.select("query_id", "rank", "chunk_id", F.lit(None).cast("string").alias("node_id"), F.lit(1.0).alias("score"))

    def traced(self, asked: DataFrame, k: int) -> DataFrame:
        steps = graph.trace(self.edges, self.nodes, asked.select("query_id", F.col("name").alias("feature")), max_paths=k)
        first = steps.groupBy("query_id", "node_id").agg(F.min(F.struct("entry_rank", "step")).alias("x"))
        return self.placed(ranked(first, "query_id", "x.entry_rank", "x.step", "node_id", k=k))

    def graph_hits(self, name: str, starts: DataFrame, k: int) -> DataFrame:
        if name == "find_tests_for":
            return self.placed(graph.tests_for(self.edges, self.nodes, starts, k))
        return self.placed((graph.callers if name == "find_callers" else graph.related)(self.edges, starts, 1, k))

    def placed(self, own: DataFrame) -> DataFrame:
        """Nodes (query_id, rank, node_id) as hits with the chunk around them, if there is one."""
        chunks = graph.hydrate(self.nodes.join(own.select("node_id").distinct(), "node_id", "left_semi"), self.chunks).select("node_id", "chunk_id")
        score = F.round(F.greatest(1 - 0.05 * (F.col("rank") - 1), F.lit(0.0)), 6)
        return own.select("query_id", "rank", "node_id").join(chunks, "node_id", "left").select("query_id", "rank", "chunk_id", "node_id", score.alias("score"))


def with_repos(hits: DataFrame, repos: DataFrame) -> DataFrame:
    """Left outer join with the repos dimension (normalized_key, ...) as one struct ``repo_info``; null without a repo."""
    own = repos.select(F.col("normalized_key").alias("key_"), F.struct(*(F.col(c) for c in repos.columns)).alias("repo_info"))
    return hits.join(maybe_broadcast(own), F.col("repo") == F.col("key_"), "left").drop("key_")
