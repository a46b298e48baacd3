"""What a caller asks for by name: one function for each tool, with the bounds of its arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, ingest, search
from .operators.common import ranked
from .operators.engine import SearchEngine


def _within(x: int, low: int, high: int) -> int:
    return max(low, min(int(x), high))


class Tools:
    """Single questions over an engine; each answer is a DataFrame."""

    def __init__(self, engine: SearchEngine, config: dict | None = None):
        self.engine, self.spark, self.config = engine, engine.chunks.sparkSession, config or {}

    def _one(self, value: str, name: str) -> DataFrame:
        return self.spark.createDataFrame([(1, value)], f"query_id long, {name} string")

    def _start(self, symbol: str) -> DataFrame:
        return graph.resolve(self.engine.nodes, self._one(symbol, "name")).select("query_id", "node_id")

    def search_code(self, query: str, top_k: int = 10, language: list[str] | None = None, path_prefix: str | None = None, kind: list[str] | None = None, exclude_tests: bool = False, recursive: bool = True) -> DataFrame:
        where = search.search_filter(language, path_prefix, kind, exclude_tests)
        return self.engine.search(self._one(query, "query"), _within(top_k, 1, 30), where, merge=recursive, promote=recursive).drop("query_id")

    def facets(self, hits: DataFrame | None = None) -> DataFrame:
        return search.facets(self.engine.chunks, hits)

    def smart_search(self, query: str, top_k: int = 10) -> DataFrame:
        return self.engine.smart(self._one(query, "query"), _within(top_k, 1, 30)).drop("query_id")

    def get_symbol(self, symbol: str, limit: int = 5) -> DataFrame:
        return search.symbol_lookup(self.engine.chunks, self._one(symbol, "name"), _within(limit, 1, 20)).drop("query_id")

    def list_repos(self) -> DataFrame:
        return ingest.repo_stats(self.engine.chunks, self.engine.chunks.select("repo").where("repo is not null").distinct()).orderBy(F.desc("chunks"), "repo")

    def get_file_outline(self, path: str) -> DataFrame:
        own = self.engine.chunks.where(F.col("rel_path") == path)
        return ranked(own.select("rel_path", "chunk_id", "kind", "symbol", "start_line", "end_line"), "rel_path", "start_line", "end_line", "chunk_id")

    def find_callers(self, symbol: str, depth: int = 1, limit: int = 20, confidence: tuple[str, ...] = ("EXTRACTED",)) -> DataFrame:
        return graph.callers(self.engine.edges, self._start(symbol), depth, limit, confidence).drop("query_id")

    def find_related(self, symbol: str, depth: int = 1, limit: int = 20, relations: list[str] | None = None) -> DataFrame:
        return graph.related(self.engine.edges, self._start(symbol), depth, limit, relations).drop("query_id")

    def get_community(self, symbol: str | None = None, community_id: int | None = None, limit: int = 50) -> DataFrame:
        """Members of the community with this id, or else of the one that the symbol belongs to."""
        if community_id is None:
            asked = graph.community_of(self.engine.nodes, self._one(symbol or "", "name"))
        else:
            asked = self.spark.createDataFrame([(1, int(community_id))], "query_id long, community_id int")
        return graph.community(self.engine.nodes, asked, limit).drop("query_id")

    def find_rationale(self, symbol: str, limit: int = 10) -> DataFrame:
        return graph.rationale(self.engine.edges, self.engine.nodes, self._start(symbol), limit).drop("query_id")

    def find_tests_for(self, symbol: str, limit: int = 20) -> DataFrame:
        return graph.tests_for(self.engine.edges, self.engine.nodes, self._start(symbol), _within(limit, 1, 100)).drop("query_id")

    def trace_feature(self, feature: str, max_paths: int = 5, max_depth: int = 6) -> DataFrame:
        return graph.trace(self.engine.edges, self.engine.nodes, self._one(feature, "feature"), max_paths, max_depth).drop("query_id")

    def get_config(self) -> dict:
        return dict(self.config)

    def stats(self) -> DataFrame:
        return ingest.index_stats(self.engine.chunks)
