"""The adapters that come with the engine, registered by stage and name."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import chunks, enrich, search
from .plans.registry import register
from .sources import files, walkers

register("walker", "filesystem")(lambda: files.walk)
register("walker", "git")(lambda: walkers.walk_git)
register("walker", "nested-git", depth=4)(lambda depth: lambda spark, root, ignore=None: walkers.walk_nested(spark, root, depth, ignore=ignore))
register("chunker", "by-language")(lambda: chunks.dispatch)
register("language-chunker", "markdown")(lambda: chunks.headings)
register("language-chunker", "gherkin")(lambda: chunks.scenarios)
register("language-chunker", "vue", most_lines=150)(lambda most_lines: lambda f: chunks.components(f, most_lines))
register("language-chunker", "python")(lambda: chunks.python_chunks)
register("language-chunker", "fallback")(lambda: chunks.whole_files)
register("enricher", "noop")(lambda: enrich.plain)
register("enricher", "hierarchical")(lambda: enrich.hierarchical)
register("enricher", "contextual", most=500)(lambda most: lambda c: enrich.summarised(c, most=most))
register("embedder", "hash", dim=64)(lambda dim: lambda c: text.hash_embedding(c, dim))
register("retrieval-stream", "dense", k=50)(lambda k: lambda vectors, queries: search.dense(vectors, queries, k))
register("retrieval-stream", "sparse", k=50)(lambda k: lambda docs, queries: search.bm25(docs, queries, k))
register("retrieval-stream", "symbol", k=20)(lambda k: lambda symbols, queries: search.symbol_match(symbols, queries, k))
register("retrieval", "hybrid", k=10)(lambda k: lambda c, queries: search.hybrid(c, queries, k))
register("reranker", "noop")(lambda: lambda hits, k: hits.where(F.col("rank") <= k))
register("reranker", "overlap")(lambda: lambda hits, k: search.rerank(hits, search.overlap_score, k))
