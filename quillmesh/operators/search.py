"""Ranked retrieval: inverted index, dense neighbours, identifiers, fusion, filters, facets, merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .common import containing, maybe_broadcast, pair_all, ranked

K1, B, RRF_K = 1.2, 0.75, 60


# -- inverted index, made for one search (``index`` keeps one) -----------------------------------
def bm25(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) for ``queries`` (query_id, query): Okapi BM25, repeats in a query count.

    The query terms filter the exploded terms before any shuffle, so only matching postings move.
    """
    asked = queries.select("query_id", F.explode(text.query_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    vocabulary = maybe_broadcast(asked.select("term").distinct(), 100_000)
    lengths = docs.select(F.col(doc_id).alias("doc_id"), text.terms(F.coalesce(content, F.lit(""))).alias("terms"))
    hits = lengths.select("doc_id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term")).join(vocabulary, "term")
    tf = hits.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    known = asked.join(df, "term").crossJoin(F.broadcast(totals))  # totals: one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = known.select("query_id", "term", (F.col("times") * idf).alias("weight"), "avgdl")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = tf.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scores, "query_id", F.desc("score"), "doc_id", k=k).select("query_id", "rank", "doc_id", "score")


# -- dense ---------------------------------------------------------------------------------
def _packs(rows: DataFrame, ident: str, vector: str, size: int) -> DataFrame:
    """(dim, ids, vs): up to ``size`` vectors of one dimension in a row; null vectors and those with nulls are left out."""
    src = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    shape = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(src.schema["id"].dataType)), T.StructField("vs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                dims = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
                for d in np.unique(dims):
                    own = batch.filter(pa.array(dims == d))
                    flat = own.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(d)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column("id")), pa.array([flat.tobytes()], pa.binary())],
                        names=["dim", "ids", "vs"])

    return src.mapInArrow(run, shape)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 50, score: str = "l2", least: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): exact neighbours; inputs (vec_id, embedding), (query_id, query_vec).

    ``score`` is ``l2`` (max(0, 1 - d**2 / 2)) or ``cosine`` (0 for zero vectors). Packs of vectors meet packs
    of queries of their dimension, and one matrix product gives all their scores; each pack of
    vectors passes on a query's k best and their ties, so what is ranked at the end is small.
    """
    v, q = _packs(vectors, "vec_id", "embedding", 4096), _packs(queries, "query_id", "query_vec", 1024)
    pairs = pair_all(v, q.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")), "vs", rows=16).where(F.col("dim") == F.col("q_dim"))
    id_type, q_type = v.schema["ids"].dataType.elementType, q.schema["ids"].dataType.elementType
    shape = T.StructType([T.StructField("query_id", q_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, vs, _, q_ids, q_vs = (c[i] for c in batch.columns)
                a, b = (np.frombuffer(x.as_py(), "<f8").reshape(-1, dim.as_py()) if dim.as_py() else np.zeros((len(y), 0)) for x, y in ((vs, ids), (q_vs, q_ids)))
                na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
                s = b @ a.T
                if score == "cosine":
                    n = np.sqrt(nb)[:, None] * np.sqrt(na)[None, :]
                    s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
                else:
                    s = np.maximum(0.0, 1 - (nb[:, None] + na[None, :] - 2 * s) / 2)
                s = np.round(s, 6) + 0.0
                ok = s >= least if least is not None else np.ones(s.shape, bool)
                if s.shape[1] > k:
                    ok &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                x, y = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([q_ids.values.take(pa.array(x)), ids.values.take(pa.array(y)), pa.array(s[x, y])], names=shape.names)

    scored = pairs.select("dim", "ids", "vs", "q_dim", "q_ids", "q_vs").mapInArrow(run, shape)
    return ranked(scored, "query_id", F.desc("score"), "vec_id", k=k).select("query_id", "rank", "vec_id", "score")


def check_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fails at run time on a vector of another dimension."""
    return vectors.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(column).cast("string")))))


# -- identifiers ---------------------------------------------------------------------------
def symbol_match(symbols: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, chunk_id, symbol, score): number of identifier tokens found in the symbol."""
    asked = queries.select("query_id", F.explode(text.identifier_tokens(F.col("query"))).alias("token"))
    found = containing(symbols.where(F.col("symbol").isNotNull()).select("chunk_id", "symbol"), asked, "symbol", "token")
    scored = found.groupBy("query_id", "chunk_id", "symbol").agg(F.count("*").alias("score"))
    return ranked(scored, "query_id", F.desc("score"), F.length("symbol"), "chunk_id", k=k).select("query_id", "chunk_id", "symbol", "score", "rank")


def symbol_lookup(symbols: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, chunk_id, symbol, tier): exact (0), last part (1), contained (2)."""
    pairs = containing(symbols.where(F.col("symbol").isNotNull()).select("chunk_id", "symbol"), asked.select("query_id", "name"), "symbol", "name")
    low, name = F.lower("symbol"), F.lower("name")
    tier = F.when(F.col("symbol") == F.col("name"), 0).when(F.endswith(low, F.concat(F.lit("."), name)), 1).otherwise(2)
    return ranked(pairs.withColumn("tier", tier), "query_id", "tier", F.length("symbol"), "chunk_id", k=k).select("query_id", "rank", "chunk_id", "symbol", "tier")


# -- fusion --------------------------------------------------------------------------------
def rrf(streams: list[DataFrame], k: int = 50, constant: int = RRF_K, own_scores: bool = False) -> DataFrame:
    """Reciprocal rank fusion of (query_id, rank, chunk_id) lists; ties by first occurrence, then id.

    With ``own_scores`` (lists that have a score), a query that one list alone answers keeps that list's scores.
    """
    score = F.col("score").cast("double") if own_scores else F.lit(None).cast("double")
    every = reduce(DataFrame.unionByName, (s.select("query_id", "chunk_id", "rank", score.alias("own")).withColumn("stream", F.lit(i)) for i, s in enumerate(streams)))
    place = F.struct("stream", F.col("rank").alias("place"), "own")
    fused = every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.col("rank") + constant)), 9).alias("score"), F.min(place).alias("first"))
    if own_scores:
        alone = every.groupBy("query_id").agg((F.min("stream") == F.max("stream")).alias("alone"))
        fused = fused.join(alone, "query_id").withColumn("score", F.when(F.col("alone"), F.col("first.own")).otherwise(F.col("score")))
    return ranked(fused, "query_id", F.desc("score"), "first.stream", "first.place", "chunk_id", k=k).select("query_id", "rank", "chunk_id", "score")


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, dense_k: int = 50, sparse_k: int = 50, symbol_k: int = 20, embed=text.hash_embedding) -> DataFrame:
    """Dense, sparse and identifier streams over chunks (chunk_id, content, symbol), fused. Blank queries give nothing."""
    asked = queries.where(F.trim("query") != "")
    vectors = chunks.select(F.col("chunk_id").alias("vec_id"), (F.col("embedding") if "embedding" in chunks.columns else embed(F.col("content"))).alias("embedding"))
    streams = [
        dense(vectors, asked.select("query_id", embed(F.col("query")).alias("query_vec")), dense_k).withColumnRenamed("vec_id", "chunk_id"),
        bm25(chunks, asked, sparse_k, "chunk_id", "content").withColumnRenamed("doc_id", "chunk_id"),
        symbol_match(chunks, asked, symbol_k),
    ]
    return rrf(streams, k, own_scores=True)


def fused_variants(search, variants: DataFrame, k: int = 10, wide: int = 50) -> DataFrame:
    """Second-level fusion: ``variants`` (query_id, variant, query) are searched and fused per query_id."""
    asked = variants.select(F.concat_ws("#", "query_id", "variant").alias("query_id"), "query")
    hits = search(asked, max(2 * k, wide))
    parts = F.split("query_id", "#")
    split = hits.select(parts[0].cast("long").alias("query_id"), parts[1].cast("int").alias("variant"), "chunk_id", "rank")
    fused = split.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.col("rank") + RRF_K)), 9).alias("score"), F.min(F.struct("variant", F.col("rank").alias("place"))).alias("first"))
    return ranked(fused, "query_id", F.desc("score"), "first.variant", "first.place", "chunk_id", k=k).select("query_id", "rank", "chunk_id", "score")


def rerank(hits: DataFrame, scorer, k: int) -> DataFrame:
    """Orders hits (query_id, rank, query, snippet, …) anew by ``scorer(query, snippet)``; ties keep their order."""
    scored = hits.withColumn("rerank_score", scorer(F.col("query"), F.col("snippet"))).withColumnRenamed("rank", "old_rank")
    return ranked(scored, "query_id", F.desc("rerank_score"), "old_rank", k=k)


def overlap_score(query: Column, snippet: Column) -> Column:
    """Default reranker: share of the query's distinct terms that the snippet holds."""
    asked = F.array_distinct(text.query_terms(query))
    return F.round(F.size(F.array_intersect(asked, text.terms(snippet))) / F.greatest(F.size(asked), F.lit(1)), 6)


# -- filters and facets --------------------------------------------------------------------
def search_filter(language: list[str] | None = None, path_prefix: str | None = None, kind: list[str] | None = None, exclude_tests: bool = False) -> Column:
    """A predicate for chunks; applied before ranking, so that it never costs recall."""
    out = F.lit(True)
    if language:
        out &= F.lower("language").isin([x.lower() for x in language])
    if path_prefix:
        out &= F.startswith(F.col("rel_path"), F.lit(path_prefix))
    if kind:
        out &= F.lower("kind").isin([x.lower() for x in kind])
    if exclude_tests:
        out &= ~text.is_test_path(F.col("rel_path"))
    return out


def facets(chunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(facet, value, n) by language, kind and repo, for all chunks or for those of ``hits``."""
    own = chunks if hits is None else chunks.join(maybe_broadcast(hits.select("chunk_id")), "chunk_id", "left_semi")
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), v.alias("value")) for f, v in (("language", F.col("language")), ("kind", F.col("kind")), ("repo", F.coalesce("repo", F.lit("(local)"))))))
    return own.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


# -- merging -------------------------------------------------------------------------------
def promote_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, rank, chunk_id, score): two or more with one parent become the parent, at the best place."""
    parents = hits.join(chunks.select("chunk_id", "parent_chunk_id"), "chunk_id")
    same = W.partitionBy("query_id", "parent_chunk_id")
    marked = parents.withColumn("n", F.when(F.col("parent_chunk_id").isNotNull(), F.count("*").over(same)).otherwise(1))
    target = F.when(F.col("n") >= 2, F.col("parent_chunk_id")).otherwise(F.col("chunk_id"))
    moved = marked.select("query_id", target.alias("target"), "rank", "score", (F.col("n") >= 2).alias("promoted"))
    best = moved.groupBy("query_id", "target").agg(F.min(F.struct("rank", "score", "promoted")).alias("x")).select("query_id", F.col("target").alias("chunk_id"), F.col("x.rank").alias("old_rank"), "x.score", "x.promoted")
    return ranked(best, "query_id", "old_rank", "chunk_id").select("query_id", "rank", "chunk_id", "score", "promoted")


def merge_adjacent(hits: DataFrame, gap: int = 5, most: int = 1200) -> DataFrame:
    """Hits of one file whose line ranges overlap or lie up to ``gap`` lines apart become one (islands)."""
    by_place = W.partitionBy("query_id", "rel_path").orderBy("start_line", "end_line", "rank")
    reach = F.max("end_line").over(by_place.rowsBetween(W.unboundedPreceding, -1))
    marked = hits.withColumn("fresh", F.when(reach.isNull() | (F.col("start_line") - reach > gap), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("fresh").over(by_place))
    pieces = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "rank", "snippet")))
    merged = islands.groupBy("query_id", "rel_path", "island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), F.min("rank").alias("old_rank"), F.count("*").alias("parts"),
        F.substring(F.array_join(F.transform(pieces, lambda p: p["snippet"]), "\n…\n"), 1, most).alias("snippet"))
    return ranked(merged, "query_id", "old_rank", "rel_path").select("query_id", "rank", "rel_path", "start_line", "end_line", "score", "parts", "snippet")
