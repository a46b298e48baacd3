"""Code graph: resolution, hydration, bounded breadth-first search, communities, tests, traces.

Nodes: node_id, label, source_file, line, community_id. Edges: source, target, relation,
confidence, confidence_score. Frontiers are joined level by level and each level is written to
the shared folder; results are totally ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rules import NODE_TEST_PATHS
from .common import containing, maybe_broadcast, ranked, written

CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")


def loaded(nodes: DataFrame, edges: DataFrame) -> dict[str, bool]:
    """Gates: whether there is a graph at all, and whether it says why anything is so."""
    there = lambda df: not df.limit(1).isEmpty()
    return {"graph": there(nodes), "rationale": there(edges.where("relation = 'rationale_for'"))}


def community_of(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, community_id) of the nodes that the names in ``asked`` (query_id, name) resolve to."""
    own = resolve(nodes, asked).select("query_id", "node_id")
    return own.join(nodes.select("node_id", "community_id"), "node_id").where("community_id is not null").select("query_id", "community_id")


def trusted(edges: DataFrame, confidence: tuple[str, ...] = ("EXTRACTED",)) -> DataFrame:
    """Edges of the given confidences; unknown ones fall back to EXTRACTED."""
    wanted = [c for c in confidence if c in CONFIDENCES] or ["EXTRACTED"]
    return edges.where(F.col("confidence").isin(wanted))


def resolve(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, node_id, label, tier): exact label, else the longest ending in ``.name``, else the shortest holding it."""
    found = containing(nodes.where(F.col("label").isNotNull()).select("node_id", "label"), asked.select("query_id", "name"), "label", "name")
    low, name = F.lower("label"), F.lower("name")
    tier = F.when(F.col("label") == F.col("name"), 0).when(F.endswith(low, F.concat(F.lit("."), name)), 1).otherwise(2)
    size, found = F.length("label"), found.withColumn("tier", tier)
    return ranked(found, "query_id", "tier", F.when(F.col("tier") == 1, -size).otherwise(size), "node_id", k=1).select("query_id", "node_id", "label", "tier")


def hydrate(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, chunk_id, exact): the tightest chunk of the node's file around its line, else the file's first.

    One equi-join on the file and a minimum; the span test is inside it, so nothing is sorted twice.
    """
    inside = (F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line"))
    pairs = nodes.select("node_id", "source_file", "line").join(chunks.select(F.col("rel_path").alias("source_file"), "chunk_id", "start_line", "end_line"), "source_file")
    best = F.min(F.struct(F.when(inside, 0).otherwise(1).alias("outside"), F.when(inside, F.col("end_line") - F.col("start_line")).otherwise(F.col("start_line")).alias("span"), "chunk_id"))
    return pairs.groupBy("node_id").agg(best.alias("x")).select("node_id", "x.chunk_id", (F.col("x.outside") == 0).alias("exact"))


def nearest_node(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, node_id, label, community_label): the file's node closest to the chunk's start, those inside first."""
    pairs = chunks.select("chunk_id", F.col("rel_path").alias("source_file"), "start_line", "end_line").join(nodes.select("node_id", "label", "community_label", "source_file", "line"), "source_file")
    outside = F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), 0).otherwise(1)
    best = F.min(F.struct(outside.alias("outside"), F.abs(F.col("line") - F.col("start_line")).alias("far"), "node_id", "label", "community_label"))
    return pairs.groupBy("chunk_id").agg(best.alias("x")).select("chunk_id", "x.node_id", "x.label", "x.community_label")


def reach(edges: DataFrame, starts: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """(query_id, node_id, depth): nodes within ``depth`` steps along (source -> target), starts left out.

    Each level joins the frontier with the edges and drops what was seen; at most ``depth`` rounds.
    """
    steps = edges.select("source", "target").distinct()
    seen = starts.select("query_id", "node_id").withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(steps, frontier["node_id"] == steps["source"]).select("query_id", F.col("target").alias("node_id")).distinct()
        frontier = written(new.join(seen, ["query_id", "node_id"], "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    found = seen.where("depth > 0")
    return found if limit is None else ranked(found, "query_id", "depth", "node_id", k=limit).select("query_id", "rank", "node_id", "depth")


def callers(edges: DataFrame, starts: DataFrame, depth: int = 1, limit: int = 100, confidence: tuple[str, ...] = ("EXTRACTED",)) -> DataFrame:
    calls = trusted(edges, confidence).where("relation = 'calls'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return reach(calls, starts, max(1, min(depth, 3)), max(1, min(limit, 100)))


def related(edges: DataFrame, starts: DataFrame, depth: int = 2, limit: int = 100, relations: list[str] | None = None, confidence: tuple[str, ...] = ("EXTRACTED",)) -> DataFrame:
    own = trusted(edges, confidence)
    own = own.where(F.col("relation").isin(relations)) if relations else own
    both = own.select("source", "target").unionByName(own.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return reach(both, starts, max(1, min(depth, 3)), max(1, min(limit, 100)))


def community(nodes: DataFrame, asked: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, rank, node_id, label, size) of the members of ``asked`` (query_id, community_id)."""
    own = nodes.join(maybe_broadcast(asked), "community_id")
    out = ranked(own, "query_id", "label", "node_id", k=max(1, min(limit, 200)))
    return out.withColumn("size", F.count("*").over(W.partitionBy("query_id"))).select("query_id", "rank", "node_id", "label", "size")


def rationale(edges: DataFrame, nodes: DataFrame, starts: DataFrame, limit: int = 50) -> DataFrame:
    why = edges.where("relation = 'rationale_for'").join(maybe_broadcast(starts.select("query_id", F.col("node_id").alias("target"))), "target")
    named = why.join(nodes.select(F.col("node_id").alias("source"), "label"), "source").withColumn("score", F.coalesce("confidence_score", F.lit(0.0)))
    return ranked(named, "query_id", F.desc("score"), "source", k=max(1, min(limit, 50))).select("query_id", "rank", F.col("source").alias("node_id"), "label", "score")


def tests_for(edges: DataFrame, nodes: DataFrame, starts: DataFrame, limit: int = 20, confidence: tuple[str, ...] = ("EXTRACTED",)) -> DataFrame:
    into = trusted(edges, confidence).where("relation in ('calls', 'references', 'implements', 'tests')").join(maybe_broadcast(starts.select("query_id", F.col("node_id").alias("target"))), "target")
    path = F.lower("source_file")
    is_test = F.greatest(*(F.contains(path, F.lit(p)) for p in NODE_TEST_PATHS))
    found = into.select("query_id", F.col("source").alias("node_id")).distinct().join(nodes.select("node_id", "label", "source_file"), "node_id").where(is_test)
    return ranked(found, "query_id", "label", "node_id", k=limit).select("query_id", "rank", "node_id", "label", "source_file")


def trace(edges: DataFrame, nodes: DataFrame, features: DataFrame, max_paths: int = 5, max_depth: int = 6, fan_out: int = 8, chain: int = 30, confidence: tuple[str, ...] = ("EXTRACTED",)) -> DataFrame:
    """(query_id, entry, entry_rank, node_id, depth, step): entries by token overlap with the label, then
    what they call, ``fan_out`` calls a node by id, up to ``max_depth`` deep and ``chain`` nodes an entry."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("feature", "/", " ")), r"\s+"), lambda t: F.length(t) >= 3))
    asked = features.select("query_id", F.explode(tokens).alias("token"))
    pairs = containing(nodes.where(F.col("label").isNotNull()).select("node_id", "label"), asked, "label", "token")
    scored = pairs.groupBy("query_id", "node_id").agg(F.count("*").alias("score"))
    entries = ranked(scored, "query_id", F.desc("score"), "node_id", k=max(1, min(max_paths, 20)), name="entry_rank").select("query_id", F.col("node_id").alias("entry"), "entry_rank")
    entries = written(entries, "entries")
    calls = trusted(edges, confidence).where("relation = 'calls'").select("source", "target").distinct()
    calls = ranked(calls, "source", "target", k=fan_out, name="nth").select("source", "target")
    starts = entries.select(F.concat_ws("#", "query_id", "entry").alias("query_id"), F.col("entry").alias("node_id"))
    deep = reach(calls, starts, max(1, min(max_depth, 10)))
    every = starts.withColumn("depth", F.lit(0)).unionByName(deep)
    ordered = ranked(every, "query_id", "depth", "node_id", k=chain, name="step").withColumnRenamed("query_id", "path")
    key = entries.withColumn("path", F.concat_ws("#", "query_id", "entry"))
    return ordered.join(maybe_broadcast(key), "path").select("query_id", "entry", "entry_rank", "node_id", "depth", "step")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): nodes, communities, edges and edges by confidence."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community_id").alias("communities")).select(F.explode(F.create_map(F.lit("nodes"), "nodes", F.lit("communities"), "communities")).alias("metric", "value"))
    per = edges.groupBy("confidence").agg(F.count("*").alias("value")).select(F.concat(F.lit("edges:"), "confidence").alias("metric"), "value")
    return n.unionByName(edges.agg(F.count("*").alias("value")).select(F.lit("edges").alias("metric"), "value")).unionByName(per)


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node_id, community): an extra: each node takes its neighbours' commonest label, the smallest on ties."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    labels = both.select(F.col("source").alias("node_id")).distinct().withColumn("community", F.col("node_id"))
    for _ in range(rounds):
        votes = both.join(labels, both["target"] == labels["node_id"]).groupBy("source", "community").agg(F.count("*").alias("n"))
        labels = written(votes.groupBy("source").agg(F.max(F.struct("n", "community")).alias("x")).select(F.col("source").alias("node_id"), "x.community"), "labels")
    return labels
