"""Hand-checked cases of single operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import chunks as C
from quillmesh.operators import enrich, graph, ingest, reports, search
from quillmesh.plans import cache, intent
from quillmesh.sources import files as sources
from quillmesh.streaming import watch


def test_rrf_ties_follow_first_occurrence(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id int, rank int, chunk_id string")
    b = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "d")], "query_id int, rank int, chunk_id string")
    got = search.rrf([a, b]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "c", "d"] and [r["rank"] for r in got] == [1, 2, 3, 4]
    assert search.rrf([a.limit(0), b.limit(0)]).count() == 0


def test_camel_case_is_found(spark):
    docs = spark.createDataFrame([(1, "class FsrsCalculator"), (2, "nothing here")], "doc_id int, raw string").select("doc_id", text.camel_split(F.col("raw")).alias("text"))
    asked = spark.createDataFrame([(1, "fsrsCalculator"), (2, "!!")], "query_id int, query string")
    assert [(r.query_id, r.doc_id) for r in search.bm25(docs, asked).collect()] == [(1, 1)]


def test_dimension_mismatch_raises(spark):
    v = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="expected 3 dimensions"):
        search.check_dimension(v, 3).collect()


def test_pair_all_without_broadcast_is_complete(spark):
    from quillmesh.operators.common import pair_all

    left, right = spark.range(50).withColumnRenamed("id", "a"), spark.range(30).withColumnRenamed("id", "b")
    assert pair_all(left, right, "a", rows=5).distinct().count() == pair_all(left, right, "a").distinct().count() == 1500


def test_filters(spark):
    c = spark.createDataFrame([("src/a.py", "python", "function"), ("src/tests/b.py", "python", "class"), ("web/c.ts", "typescript", "class")], "rel_path string, language string, kind string")
    pick = lambda **k: sorted(r.rel_path for r in c.where(search.search_filter(**k)).collect())
    assert pick(language=["PYTHON"]) == ["src/a.py", "src/tests/b.py"] and pick(path_prefix="web/") == ["web/c.ts"]
    assert pick(kind=["Class"]) == ["src/tests/b.py", "web/c.ts"] and pick(exclude_tests=True) == ["src/a.py", "web/c.ts"] and len(pick()) == 3


def test_facets_of_no_hits(spark):
    c = spark.createDataFrame([("1", "py", "file", None)], "chunk_id string, language string, kind string, repo string")
    assert search.facets(c, c.limit(0)).count() == 0
    assert {(r.facet, r.value) for r in search.facets(c).collect()} == {("language", "py"), ("kind", "file"), ("repo", "(local)")}


def test_adjacent_merge_only_close_lines_of_one_file(spark):
    h = spark.createDataFrame([(1, 1, "a", 10, 20, 0.9, "x"), (1, 2, "a", 23, 30, 0.8, "y"), (1, 3, "a", 99, 100, 0.7, "z"), (1, 4, "b", 21, 22, 0.6, "w")], "query_id int, rank int, rel_path string, start_line int, end_line int, score double, snippet string")
    got = search.merge_adjacent(h).orderBy("rank").collect()
    assert [(r.rel_path, r.start_line, r.end_line, r.parts) for r in got] == [("a", 10, 30, 2), ("a", 99, 100, 1), ("b", 21, 22, 1)]
    assert got[0].snippet == "x\n…\ny"


def test_parents_take_the_place_of_two_children(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "b", 0.8), (1, 3, "c", 0.7)], "query_id int, rank int, chunk_id string, score double")
    own = spark.createDataFrame([("a", "p"), ("b", None), ("c", "p")], "chunk_id string, parent_chunk_id string")
    assert [(r.chunk_id, r.promoted) for r in search.promote_parents(hits, own).orderBy("rank").collect()] == [("p", True), ("b", False)]


def test_reach_is_cycle_safe_and_bounded(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string").selectExpr("*", "'calls' relation", "'EXTRACTED' confidence")
    s = spark.createDataFrame([(1, "d")], "query_id int, node_id string")
    assert [r.node_id for r in graph.callers(e, s, 3).orderBy("rank").collect()] == ["c", "b", "a"]
    assert graph.callers(e, s, 1).count() == 1 and graph.callers(e, s, 3, limit=2).count() == 2
    assert graph.callers(e.withColumn("confidence", F.lit("INFERRED")), s, 3).count() == 0
    assert {r.node_id for r in graph.related(e, s, 2).collect()} == {"c", "a", "b"}


def test_chunkers(spark):
    assert C.pack_lines("aa\nbb\ncc", 6) == [(1, 2, "aa\nbb"), (3, 3, "cc")]
    f = spark.createDataFrame([("a.md", "pre\n# A\nx\n## B\ny\n# C\nz")], "rel_path string, content string")
    got = {(r.kind, r.symbol, r.start_line, r.end_line) for r in C.headings(f).collect()}
    assert got == {("document", None, 1, 1), ("section", "A", 2, 5), ("section", "B", 4, 5), ("section", "C", 6, 7)}
    assert C.python_units("def broken(") == []


def test_identities(spark):
    import hashlib

    row = spark.range(1).select(text.chunk_id(F.lit("a.py"), F.lit(1), F.lit(2), F.lit("h"), F.lit("r")).alias("a"), text.chunk_id(F.lit("a.py"), F.lit(1), F.lit(2), F.lit("h")).alias("b"), text.line_of(F.lit("L12")).alias("l"), text.line_of(F.lit("x")).alias("n")).first()
    assert row.a == "sha256:" + hashlib.sha256(b"r:a.py:1-2:h").hexdigest() and row.b == "sha256:" + hashlib.sha256(b"a.py:1-2:h").hexdigest()
    assert row.l == 12 and row.n is None


def test_upsert_keeps_and_renames_recompute(spark):
    old = spark.createDataFrame([("k", 1, "x"), ("m", 1, "y"), (None, 1, "n")], "id string, born int, v string")
    new = spark.createDataFrame([("k", 9, "z"), ("q", 9, "w"), (None, 9, "N")], "id string, born int, v string")
    assert {tuple(r) for r in ingest.upsert(old, new, "id", keep=("born",)).collect()} == {("k", 1, "z"), ("m", 1, "y"), ("q", 9, "w"), (None, 1, "N")}
    c = spark.createDataFrame([("i", "a", 1, 2, "h")], "chunk_id string, rel_path string, start_line int, end_line int, content_hash string")
    same = ingest.rename_paths(c, spark.createDataFrame([("a", "a")], "old_path string, new_path string")).first()
    moved = ingest.rename_paths(c, spark.createDataFrame([("a", "b")], "old_path string, new_path string")).first()
    assert same.chunk_id == "i" and moved.rel_path == "b" and moved.chunk_id.startswith("sha256:")


def test_versions_swap(spark, tmp_path):
    root = str(tmp_path / "table")
    ingest.swap(spark.range(3), root)
    first = ingest.current(spark, root)
    ingest.swap(first.union(spark.range(2)), root)
    assert ingest.current(spark, root).count() == 5


def test_graph_reload_keeps_vectors(spark):
    old = spark.createDataFrame([("a", "A", [1.0]), ("b", "B", [2.0])], "node_id string, label string, embedding array<double>")
    new = spark.createDataFrame([("a", "A"), ("b", "changed"), ("c", "C")], "node_id string, label string")
    assert {r.node_id: r.embedding for r in ingest.load_graph(old, new).collect()} == {"a": [1.0], "b": None, "c": None}
    d = ingest.graph_diff(spark.createDataFrame([("a", None)], "s string, t string"), spark.createDataFrame([("a", None), ("b", "x")], "s string, t string"), ["s", "t"])
    assert [tuple(r) for r in d.collect()] == [("b", "x", "added")]


def test_backfill_and_cache(spark):
    c = spark.createDataFrame([("a", None), ("b", "r1")], "rel_path string, repo string")
    assert ingest.backfill_repo(c, "r2", spark.createDataFrame([("a",)], "rel_path string")).where("repo = 'r2'").count() == 1
    assert ingest.backfill_repo(c, "r2", spark.createDataFrame([("z",)], "rel_path string")).where("repo = 'r2'").count() == 0
    k = spark.createDataFrame([([0.104, -0.106],), ([0.1, -0.11],)], "v array<double>").select(cache.cache_key(F.col("v"), F.lit(5), F.lit(None)).alias("k")).collect()
    assert k[0].k == k[1].k
    e = spark.createDataFrame([("k1", "2024-01-01 00:00:00", "2024-01-01 00:30:00"), ("k2", "2023-01-01 00:00:00", "2024-01-01 00:40:00")], "key string, created_at string, used_at string").select("key", F.to_timestamp("created_at").alias("created_at"), F.to_timestamp("used_at").alias("used_at"))
    assert [r.key for r in cache.live(e, F.to_timestamp(F.lit("2024-01-01 00:50:00"))).collect()] == ["k1"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.py").write_text("print(1)")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    (tmp_path / "c.md").write_bytes(b"x\x00y")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "d.py").write_text("2")
    got = sources.walk(spark, f"file://{tmp_path}", ignore=["skip/"]).collect()
    assert [(r.rel_path, r.language, r.content) for r in got] == [("a.py", "python", "print(1)")]
    assert sources.parse_manifest("repos:\n  - a\n  - path: b\n    enabled: false\n  - path: 'c'\n") == ["a", "c"]
    with pytest.raises(ValueError):
        sources.parse_manifest("repos:\n  - enabled: true\n")
    (tmp_path / "g.jsonl").write_text('# note\n\n{"id": "1", "query": "q", "tags": ["t"]}\n')
    assert [(r.query_id, r.query, r.tags) for r in sources.read_golden(spark, str(tmp_path / "g.jsonl")).collect()] == [("1", "q", ["t"])]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "label": "A", "source_location": "L7"}], "links": [{"source": "a", "target": "b", "relation": "calls"}], "communities": {"3": ["a"]}, "community_labels": {"3": "core"}}')
    nodes, edges = sources.read_graph(spark, str(tmp_path / "g.json"), "r")
    n = nodes.first()
    assert (n.node_id, n.line, n.community_id, n.community_label) == ("r:a", 7, 3, "core") and edges.first().target == "r:b"
    log = sources.parse_log(spark.createDataFrame([('{"event": "done", "repo": "r", "files": 2}',), ("commit hook started",), ("noise",)], "value string"))
    assert {(r.event, r.files) for r in log.collect()} == {("done", 2), ("hook_start", None)}


def test_reports(spark):
    cases = spark.createDataFrame([(1, ["a.py"], [], ["t"]), (2, [], ["Foo"], None)], "query_id int, expected_paths array<string>, expected_symbols array<string>, tags array<string>")
    hits = spark.createDataFrame([(1, 1, "x/b.py", None), (1, 2, "x/a.py", None), (2, 1, "y", "mod.foo")], "query_id int, rank int, rel_path string, symbol string")
    judged = reports.first_hits(cases, hits)
    assert tuple(reports.metrics(judged).first()) == (2, 1.0, 0.75)
    assert {r.tag for r in reports.metrics_by_tag(judged).collect()} == {"t", "(untagged)"}
    assert reports.passes_gate(reports.metrics(judged)).first().passed


def test_intents_and_enrichment(spark):
    q = spark.createDataFrame([(1, "how are you"), (2, "what is a and how is b done")], "query_id int, query string")
    assert intent.decompose(q).where("query_id = 2").count() == 2
    routed = intent.route(q).withColumns({"model_intent": F.lit("find_tests_for"), "model_subject": F.lit("s"), "model_confidence": F.lit(0.8)})
    assert intent.accept_model(routed).where("query_id = 1").first().intent == "find_tests_for"
    assert intent.hypothetical(q, lambda c, kind: F.lit("```py\nx = 1\n```")).first().dense_query == "x = 1"
    c = spark.createDataFrame([("first line\nrest",)], "content string")
    assert enrich.summarised(c).first().embedding_text == "[Context: first line]\n\nfirst line\nrest"


def test_debounce_agrees(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:05")], "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    a, b = watch.debounced(e, "2 seconds"), watch.debounced_batch(e, 2)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.select(a.columns).collect()}


def test_maintained_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(src)
    seen = []
    stream = spark.readStream.schema("id long").parquet(src)
    watch.maintain(stream, lambda df, n: (df.write.mode("append").parquet(out), seen.append(n)), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 10 and seen
