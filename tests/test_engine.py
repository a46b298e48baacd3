"""The stored index, the engine, the store, sources, adapters and the indexer, by small cases."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillmesh.adapters  # noqa: F401  registers the adapters
from quillmesh.indexer import Indexer
from quillmesh.operators import chunks, engine, enrich, index, ingest, search, store
from quillmesh.plans import registry
from quillmesh.sources import files as sources
from quillmesh.sources import walkers
from quillmesh.tools import Tools

ROOT = Path(__file__).resolve().parents[1]


def git(at, *args):
    subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", *args], cwd=at, check=True, capture_output=True)


def test_index_equals_search_without_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "the blue fox"), (3, None), (4, ""), (5, "red")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fox fox"), (2, "nothing here"), (3, "")], "query_id long, query string")
    index.build(docs, f"{tmp_path}/i", folders=4)
    got = index.search(spark, f"{tmp_path}/i", asked, 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.bm25(docs, asked, 10).collect()))
    only = index.search(spark, f"{tmp_path}/i", asked, 10, allowed=spark.createDataFrame([(5,)], "doc_id long")).collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in only] == [(1, 1, 5)]
    phrase = spark.createDataFrame([(1, "red.fox"), (2, "fox_red"), (3, "blue.red")], "query_id long, query string")
    assert sorted((r.query_id, r.doc_id) for r in index.search(spark, f"{tmp_path}/i", phrase, 10, phrases=True).collect()) == [(1, 1), (2, 1)]
    index.build(docs.limit(0), f"{tmp_path}/e")
    assert index.search(spark, f"{tmp_path}/e", asked).count() == 0


@pytest.mark.parametrize("score", ["l2", "cosine"])
def test_dense_blocks_against_brute_force(spark, score):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 5)).round(1)
    base[7] = base[8] = base[9]
    base[3] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(100, [1.0, 2.0]), (101, None), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.dense(v, v.where("vec_id % 10 = 0 or vec_id = 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), 6, score).collect()
    for q in [*range(0, 60, 10), 9]:
        d = lambda x: max(0.0, 1 - ((base[q] - x) ** 2).sum() / 2) if score == "l2" else float(base[q] @ x / (np.linalg.norm(base[q]) * np.linalg.norm(x) or np.inf))  # noqa: B023, E731
        want = sorted(((-round(d(x), 6), i) for i, x in enumerate(base)))[:6]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want]
    assert search.dense(v.limit(0), v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))).count() == 0


def test_engine_options(spark):
    rows = [(f"c{i}", f"alpha beta word{i}", f"Thing.part{i}", "a.py", "python", "method", 10 * i + 1, 10 * i + 8, "r", "p" if i < 2 else None) for i in range(4)]
    rows.append(("p", "the whole Thing", "Thing", "a.py", "python", "class", 1, 40, None, None))
    own = spark.createDataFrame(rows, "chunk_id string, content string, symbol string, rel_path string, language string, kind string, start_line int, end_line int, repo string, parent_chunk_id string")
    e = engine.SearchEngine(own, paraphrases=lambda q: F.array(F.lit("word3")), scorer=search.overlap_score, hypothesis=lambda q, kind: q)
    asked = spark.createDataFrame([(1, "word0 word1"), (2, " ")], "query_id long, query string")
    plain = engine.SearchEngine(own, lanes=("sparse",)).search(asked, 10, merge=False).collect()
    assert {r.query_id for r in plain} == {1} and {r.chunk_id for r in plain} == {"c0", "c1"} and all(r.score > 0.1 for r in plain)  # own scores of the only lane
    assert any(r.rel_path == "a.py" for r in e.search(asked, 5).collect())
    up = engine.SearchEngine(own, lanes=("sparse",)).search(asked, 10, merge=False, promote=True).collect()
    assert [r.chunk_id for r in up] == ["p"]
    none = engine.SearchEngine(own, lanes=("sparse",)).search(asked, 10, where=F.col("kind") == "class").count()
    assert none == 0
    smart = engine.SearchEngine(own).smart(spark.createDataFrame([(1, "what calls the Thing"), (2, "show me the part2")], "query_id long, query string"), 3).collect()
    assert {(r.query_id, r.intent, r.confidence) for r in smart} == {(1, "search_code", 0.45), (2, "get_symbol", 0.9)}
    t = Tools(engine.SearchEngine(own), {"a": 1})
    assert t.search_code("word2", 99, language=["PYTHON"]).first().rel_path == "a.py" and t.get_symbol("part1").first().chunk_id == "c1"
    assert [r.chunk_id for r in t.get_file_outline("a.py").orderBy("rank").collect()][0] == "c0" and t.list_repos().first().repo == "r" and t.get_config() == {"a": 1}


def test_graph_tools(spark):
    nodes = spark.createDataFrame([("n1", "Api.run", "a.py", 3, 1, "core"), ("n2", "Api.help", "a.py", 30, 1, "core"), ("n3", "test_run", "tests/test_a.py", 1, 2, "checks")], "node_id string, label string, source_file string, line int, community_id int, community_label string")
    edges = spark.createDataFrame([("n2", "n1", "calls", "EXTRACTED", 1.0), ("n3", "n1", "tests", "EXTRACTED", 1.0), ("n2", "n1", "rationale_for", "EXTRACTED", None)], "source string, target string, relation string, confidence string, confidence_score double")
    own = spark.createDataFrame([("c1", "x", "Api.run", "a.py", 1, 20)], "chunk_id string, content string, symbol string, rel_path string, start_line int, end_line int")
    e = engine.SearchEngine(own, nodes=nodes, edges=edges, lanes=("symbol",))
    t = Tools(e)
    assert t.find_callers("run").first().node_id == "n2" and {r.node_id for r in t.find_related("run").collect()} == {"n2", "n3"}
    assert [r.node_id for r in t.get_community("run").collect()] == [r.node_id for r in t.get_community(community_id=1).collect()] == ["n2", "n1"]
    assert t.find_rationale("run").first().node_id == "n2" and t.find_tests_for("run").first().node_id == "n3" and t.trace_feature("help").count() == 2
    hits = e.smart(spark.createDataFrame([(1, "who calls run"), (2, "trace the help flow")], "query_id long, query string")).collect()
    assert {(r.query_id, r.node_id, r.chunk_id, r.score) for r in hits} == {(1, "n2", "c1", 1.0), (2, "n2", "c1", 1.0), (2, "n1", "c1", 0.95)}


def test_chunk_places(spark):
    vue = "<template>\n" + "<p/>\n" * 160 + "</template>\n<script setup>\nlet a\n</script>\n<script>\nb\n</script>\n"
    f = spark.createDataFrame([("a.vue", vue), ("s.vue", "<template>short</template>"), ("n.vue", "plain text\n" * 170)], "rel_path string, content string")
    got = {(r.rel_path, r.kind, r.symbol, r.start_line, r.end_line) for r in chunks.components(f).collect()}
    assert got == {("a.vue", "component_template", None, 1, 162), ("a.vue", "component_script", "setup", 163, 165), ("a.vue", "component_script", None, 166, 168), ("s.vue", "component", None, 1, 1), ("n.vue", "file", None, 1, 171)}
    md = "# Top\n" + "line of text\n" * 10 + "## Sub #\nbody\n### Deep\nx\n# Next\n"
    rows = chunks.headings(spark.createDataFrame([("m.md", md), ("e.md", ""), ("p.md", "no heading")], "rel_path string, content string"), 60).collect()
    assert ("m.md", "section_part", "Top") in {(r.rel_path, r.kind, r.symbol) for r in rows} and {(r.symbol, r.parent_line) for r in rows if r.symbol in ("Sub", "Deep", "Next")} == {("Sub", 1), ("Deep", 12), ("Next", None)}
    assert {r.rel_path for r in rows if r.kind == "document"} == {"e.md", "p.md"}


def test_walkers(spark, tmp_path):
    for at in (tmp_path, tmp_path / "sub/inner"):
        at.mkdir(parents=True, exist_ok=True)
        git(at, "init", "-q")
    (tmp_path / "a.py").write_text("a = 1\n")
    (tmp_path / "skip.log").write_text("x")
    (tmp_path / ".gitignore").write_text("*.md\n")
    (tmp_path / "no.md").write_text("# no")
    (tmp_path / "sub/inner/b.py").write_text("b = 1\n")
    assert "a.py" in walkers.git_files(tmp_path) and "no.md" not in walkers.git_files(tmp_path)
    assert walkers.nested_repos(tmp_path) == [tmp_path / "sub/inner"] and walkers.nested_repos(tmp_path, 1) == []
    assert {r.rel_path for r in walkers.walk_git(spark, tmp_path).collect()} == {"a.py"}
    assert {(r.rel_path, r.language) for r in walkers.walk_nested(spark, tmp_path).collect()} == {("a.py", "python"), ("sub/inner/b.py", "python")}
    git(tmp_path, "add", "a.py", "skip.log")
    git(tmp_path, "commit", "-qm", "one")
    first = walkers.git_identity(tmp_path)["head_commit"]
    git(tmp_path, "mv", "a.py", "c.py")
    git(tmp_path, "rm", "-q", "skip.log")
    git(tmp_path, "commit", "-qm", "two")
    assert {tuple(r) for r in walkers.git_deltas(spark, tmp_path, first).collect()} == {("rename", "c.py", "a.py", 100), ("delete", "skip.log", None, None)}
    assert walkers.git_deltas(spark, tmp_path, "nosuch") is None and walkers.git_identity("/")["head_commit"] is None
    assert walkers.repo_name(tmp_path) == f"local:{tmp_path}" and walkers.repo_name("/").startswith("path:")
    assert sources.read_ignore(["# c\n\na/\n", "!a/b\n"]) == ["a/", "!a/b"]
    with pytest.raises(ValueError):
        walkers.parse_glossary("terms:\n  - term: x\n")
    assert walkers.read_glossary(spark, [tmp_path / "none.yaml"]).count() == 0


def test_registry_and_settings():
    assert ("enricher", "noop") in registry.available("enricher") and registry.build("retrieval-stream", "dense", {"k": 3}) is not None
    assert registry.adapter_id("enricher", "noop") == "noop" and registry.adapter_id("embedder", "hash") != registry.adapter_id("embedder", "hash", {"dim": 32})
    with pytest.raises(ValueError):
        registry.settings("embedder", "hash", {"nosuch": 1})
    env = {"QUILLMESH_EMBEDDER__CONFIG__DIM": "32", "QUILLMESH_RERANKER__ADAPTER": "overlap", "OTHER": "x"}
    got = registry.resolve({"embedder": {"adapter": "hash", "config": {"dim": 64}}}, {}, {"reranker": {"adapter": "noop"}}, env, {"embedder": {"config": {"dim": 16}}})
    assert got == {"embedder": {"adapter": "hash", "config": {"dim": 16}}, "reranker": {"adapter": "overlap"}}
    assert registry.problems(got) == [] and len(registry.problems({"embedder": {"adapter": "no"}, "x": {}})) == 2


def test_indexer_counts_and_modes(spark, tmp_path):
    shape = "rel_path string, language string, content string, size_bytes long, mtime double"
    long = "some text that is long enough "
    one = spark.createDataFrame([("a.txt", None, long + "a", 1, 1.0), ("b.txt", None, long + "b", 1, 1.0), ("c.md", "markdown", "# Head of it\n" + long, 1, 1.0)], shape)
    x = Indexer(spark, str(tmp_path / "i"), enricher=("first", lambda c: enrich.summarised(c)))
    done = x.run(one, "r", head="h1")
    assert (done["mode"], done["files_visited"], done["chunks_embedded"], done["chunks_enriched_from_cache"]) == ("full", 3, 3, 0) and x.last_head("r") == "h1"
    again = x.run(one, "r")
    assert (again["files_skipped_fresh"], again["chunks_seen"], again["chunks_embedded"]) == (3, 0, 0)
    two = spark.createDataFrame([("a.txt", None, long + "a", 1, 2.0), ("b.txt", None, long + "new", 1, 2.0)], shape)
    third = x.run(two, "r")
    assert (third["files_evicted"], third["chunks_seen"], third["chunks_embedded"], third["chunks_skipped_fresh"]) == (1, 2, 1, 1)
    assert {r.rel_path for r in x.table("chunks").collect()} == {"a.txt", "b.txt"} and x.table("files").count() == 2
    x.run(one, "other")
    deltas = spark.createDataFrame([("delete", "a.txt", None), ("rename", "z.txt", "b.txt")], "action string, rel_path string, old_path string")
    fourth = x.run(two, "r", deltas=deltas, head="h2")
    assert fourth["mode"] == "incremental" and {(r.repo, r.rel_path) for r in x.table("chunks").collect()} == {("r", "z.txt"), ("other", "a.txt"), ("other", "b.txt"), ("other", "c.md")}
    moved = x.table("chunks").where("rel_path = 'z.txt'").first()
    assert moved.chunk_id == ingest.rename_paths(x.table("chunks").where("repo = 'r'"), spark.createDataFrame([], "old_path string, new_path string")).first().chunk_id and moved.embedding is not None
    assert x.table("runs").count() == 5
    nodes = spark.createDataFrame([("n", "Label", "z.txt", 1, "com")], "node_id string, label string, source_file string, line int, community_label string")
    assert x.refresh_graph(nodes, nodes, 2.0, 1.0) is None
    full, docs = x.refresh_graph(nodes, nodes, 1.0, 2.0)
    assert full.first().embedding is not None and docs.where("document like '%node: Label%'").count() == 1
    x.clear()
    assert x.table("chunks").count() == 0 and x.table("runs").count() == 5


def test_store_small_operators(spark):
    cache = spark.createDataFrame([], "key string, paraphrases array<string>, created_at long")
    made = spark.createDataFrame([(f"q{i}", ["p"], i) for i in range(6)], "query string, paraphrases array<string>, created_at long")
    kept = store.put_paraphrases(cache, made, 4)
    assert {r.created_at for r in kept.collect()} == {4, 5}
    assert store.get_meta(spark.createDataFrame([("a", "1")], "key string, value string"), "b") is None
    df = spark.createDataFrame([(1, "x\ny"), (None, "z")], "a long, b string")
    assert store.rendered(df).splitlines()[0].split() == ["a", "b"] and store.rendered(df, "json").count("{") == 2
    chunks_ = spark.createDataFrame([("glossary:x", "glossary")], "chunk_id string, kind string")
    terms = spark.createDataFrame([("A", "b", ["c"], None), ("N", None, None, None)], "term string, definition string, aliases array<string>, category string")
    assert store.index_terms(chunks_, terms).count() == 1


def test_rest_works_without_the_training_operators(tmp_path):
    """The driver deletes these folders; the entry must import and answer without them."""
    shutil.copytree(ROOT / "quillmesh", tmp_path / "quillmesh", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "quillmesh/llm/__pycache__").mkdir(parents=True)  # a left-over folder without modules
    said = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'bm25_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(s) <= set(q)"
    for with_pipeline in (False, True):
        if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        done = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
