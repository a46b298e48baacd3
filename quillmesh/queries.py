"""The registered queries: each applies one operator to the test tables, with its SQL form beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules, text
from .operators import chunks as C
from .operators import enrich, graph, ingest, reports, search
from .operators.common import maybe_broadcast, pair_all, ranked, shared_dir
from .plans import cache, intent
from .sources import files as sources
from .streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# -- ranked retrieval ------------------------------------------------------------------------
BM25_CTES = r"""
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS dl FROM documents),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(query, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\p{L}\p{N}]+'), lambda t: length(t) > 1)) AS term FROM q) GROUP BY ALL),
scores AS (
  SELECT a.query_id, tf.doc_id, round(sum(a.times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked a JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL
),
bm25 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores)
"""
Q_BENCH = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@query(f"WITH {Q_BENCH}, {BM25_CTES} SELECT * FROM bm25 WHERE rank <= 10")
def bm25_topk(spark, d):
    return search.bm25(read(spark, d, "documents"), benchmark_queries(spark, d), 10)


DENSE = """
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round({score}, 6) AS score
  FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) {where}) WHERE rank <= {k}
"""
COS_SQL = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))))"


def query_vectors(spark, d):
    return read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query(DENSE.format(score="greatest(0, 1 - list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) ** 2 / 2)", where="", k=10))
def dense_topk(spark, d):
    return search.dense(read(spark, d, "embeddings"), query_vectors(spark, d), 10)


@query(DENSE.format(score=COS_SQL, where="WHERE score >= 0.3", k=20))
def dense_threshold_cosine(spark, d):
    return search.dense(read(spark, d, "embeddings"), query_vectors(spark, d), 20, "cosine", 0.3)


SYMBOL_QUERIES = [(1, "where is the red ECONOMY widget"), (2, "smallRing of steel"), (3, "show the blue_bolt class"), (4, "is the of"), (5, "hotGear")]
SYMBOL_NAMES = [(1, "small ring"), (2, "RING"), (3, "no such part"), (4, "Blue B")]
values = lambda xs: ", ".join("(" + ", ".join("NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in xs)
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(rules.STOPWORDS)) + "]"
CAMEL_SQL = r"regexp_replace(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
SYMBOLS_SQL = "s AS (SELECT 'part:' || p_partkey AS chunk_id, p_name || ' ' || p_type AS symbol FROM part)"


def symbols(spark, d):
    return read(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("chunk_id"), F.concat_ws(" ", "p_name", "p_type").alias("symbol"))


SYMBOL_CTE = rf"""
wanted AS (SELECT query_id, list_filter(list_distinct(list_filter(regexp_extract_all(lower({CAMEL_SQL.format(c="query")}), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 3)), lambda t: NOT list_contains({STOP_SQL}, t)) AS tokens FROM sq),
sscore AS (SELECT query_id, chunk_id, symbol, CAST(len(list_filter(tokens, lambda t: contains(lower(symbol), t))) AS BIGINT) AS score FROM s, wanted),
smatch AS (SELECT query_id, chunk_id, symbol, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(symbol), chunk_id) AS rank FROM sscore WHERE score > 0)
"""


@query(f"WITH {SYMBOLS_SQL}, sq(query_id, query) AS (VALUES {values(SYMBOL_QUERIES)}), {SYMBOL_CTE} SELECT * FROM smatch WHERE rank <= 20")
def symbol_match(spark, d):
    return search.symbol_match(symbols(spark, d), rows(spark, SYMBOL_QUERIES, "query_id int, query string"))


@query(f"""WITH asked(query_id, name) AS (VALUES {values(SYMBOL_NAMES)}),
t AS (SELECT query_id, 'part:' || p_partkey AS chunk_id, p_name AS symbol, CASE WHEN p_name = name THEN 0 WHEN ends_with(lower(p_name), '.' || lower(name)) THEN 1 WHEN contains(lower(p_name), lower(name)) THEN 2 END AS tier FROM part, asked)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(symbol), chunk_id) AS rank, chunk_id, symbol, tier FROM t WHERE tier IS NOT NULL) WHERE rank <= 5""")
def symbol_lookup(spark, d):
    named = read(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("chunk_id"), F.col("p_name").alias("symbol"))
    return search.symbol_lookup(named, rows(spark, SYMBOL_NAMES, "query_id int, name string"))


RRF_SQL = """
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, min(struct_pack(stream := stream, place := rank)) AS first FROM streams GROUP BY ALL),
rrf AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.stream, first.place, chunk_id) AS rank, chunk_id, score FROM fused)
"""
LISTS = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "c"), (1, 1, 1, "b"), (1, 1, 2, "a"), (1, 1, 3, "d"), (2, 1, 1, "x"), (2, 1, 2, "x"), (2, 0, 1, "y")]


@query(f"WITH streams(query_id, stream, rank, chunk_id) AS (VALUES {values(LISTS)}), {RRF_SQL} SELECT * FROM rrf")
def rrf_fuse(spark, d):
    lists = rows(spark, LISTS, "query_id int, stream int, rank int, chunk_id string")
    return search.rrf([lists.where("stream = 0").drop("stream"), lists.where("stream = 1").drop("stream")])


def document_chunks(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))).alias("rel_path"), F.col("lang").alias("language"), F.lit("document").alias("kind"), F.col("source").alias("repo"), F.concat_ws(".", "source", F.concat(F.lit("doc"), "doc_id")).alias("symbol"), F.col("text").alias("content"))


DOC_SYMBOLS = "s AS (SELECT doc_id AS chunk_id, source || '.doc' || doc_id AS symbol FROM documents)"
HYBRID_STREAMS = "streams AS (SELECT query_id, 0 AS stream, rank, doc_id AS chunk_id FROM bm25 WHERE rank <= 50 UNION ALL SELECT query_id, 1, rank, chunk_id FROM smatch WHERE rank <= 20)"
HYBRID_QUERIES = [(1, "src1 doc12 documents about the licensed"), (2, "src3 Version 2.0 Apache License"), (3, "  "), (4, "doc77 worthless trash")]


def sparse_and_symbols(spark, d, asked, k):
    own = document_chunks(spark, d)
    return search.rrf([search.bm25(own, asked, 50, "chunk_id", "content").withColumnRenamed("doc_id", "chunk_id"), search.symbol_match(own, asked, 20)], k)


@query(f"WITH q(query_id, query) AS (VALUES {values([r for r in HYBRID_QUERIES if r[1].strip()])}), sq AS (SELECT * FROM q), {BM25_CTES}, {DOC_SYMBOLS}, {SYMBOL_CTE}, {HYBRID_STREAMS}, {RRF_SQL} SELECT * FROM rrf WHERE rank <= 10")
def hybrid_rrf(spark, d):
    return sparse_and_symbols(spark, d, rows(spark, HYBRID_QUERIES, "query_id int, query string").where(F.trim("query") != ""), 10)


@query()
def hybrid_three_streams(spark, d):
    return search.hybrid(document_chunks(spark, d), rows(spark, HYBRID_QUERIES, "query_id int, query string"), 10)


VARIANTS = [(1, 0, "Apache License version"), (1, 1, "licensed under Apache"), (1, 2, "General Public License"), (2, 0, "the of and"), (2, 1, "worthless trash")]
VARIANT_SQL = f"""q AS (SELECT query_id || '#' || variant AS query_id, query FROM v), {BM25_CTES},
parts AS (SELECT CAST(split_part(query_id, '#', 1) AS BIGINT) AS query_id, CAST(split_part(query_id, '#', 2) AS INT) AS variant, rank, doc_id AS chunk_id FROM bm25 WHERE rank <= 50),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, min(struct_pack(variant := variant, place := rank)) AS first FROM parts GROUP BY ALL)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.variant, first.place, chunk_id) AS rank, chunk_id, score FROM fused) WHERE rank <= 10"""


def bm25_chunks(spark, d):
    return lambda asked, k: search.bm25(read(spark, d, "documents"), asked, k).withColumnRenamed("doc_id", "chunk_id")


@query(f"WITH v(query_id, variant, query) AS (VALUES {values(VARIANTS)}), {VARIANT_SQL}")
def multi_query_rrf(spark, d):
    return search.fused_variants(bm25_chunks(spark, d), rows(spark, VARIANTS, "query_id long, variant int, query string"), 10)


COMPOUND = [(1, "how is the Apache License given and what is the version"), (2, "where are the licensed documents"), (3, "who wrote the src1 text, and when did it change or why is it trash")]
PARTS = [(1, 0, "how is the Apache License given"), (1, 1, "what is the version"), (2, 0, "where are the licensed documents"), (3, 0, "who wrote the src1 text"), (3, 1, "when did it change"), (3, 2, "why is it trash")]


@query(f"SELECT * FROM (VALUES {values(PARTS)}) AS t(query_id, variant, query)")
def decompose_queries(spark, d):
    return intent.decompose(rows(spark, COMPOUND, "query_id int, query string"))


@query(f"WITH v(query_id, variant, query) AS (VALUES {values(PARTS)}), {VARIANT_SQL}")
def decomposed_rrf(spark, d):
    return search.fused_variants(bm25_chunks(spark, d), intent.decompose(rows(spark, COMPOUND, "query_id long, query string")), 10)


@query(f"WITH documents AS (SELECT * FROM main.documents WHERE lower(lang) IN ('en', 'fr') AND starts_with(source || '/' || doc_id || '.txt', 'src1')), {Q_BENCH}, {BM25_CTES} SELECT * FROM bm25 WHERE rank <= 5")
def filtered_search(spark, d):
    own = document_chunks(spark, d).where(search.search_filter(["EN", "fr"], "src1", ["Document"], True))
    return search.bm25(own, benchmark_queries(spark, d), 5, "chunk_id", "content")


FACETS = """SELECT facet, value, count(*) AS n FROM (SELECT unnest([{'facet': 'language', 'value': lang}, {'facet': 'kind', 'value': 'document'}, {'facet': 'repo', 'value': coalesce(source, '(local)')}], recursive := true) FROM documents %s) GROUP BY ALL"""


@query(FACETS % "")
def facets_all(spark, d):
    return search.facets(document_chunks(spark, d))


@query(FACETS % "WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def facets_hits(spark, d):
    return search.facets(document_chunks(spark, d), read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def facets_grouping_sets(spark, d):
    read(spark, d, "documents").createOrReplaceTempView("facet_documents")
    return spark.sql("SELECT lang, source, count(*) AS n FROM facet_documents GROUP BY GROUPING SETS ((lang), (source), ())")


TURN_HITS = "h AS (SELECT conv_id % 5 AS query_id, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY length(text) DESC, conv_id, turn) AS rank, conv_id, turn, text, conv_id || '/' || turn AS chunk_id, length(text)::DOUBLE AS score FROM conversations)"


def turn_hits(spark, d):
    t = read(spark, d, "conversations")
    scored = t.select((F.col("conv_id") % 5).alias("query_id"), "conv_id", "turn", "text", F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.length("text").cast("double").alias("score"))
    return ranked(scored, "query_id", F.desc("score"), "conv_id", "turn")


@query(f"""WITH {TURN_HITS}, top AS (SELECT * FROM h WHERE rank <= 20), m AS (SELECT *, count(*) OVER (PARTITION BY query_id, conv_id) AS n FROM top),
b AS (SELECT query_id, CASE WHEN n >= 2 THEN 'conv:' || conv_id ELSE chunk_id END AS chunk_id, min(struct_pack(rank := rank, score := score, promoted := n >= 2)) AS x FROM m GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY x.rank, chunk_id) AS rank, chunk_id, x.score AS score, x.promoted AS promoted FROM b""")
def parent_promotion(spark, d):
    hits = turn_hits(spark, d).where("rank <= 20").select("query_id", "rank", "chunk_id", "score")
    chunks = read(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.concat(F.lit("conv:"), "conv_id").alias("parent_chunk_id"))
    return search.promote_parents(hits, chunks)


@query(f"""WITH {TURN_HITS}, top AS (SELECT query_id, 'conv' || conv_id AS rel_path, turn * 10 AS start_line, turn * 10 + CAST(length(text) % 9 AS BIGINT) AS end_line, rank, score, substr(text, 1, 40) AS snippet FROM h WHERE rank <= 60),
m AS (SELECT *, max(end_line) OVER (PARTITION BY query_id, rel_path ORDER BY start_line, end_line, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM top),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line - reach > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, rel_path ORDER BY start_line, end_line, rank) AS island FROM m),
g AS (SELECT query_id, rel_path, island, min(start_line) AS start_line, max(end_line) AS end_line, max(score) AS score, min(rank) AS old_rank, count(*) AS parts, substr(string_agg(snippet, chr(10) || '…' || chr(10) ORDER BY start_line, end_line, rank), 1, 1200) AS snippet FROM i GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY old_rank, rel_path) AS rank, rel_path, start_line, end_line, score, parts, snippet FROM g""")
def adjacency_merge(spark, d):
    h = turn_hits(spark, d).where("rank <= 60")
    place = h.select("query_id", F.concat(F.lit("conv"), "conv_id").alias("rel_path"), (F.col("turn") * 10).alias("start_line"), (F.col("turn") * 10 + F.length("text") % 9).alias("end_line"), "rank", "score", F.substring("text", 1, 40).alias("snippet"))
    return search.merge_adjacent(place)


@query(rf"""WITH {Q_BENCH}, {BM25_CTES},
snip AS (SELECT doc_id, CASE WHEN length(text) > 480 THEN rtrim(substr(text, 1, 480), ' ') || '…' ELSE text END AS snippet FROM documents),
want AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower({CAMEL_SQL.format(c="query")}), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1)) AS w FROM q),
sc AS (SELECT b.query_id, b.rank AS old, b.doc_id, round(len(list_intersect(w, regexp_extract_all(lower(snippet), '[\p{{L}}\p{{N}}]+'))) / greatest(len(w), 1)::DOUBLE, 6) AS rerank_score FROM bm25 b JOIN snip USING (doc_id) JOIN want USING (query_id) WHERE rank <= 20)
SELECT query_id, rank, doc_id, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM sc) WHERE rank <= 5""")
def rerank_overlap(spark, d):
    asked = benchmark_queries(spark, d)
    hits = search.bm25(read(spark, d, "documents"), asked, 20).join(asked, "query_id").join(read(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet")), "doc_id")
    return search.rerank(hits, search.overlap_score, 5).select("query_id", "rank", "doc_id", "rerank_score")


# -- text, identity, chunks --------------------------------------------------------------------
@query("SELECT doc_id, 'sha256:' || sha256(source || ':' || source || '/' || doc_id || ':1-' || len(string_split(text, chr(10))) || ':' || sha256(text)) AS chunk_id, sha256(text) AS content_hash FROM documents")
def chunk_ids(spark, d):
    t = read(spark, d, "documents")
    h = text.sha256(F.col("text"))
    return t.select("doc_id", text.chunk_id(F.concat_ws("/", "source", "doc_id"), F.lit(1), F.size(F.split("text", "\n")), h, F.col("source")).alias("chunk_id"), h.alias("content_hash"))


@query("SELECT doc_id, CASE WHEN length(text) > 480 THEN rtrim(substr(text, 1, 480), ' ') || '…' ELSE text END AS snippet FROM documents")
def snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(rf"""SELECT page_id, sha256(html || chr(10) || {CAMEL_SQL.format(c="html")} || chr(10) || regexp_replace({CAMEL_SQL.format(c="url")}, '[/._\-]+', ' ', 'g')) AS document_hash FROM pages""")
def fts_document(spark, d):
    return read(spark, d, "pages").select("page_id", text.sha256(text.search_document(F.col("html"), F.col("url"), F.lit(None).cast("string"))).alias("document_hash"))


PATHS = ["src/app/Main.java", "web/index.vue", "Dockerfile", "a/b/Makefile", "README.MD", "x.unknown", "noext", "lib/mod.test.ts", "deep/dir/file.tar.gz", "q.sql"]
LANG_SQL = "CASE " + " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in rules.LANGUAGE_BY_NAME.items()) + " " + " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in rules.LANGUAGE_BY_EXTENSION.items()) + " END"


@query(rf"SELECT path, {LANG_SQL} AS language FROM (SELECT path, string_split(path, '/')[-1] AS name, lower(regexp_extract(string_split(path, '/')[-1], '(\.[^.]+)$', 1)) AS ext FROM (VALUES {values([(p,) for p in PATHS])}) AS t(path))")
def languages_of_paths(spark, d):
    return rows(spark, [(p,) for p in PATHS], "path string").select("path", text.language_of(F.col("path")).alias("language"))


URLS = [("git@github.com:Org/Repo.git", "github.com/org/repo"), ("https://user:tok@Example.com/a/B.git/", "example.com/a/b"), ("ssh://git@host.org/x/y", "host.org/x/y"), ("https://host.org/x/y.git", "host.org/x/y")]


@query(f"SELECT * FROM (VALUES {values(URLS)}) AS t(url, key)")
def repo_keys(spark, d):
    return rows(spark, [(u,) for u, _ in URLS], "url string").select("url", text.repo_key(F.col("url")).alias("key"))


def document_files(spark, d):
    return read(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("rel_path"), F.col("text").alias("content"))


@query("""SELECT source || '/' || doc_id AS rel_path, 'file' AS kind, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INT) AS end_line, sha256(text) AS content_hash FROM documents WHERE length(trim(text)) >= 20 AND length(text) <= 24000""")
def file_chunks(spark, d):
    return C.identified(C.whole_files(document_files(spark, d)).where("kind = 'file'")).select("rel_path", "kind", "start_line", "end_line", "content_hash")


@query()
def file_part_chunks(spark, d):
    return C.identified(C.whole_files(document_files(spark, d), most=2000).where("kind = 'file_part'")).select("rel_path", "kind", "start_line", "end_line", "chunk_id")


@query("SELECT rel_path, CAST(p.place AS INT) AS start_line, p.line AS content FROM (SELECT source || '/' || doc_id AS rel_path, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'place': i, 'line': x})) AS p FROM documents) WHERE trim(p.line) <> ''")
def paragraph_chunks(spark, d):
    return C.paragraphs(document_files(spark, d)).select("rel_path", "start_line", "content")


@query(r"""WITH p AS (SELECT page_id, unnest([{'kind': 'component_script', 'b': regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1)}, {'kind': 'component_style', 'b': regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1)}], recursive := true) FROM pages)
SELECT CAST(page_id AS VARCHAR) AS rel_path, kind, CAST(x.i AS INT) AS nth, x.b AS content, CAST(1 + length(regexp_extract(html, '(?is)^(.*?)<' || substr(kind, 11) || '\b', 1)) - length(replace(regexp_extract(html, '(?is)^(.*?)<' || substr(kind, 11) || '\b', 1), chr(10), '')) AS INT) AS start_line
FROM (SELECT page_id, kind, html, unnest(list_transform(b, lambda y, i: {'i': i, 'b': y})) AS x FROM p JOIN pages USING (page_id))""")
def block_chunks(spark, d):
    return C.tag_blocks(read(spark, d, "pages").select(F.col("page_id").cast("string").alias("rel_path"), F.col("html").alias("content")), ("script", "style")).select("rel_path", "kind", "nth", "content", "start_line")


HEADED = r"regexp_replace(regexp_replace(html, '<h([1-6])[^>]*>', chr(10) || 'H\1 ', 'g'), '</h[1-6]>', chr(10), 'g')"


def headed_pages(spark, d):
    """Pages with their HTML headings as lines of # signs."""
    md = F.col("html")
    for k in range(1, 7):
        md = F.regexp_replace(F.regexp_replace(md, rf"<h{k}[^>]*>", "\n" + "#" * k + " "), rf"</h{k}>", "\n")
    return read(spark, d, "pages").select(F.col("page_id").cast("string").alias("rel_path"), md.alias("content"))


HEAD_SQL = "html"
for _k in range(1, 7):
    HEAD_SQL = f"regexp_replace(regexp_replace({HEAD_SQL}, '<h{_k}[^>]*>', chr(10) || '{'#' * _k} ', 'g'), '</h{_k}>', chr(10), 'g')"


@query(rf"""WITH f AS (SELECT CAST(page_id AS VARCHAR) AS rel_path, string_split({HEAD_SQL}, chr(10)) AS ls FROM pages),
l AS (SELECT rel_path, len(ls) AS n, unnest(list_transform(ls, lambda x, i: {{'i': i, 'x': x}})) AS p FROM f),
h AS (SELECT rel_path, n, p.i AS start_line, length(regexp_extract(p.x, '^(#{{1,6}})\s', 1)) AS level, regexp_extract(p.x, '^#{{1,6}}\s+(.+?)\s*#*\s*$', 1) AS symbol FROM l WHERE regexp_matches(p.x, '^#{{1,6}}\s+\S')),
s AS (SELECT a.rel_path, a.symbol, a.start_line, coalesce(min(b.start_line) - 1, any_value(a.n)) AS end_line FROM h a LEFT JOIN h b ON a.rel_path = b.rel_path AND b.start_line > a.start_line AND b.level <= a.level GROUP BY a.rel_path, a.symbol, a.start_line)
SELECT s.rel_path, symbol, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, sha256(array_to_string(ls[start_line:end_line], chr(10))) AS content_hash FROM s JOIN f USING (rel_path)""")
def heading_chunks(spark, d):
    return C.identified(C.headings(headed_pages(spark, d)).where("kind = 'section'")).select("rel_path", "symbol", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "content_hash")


FEATURE = "Feature: Login\n  text\nBackground:\n  Given x\nScenario: good\n  When y\nScenario Outline: many\n  Examples:\n  | a |\nRule: strict\n  end"
SCENARIOS = [("a.feature", "feature", "Login", 1, 2), ("a.feature", "background", "Login :: ", 3, 4), ("a.feature", "scenario", "Login :: good", 5, 6), ("a.feature", "scenario_outline", "Login :: many", 7, 9), ("a.feature", "rule", "Login :: strict", 10, 11)]


@query(f"SELECT * FROM (VALUES {values(SCENARIOS)}) AS t(rel_path, kind, symbol, start_line, end_line)")
def scenario_chunks(spark, d):
    return C.scenarios(rows(spark, [("a.feature", FEATURE)], "rel_path string, content string")).select("rel_path", "kind", "symbol", "start_line", "end_line")


SOURCE = "import os\n\n@decorated\nclass A:\n    x = 1\n    def f(self):\n        return 1\n    class B:\n        async def g(self): pass\n\ndef top():\n    def inner(): pass\n    return 2\n"
UNITS = [("m.py", "class", "A", 3, 9), ("m.py", "method", "A.f", 6, 7), ("m.py", "class", "A.B", 8, 9), ("m.py", "method", "A.B.g", 9, 9), ("m.py", "function", "top", 11, 13)]


@query(f"SELECT * FROM (VALUES {values(UNITS)}) AS t(rel_path, kind, symbol, start_line, end_line)")
def ast_chunks(spark, d):
    return C.python_chunks(rows(spark, [("m.py", SOURCE)], "rel_path string, content string")).select("rel_path", "kind", "symbol", "start_line", "end_line")


DISPATCHED = [
    ("a.feature", "feature", "Login", 1, 2, None), ("a.feature", "background", "Login :: ", 3, 4, None), ("a.feature", "scenario", "Login :: good", 5, 6, None),
    ("a.feature", "scenario_outline", "Login :: many", 7, 9, None), ("a.feature", "rule", "Login :: strict", 10, 11, None), *((*u, None) for u in UNITS),
    ("r.md", "document", None, 1, 1, None), ("r.md", "section", "One", 2, 5, None), ("r.md", "section", "Two of them", 4, 5, "One"), ("t.txt", "file", None, 1, 1, None),
]


@query(f"SELECT rel_path, kind, symbol, start_line, end_line, parent FROM (VALUES {values(DISPATCHED)}) AS t(rel_path, kind, symbol, start_line, end_line, parent)")
def dispatched_chunks(spark, d):
    files = rows(spark, [("a.feature", "gherkin", FEATURE), ("m.py", "python", SOURCE), ("r.md", "markdown", "intro\n# One\nsome text of it\n## Two of them\nand more text"), ("t.txt", None, "just some plain text, long enough"), ("blank.md", "markdown", " \n ")], "rel_path string, language string, content string")
    made = C.dispatch(files)
    up = made.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("symbol").alias("parent"))
    return made.join(up, "parent_chunk_id", "left").select("rel_path", "kind", "symbol", "start_line", "end_line", "parent")


# -- graph -------------------------------------------------------------------------------------
GRAPH_SQL = """
np AS (SELECT count(*) AS n FROM part),
nodes AS (
  SELECT 'region:' || r_regionkey AS node_id, r_name AS label, 'geo/region.txt' AS source_file, r_regionkey AS line, r_regionkey AS community_id, r_name AS community_label FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'geo/nation.txt', n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'src/tests/supplier_' || s_suppkey % 10 || '.txt', CAST(s_suppkey // 10 AS INT), n_regionkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'part:' || p_partkey, p_name || '.' || p_type || '.k' || p_partkey, 'src/part_' || p_partkey % 50 || '.txt', CAST(p_partkey // 50 AS INT), CAST(p_partkey % 5 AS INT), r_name FROM part JOIN region ON p_partkey % 5 = r_regionkey
),
edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'located_in' AS relation, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS confidence_score FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 'EXTRACTED', 1.0 FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part:' || (p_partkey * f) % n + 1, 'calls', CASE WHEN p_partkey % 5 = 0 THEN 'INFERRED' ELSE 'EXTRACTED' END, 0.5 FROM part, np, (VALUES (7), (11)) AS g(f)
  UNION ALL SELECT 'supplier:' || s_suppkey, 'part:' || (s_suppkey * 13) % n + 1, 'rationale_for', 'EXTRACTED', CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 10 AS DOUBLE) / 10 END FROM supplier, np
  UNION ALL SELECT 'supplier:' || s_suppkey, 'part:' || (s_suppkey % 20) + 1, 'tests', 'EXTRACTED', 1.0 FROM supplier
)"""


def code_graph(spark, d):
    """Nodes and edges of a property graph made of the star schema."""
    t = {n: read(spark, d, n) for n in ("region", "nation", "supplier", "part")}
    for n, df in t.items():
        df.createOrReplaceTempView(f"graph_{n}")
    n_parts = t["part"].count()
    region = t["region"].select("r_regionkey", "r_name")
    node = lambda df, kind, key, label, file, line, cid: df.select(F.concat(F.lit(f"{kind}:"), key).alias("node_id"), label.alias("label"), file.alias("source_file"), line.cast("int").alias("line"), cid.cast("int").alias("community_id"), F.col("r_name").alias("community_label"))
    nation = t["nation"].join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = t["supplier"].join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    part = t["part"].withColumn("n_regionkey", F.col("p_partkey") % 5).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    div = lambda c, k: F.expr(f"{c} div {k}")
    nodes = node(region, "region", "r_regionkey", F.col("r_name"), F.lit("geo/region.txt"), F.col("r_regionkey"), F.col("r_regionkey"))
    nodes = nodes.unionByName(node(nation, "nation", "n_nationkey", F.col("n_name"), F.lit("geo/nation.txt"), F.col("n_nationkey"), F.col("n_regionkey")))
    nodes = nodes.unionByName(node(supplier, "supplier", "s_suppkey", F.col("s_name"), F.concat(F.lit("src/tests/supplier_"), F.col("s_suppkey") % 10, F.lit(".txt")), div("s_suppkey", 10), F.col("n_regionkey")))
    nodes = nodes.unionByName(node(part, "part", "p_partkey", F.concat(F.concat_ws(".", "p_name", "p_type"), F.lit(".k"), "p_partkey"), F.concat(F.lit("src/part_"), F.col("p_partkey") % 50, F.lit(".txt")), div("p_partkey", 50), F.col("n_regionkey")))
    edge = lambda df, s, to, rel, conf, score: df.select(s.alias("source"), to.alias("target"), F.lit(rel).alias("relation"), conf.alias("confidence"), score.cast("double").alias("confidence_score"))
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    sure, one = F.lit("EXTRACTED"), F.lit(1.0)
    edges = edge(t["nation"], named("nation", F.col("n_nationkey")), named("region", F.col("n_regionkey")), "located_in", sure, one)
    edges = edges.unionByName(edge(t["supplier"], named("supplier", F.col("s_suppkey")), named("nation", F.col("s_nationkey")), "located_in", sure, one))
    calls = t["part"].withColumn("f", F.explode(F.array(F.lit(7), F.lit(11))))
    edges = edges.unionByName(edge(calls, named("part", F.col("p_partkey")), named("part", F.col("p_partkey") * F.col("f") % n_parts + 1), "calls", F.when(F.col("p_partkey") % 5 == 0, "INFERRED").otherwise("EXTRACTED"), F.lit(0.5)))
    edges = edges.unionByName(edge(t["supplier"], named("supplier", F.col("s_suppkey")), named("part", F.col("s_suppkey") * 13 % n_parts + 1), "rationale_for", sure, F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 10).cast("double") / 10)))
    edges = edges.unionByName(edge(t["supplier"], named("supplier", F.col("s_suppkey")), named("part", F.col("s_suppkey") % 20 + 1), "tests", sure, one))
    return nodes, edges


STARTS = [(1, "part:3"), (2, "part:14"), (3, "part:21")]
STARTS_SQL = f"starts(query_id, node_id) AS (VALUES {values(STARTS)})"


def starts(spark):
    return rows(spark, STARTS, "query_id int, node_id string")


NAMES = [(1, "EUROPE"), (2, "k7"), (3, "ring"), (4, "nothing at all"), (5, "europe")]


@query(f"""WITH {GRAPH_SQL}, asked(query_id, name) AS (VALUES {values(NAMES)}),
t AS (SELECT query_id, node_id, label, CASE WHEN label = name THEN 0 WHEN ends_with(lower(label), '.' || lower(name)) THEN 1 WHEN contains(lower(label), lower(name)) THEN 2 END AS tier FROM nodes, asked)
SELECT query_id, node_id, label, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 1 THEN -length(label) ELSE length(label) END, node_id) AS n FROM t WHERE tier IS NOT NULL) WHERE n = 1""")
def graph_resolve(spark, d):
    return graph.resolve(code_graph(spark, d)[0], rows(spark, NAMES, "query_id int, name string"))


SPANS_SQL = "spans AS (SELECT f.source_file AS rel_path, f.source_file || '#' || k.k AS chunk_id, k.k * 4 AS start_line, k.k * 4 + 3 + 5 * (k.k % 2) AS end_line, 'span' AS kind, NULL AS symbol FROM (SELECT DISTINCT source_file FROM nodes) f, (VALUES (1), (2), (3), (4)) AS k(k))"


def spans(spark, nodes):
    k = F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))
    return nodes.select("source_file").distinct().withColumn("k", k).select(F.col("source_file").alias("rel_path"), F.concat_ws("#", "source_file", "k").alias("chunk_id"), (F.col("k") * 4).alias("start_line"), (F.col("k") * 4 + 3 + 5 * (F.col("k") % 2)).alias("end_line"))


@query(f"""WITH {GRAPH_SQL}, {SPANS_SQL}, p AS (SELECT node_id, chunk_id, CASE WHEN line BETWEEN start_line AND end_line THEN 0 ELSE 1 END AS outside, CASE WHEN line BETWEEN start_line AND end_line THEN end_line - start_line ELSE start_line END AS span FROM nodes JOIN spans ON source_file = rel_path)
SELECT node_id, chunk_id, outside = 0 AS exact FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY outside, span, chunk_id) AS n FROM p) WHERE n = 1""")
def graph_hydrate(spark, d):
    nodes, _ = code_graph(spark, d)
    return graph.hydrate(nodes, spans(spark, nodes))


NEAR_SQL = "near AS (SELECT chunk_id, node_id, label, community_label, outside FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY outside, far, node_id) AS n FROM (SELECT chunk_id, node_id, label, community_label, CASE WHEN line BETWEEN start_line AND end_line THEN 0 ELSE 1 END AS outside, abs(line - start_line) AS far FROM spans JOIN nodes ON source_file = rel_path)) WHERE n = 1)"


@query(f"WITH {GRAPH_SQL}, {SPANS_SQL}, {NEAR_SQL} SELECT s.chunk_id, '# community: ' || community_label || chr(10) || '# node: ' || label || chr(10) || s.chunk_id AS embedding_text FROM spans s JOIN near USING (chunk_id)")
def enrich_graph(spark, d):
    nodes, _ = code_graph(spark, d)
    own = spans(spark, nodes).select("*", F.lit(None).cast("string").alias("parent_chunk_id"), F.lit("span").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.col("chunk_id").alias("content"))
    return enrich.graph_aware(own, nodes).select("chunk_id", "embedding_text")


@query(rf"""WITH {GRAPH_SQL}, {SPANS_SQL}, {NEAR_SQL} SELECT s.chunk_id, 'fixedText' || chr(10) || 'fixed Text' || chr(10) || regexp_replace({CAMEL_SQL.format(c="rel_path")}, '[/._\-]+', ' ', 'g') || CASE WHEN outside = 0 THEN chr(10) || 'community: ' || community_label || chr(10) || 'node: ' || label ELSE '' END AS document FROM spans s LEFT JOIN near USING (chunk_id)""")
def fts_augment(spark, d):
    nodes, _ = code_graph(spark, d)
    own = spans(spark, nodes).select("*", F.lit("fixedText").alias("content"), F.lit(None).cast("string").alias("symbol"))
    return enrich.augmented_documents(own, nodes)


def reach_sql(step: str, depth: int, limit: int = 100) -> str:
    return f"""WITH RECURSIVE {GRAPH_SQL}, {STARTS_SQL}, step AS ({step}),
walk(query_id, node_id, depth) AS (SELECT query_id, node_id, 0 FROM starts UNION SELECT w.query_id, s.target, w.depth + 1 FROM walk w JOIN step s ON w.node_id = s.source WHERE w.depth < {depth}),
best AS (SELECT query_id, node_id, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT query_id, rank, node_id, depth FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY depth, node_id) AS rank, node_id, depth FROM best WHERE depth > 0) WHERE rank <= {limit}"""


CALLERS_STEP = "SELECT DISTINCT target AS source, source AS target FROM edges WHERE relation = 'calls' AND confidence = 'EXTRACTED'"
RELATED_STEP = "SELECT source, target FROM edges WHERE confidence = 'EXTRACTED' UNION SELECT target, source FROM edges WHERE confidence = 'EXTRACTED'"


def _callers(depth):
    def run(spark, d):
        return graph.callers(code_graph(spark, d)[1], starts(spark), depth)

    run.__name__ = f"callers_depth{depth}"
    return query(reach_sql(CALLERS_STEP, depth))(run)


for _depth in (1, 2, 3):
    _callers(_depth)


@query(reach_sql(RELATED_STEP, 2))
def related_depth2(spark, d):
    return graph.related(code_graph(spark, d)[1], starts(spark), 2)


@query(f"WITH {GRAPH_SQL} SELECT *, count(*) OVER (PARTITION BY query_id) AS size FROM (SELECT community_id AS query_id, row_number() OVER (PARTITION BY community_id ORDER BY label, node_id) AS rank, node_id, label FROM nodes WHERE community_id IN (1, 3)) WHERE rank <= 40")
def community(spark, d):
    return graph.community(code_graph(spark, d)[0], rows(spark, [(1, 1), (3, 3)], "query_id int, community_id int"), 40)


@query(f"WITH {GRAPH_SQL}, {STARTS_SQL} SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY coalesce(confidence_score, 0) DESC, e.source) AS rank, e.source AS node_id, label, coalesce(confidence_score, 0) AS score FROM edges e JOIN starts s ON e.target = s.node_id JOIN nodes n ON n.node_id = e.source WHERE relation = 'rationale_for'")
def rationale(spark, d):
    nodes, edges = code_graph(spark, d)
    return graph.rationale(edges, nodes, starts(spark))


TEST_PATH_SQL = "(" + " OR ".join(f"contains(lower(source_file), '{p}')" for p in rules.NODE_TEST_PATHS) + ")"


@query(f"WITH {GRAPH_SQL}, {STARTS_SQL}, f AS (SELECT DISTINCT query_id, source FROM edges JOIN starts ON target = node_id WHERE confidence = 'EXTRACTED' AND relation IN ('calls', 'references', 'implements', 'tests')) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY label, node_id) AS rank, node_id, label, source_file FROM f JOIN nodes ON source = node_id WHERE {TEST_PATH_SQL}) WHERE rank <= 20")
def tests_for(spark, d):
    nodes, edges = code_graph(spark, d)
    return graph.tests_for(edges, nodes, starts(spark))


FEATURES = [(1, "red gear economy"), (2, "a b"), (3, "EUROPE / asia")]


@query(f"""WITH RECURSIVE {GRAPH_SQL}, features(query_id, feature) AS (VALUES {values(FEATURES)}),
asked AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(replace(feature, '/', ' ')), '\\s+'), lambda t: length(t) >= 3)) AS tokens FROM features),
sc AS (SELECT query_id, node_id, len(list_filter(tokens, lambda t: contains(lower(label), t))) AS score FROM nodes, asked),
entries AS (SELECT * FROM (SELECT query_id, node_id AS entry, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS entry_rank FROM sc WHERE score > 0) WHERE entry_rank <= 5),
step AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM (SELECT DISTINCT source, target FROM edges WHERE relation = 'calls' AND confidence = 'EXTRACTED')) WHERE n <= 8),
walk(query_id, entry, node_id, depth) AS (SELECT query_id, entry, entry, 0 FROM entries UNION SELECT query_id, entry, target, depth + 1 FROM walk JOIN step ON node_id = source WHERE depth < 4),
best AS (SELECT query_id, entry, node_id, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT * FROM (SELECT query_id, entry, entry_rank, node_id, depth, row_number() OVER (PARTITION BY query_id, entry ORDER BY depth, node_id) AS step FROM best JOIN entries USING (query_id, entry)) WHERE step <= 30""")
def trace_feature(spark, d):
    nodes, edges = code_graph(spark, d)
    return graph.trace(edges, nodes, rows(spark, FEATURES, "query_id int, feature string"), max_depth=4)


@query(f"WITH {GRAPH_SQL} SELECT 'nodes' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'communities', count(DISTINCT community_id) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'edges:' || confidence, count(*) FROM edges GROUP BY confidence")
def graph_stats(spark, d):
    return graph.graph_stats(*code_graph(spark, d))


# -- maintenance -------------------------------------------------------------------------------
OLD_NEW = "o AS (SELECT doc_id, source || '/' || doc_id AS rel_path, sha256(text) AS content_hash FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, source || '/' || doc_id AS rel_path, CASE WHEN doc_id % 10 = 1 THEN sha256(text || '!') ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 10 <> 9)"


def old_new(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("rel_path"), "text")
    old = t.where("doc_id % 10 <> 0").select("doc_id", "rel_path", text.sha256(F.col("text")).alias("content_hash"))
    new = t.where("doc_id % 10 <> 9").select("doc_id", "rel_path", text.sha256(F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return old, new


@query(f"WITH {OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE rel_path NOT IN (SELECT rel_path FROM n)")
def upsert_chunks(spark, d):
    return ingest.upsert(*old_new(spark, d), "rel_path")


@query(f"WITH {OLD_NEW} SELECT n.* FROM n LEFT JOIN o ON n.doc_id = o.doc_id AND n.content_hash = o.content_hash AND o.doc_id % 7 <> 0 WHERE o.doc_id IS NULL")
def fresh_skip(spark, d):
    old, new = old_new(spark, d)
    stored = old.select(F.col("doc_id").alias("chunk_id"), "content_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise("hash-64").alias("embedding_model"), F.lit(None).cast("string").alias("enricher_id"))
    return ingest.stale_chunks(new.withColumnRenamed("doc_id", "chunk_id"), stored, "hash-64").select(F.col("chunk_id").alias("doc_id"), "rel_path", "content_hash")


@query("""WITH o AS (SELECT source || '/' || doc_id AS rel_path, CAST(doc_id AS DOUBLE) AS mtime, n_chars AS size_bytes FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT source || '/' || doc_id AS rel_path, CAST(doc_id + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS mtime, n_chars AS size_bytes FROM documents WHERE doc_id % 10 <> 9)
SELECT rel_path, CASE WHEN n.mtime IS NULL THEN 'removed' WHEN o.mtime IS NULL THEN 'new' WHEN n.mtime <> o.mtime OR n.size_bytes <> o.size_bytes THEN 'changed' ELSE 'unchanged' END AS state FROM o FULL JOIN n USING (rel_path)""")
def file_freshness(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("rel_path"), F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size_bytes"), F.lit("noop").alias("enricher_id"), F.lit(None).cast("string").alias("embedder_model"))
    now = t.where("doc_id % 10 <> 9").withColumn("mtime", F.when(F.col("doc_id") % 10 == 1, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return ingest.file_states(now.drop("doc_id"), t.where("doc_id % 10 <> 0").drop("doc_id"))


@query(f"WITH {OLD_NEW} SELECT o.* FROM o WHERE rel_path IN (SELECT rel_path FROM n)")
def stale_evict(spark, d):
    old, new = old_new(spark, d)
    return ingest.evict_unseen(old, new)


DELTA_COLS = "'sha256:' || sha256(rel_path || ':1-1:' || content_hash) AS chunk_id"


@query(f"""WITH {OLD_NEW}, r AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' || doc_id ELSE rel_path END AS rel_path, content_hash FROM o WHERE doc_id % 10 NOT IN (1, 9)),
u AS (SELECT rel_path, content_hash FROM r UNION ALL SELECT rel_path, content_hash FROM n WHERE doc_id % 10 IN (0, 1)) SELECT rel_path, content_hash, {DELTA_COLS} FROM u""")
def delta_apply(spark, d):
    old, new = old_new(spark, d)
    shape = lambda df: df.select("rel_path", "content_hash", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), text.chunk_id(F.col("rel_path"), F.lit(1), F.lit(1), F.col("content_hash")).alias("chunk_id"))
    keyed = old.unionByName(new.where("doc_id % 10 = 0")).select("doc_id", "rel_path")
    kind = F.expr("CASE doc_id % 10 WHEN 0 THEN 'add' WHEN 1 THEN 'modify' WHEN 9 THEN 'delete' WHEN 3 THEN 'rename' END")
    deltas = keyed.select(kind.alias("action"), F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("moved/"), "doc_id")).otherwise(F.col("rel_path")).alias("rel_path"), F.when(F.col("doc_id") % 10 == 3, F.col("rel_path")).alias("old_path")).where("action is not null")
    return ingest.apply_deltas(shape(old), deltas, shape(new)).select("rel_path", "content_hash", "chunk_id")


@query(f"WITH {OLD_NEW}, r AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' || doc_id ELSE rel_path END AS rel_path, content_hash FROM o) SELECT rel_path, {DELTA_COLS} FROM r")
def rename_apply(spark, d):
    old, _ = old_new(spark, d)
    own = old.select("rel_path", "content_hash", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), text.chunk_id(F.col("rel_path"), F.lit(1), F.lit(1), F.col("content_hash")).alias("chunk_id"))
    renames = old.where("doc_id % 10 = 3").select(F.col("rel_path").alias("old_path"), F.concat(F.lit("moved/"), "doc_id").alias("new_path"))
    return ingest.rename_paths(own, renames).select("rel_path", "chunk_id")


@query(f"""WITH {GRAPH_SQL}, a AS (SELECT source, target, relation, confidence FROM edges WHERE hash(source || target) IS NOT NULL AND NOT ends_with(source, '3')), b AS (SELECT source, target, relation, CASE WHEN ends_with(source, '5') THEN 'AMBIGUOUS' ELSE confidence END AS confidence FROM edges WHERE NOT ends_with(source, '4')),
da AS (SELECT DISTINCT * FROM a), db AS (SELECT DISTINCT * FROM b)
SELECT * FROM (SELECT source, target, relation, CASE WHEN da.confidence IS NULL THEN 'added' WHEN db.confidence IS NULL THEN 'deleted' WHEN da.confidence <> db.confidence THEN 'changed' END AS change FROM da FULL JOIN db USING (source, target, relation)) WHERE change IS NOT NULL""")
def graph_diff(spark, d):
    edges = code_graph(spark, d)[1].select("source", "target", "relation", "confidence").distinct()
    old = edges.where(~F.col("source").endswith("3"))
    new = edges.where(~F.col("source").endswith("4")).withColumn("confidence", F.when(F.col("source").endswith("5"), "AMBIGUOUS").otherwise(F.col("confidence")))
    return ingest.graph_diff(old, new.distinct(), ["source", "target", "relation"])


@query("SELECT source AS repo, count(DISTINCT doc_id) AS files, count(*) AS chunks FROM documents GROUP BY source UNION ALL SELECT 'empty', 0, 0")
def list_repos(spark, d):
    own = document_chunks(spark, d).select("repo", "rel_path", "chunk_id")
    return ingest.repo_stats(own, own.select("repo").distinct().unionByName(rows(spark, [("empty",)], "repo string")))


@query("""SELECT metric, count(*) FILTER (w) AS value FROM (SELECT unnest([{'metric': 'chunks', 'w': true}, {'metric': 'orphans', 'w': doc_id % 11 = 0}, {'metric': 'model:hash/' || (64 + doc_id % 2), 'w': true}, {'metric': 'enricher:' || CASE WHEN doc_id % 3 = 0 THEN '(none)' ELSE 'parent' END, 'w': true}], recursive := true) FROM documents) GROUP BY metric""")
def index_stats(spark, d):
    t = read(spark, d, "documents")
    return ingest.index_stats(t.select(F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("repo"), F.lit("hash").alias("embedding_model"), (64 + F.col("doc_id") % 2).alias("embedding_dim"), F.when(F.col("doc_id") % 3 != 0, "parent").alias("enricher_id")))


REPOS_OLD = [("h/a", "t1", "main"), ("h/b", "t1", None)]
REPOS_NEW = [("h/b", "t2", "dev"), ("h/a", "t2", None), ("h/c", "t2", "main")]


@query("SELECT * FROM (VALUES ('h/a', 't1', 'main'), ('h/b', 't1', 'dev'), ('h/c', 't2', 'main')) AS t(normalized_key, first_indexed_at, default_branch)")
def register_repos(spark, d):
    shape = "normalized_key string, first_indexed_at string, default_branch string"
    return ingest.register_repos(rows(spark, REPOS_OLD, shape), rows(spark, REPOS_NEW, shape))


TERMS = [("FSRS", "spaced repetition", ["srs", "scheduler"], "algo"), ("Deck", "a set of cards", [], None), ("Bad", None, [], None)]


@query("SELECT 'glossary:' || substr(sha256(term || ':' || definition), 1, 16) AS chunk_id, term AS symbol, content FROM (VALUES ('FSRS', 'spaced repetition', 'FSRS' || chr(10) || 'Aliases: srs, scheduler' || chr(10) || 'spaced repetition'), ('Deck', 'a set of cards', 'Deck' || chr(10) || 'a set of cards')) AS t(term, definition, content)")
def glossary_chunks(spark, d):
    return ingest.glossary_chunks(rows(spark, TERMS, "term string, definition string, aliases array<string>, category string")).select("chunk_id", "symbol", "content")


@query("SELECT conv_id || '/' || turn AS chunk_id, '# repo: chats' || chr(10) || '# in conversation conv' || conv_id || ' (chats/' || conv_id || ':1)' || chr(10) || text AS embedding_text FROM conversations")
def enrich_parent(spark, d):
    t = read(spark, d, "conversations")
    turns = t.select(F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.concat(F.lit("conv:"), "conv_id").alias("parent_chunk_id"), F.lit("turn").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit("x").alias("rel_path"), F.col("turn").cast("int").alias("start_line"), F.lit("chats").alias("repo"), F.col("text").alias("content"))
    parents = t.select("conv_id").distinct().select(F.concat(F.lit("conv:"), "conv_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_chunk_id"), F.lit("conversation").alias("kind"), F.concat(F.lit("conv"), "conv_id").alias("symbol"), F.concat(F.lit("chats/"), "conv_id").alias("rel_path"), F.lit(1).alias("start_line"), F.lit("chats").alias("repo"), F.lit("").alias("content"))
    return enrich.hierarchical(turns.unionByName(parents)).where("kind = 'turn'").select("chunk_id", "embedding_text")


ANCHOR_ROWS = [(1, "class", "UserController", "x", "src/a.java"), (2, "function", "main", "if __name__ == '__main__':", "pkg/x.py"), (3, "class", "OrderRepository", "@Service", "src/repos/o.java"), (4, "method", "helper", "plain", "lib/z.go"), (5, "class", None, "@Entity", "src/models/y.java")]


@query("SELECT * FROM (VALUES (1, 'controller', 1.8::DOUBLE), (2, 'main', 2.0), (3, 'repository,service', 1.5), (4, '', 1.0), (5, 'entity', 1.6)) AS t(id, patterns, boost)")
def anchors(spark, d):
    own = rows(spark, ANCHOR_ROWS, "id int, kind string, symbol string, content string, rel_path string")
    return enrich.anchors(own).select("id", F.array_join("patterns", ",").alias("patterns"), "boost")


# -- evaluation, costs, routing, cache, streams ---------------------------------------------------
GOLD_SQL = rf"""{Q_BENCH}, {BM25_CTES},
gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
cases AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'third' ELSE '(untagged)' END AS tag FROM (SELECT DISTINCT query_id FROM gold)),
first AS (SELECT b.query_id, min(rank) AS r FROM bm25 b JOIN gold g ON b.query_id = g.query_id AND b.doc_id = g.doc_id WHERE rank <= 10 GROUP BY b.query_id)"""
METRICS = "count(*) AS cases, round(avg(CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr"


def word_trigrams(words):
    """Hashes of each word with the two after it."""
    at = lambda i: F.element_at(words, i)
    return F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))


def held_passages(docs, asked):
    """The pairs of documents and passages that they hold as they are.

    A passage of five or more words meets the documents that hold its second to fourth word in a row
    (words inside it, whatever stands around it); the text decides. Shorter ones meet all documents.
    """
    words = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    long = asked.withColumn("w_", words(F.col("query"))).where(F.size("w_") >= 5)
    anchors = long.select("query_id", "query", F.xxhash64(*(F.element_at("w_", i) for i in (2, 3, 4))).alias("gram"))
    grams = docs.withColumn("w_", words(F.col("text"))).where(F.size("w_") >= 3).select("doc_id", F.explode(F.array_distinct(word_trigrams(F.col("w_")))).alias("gram"))
    met = grams.join(maybe_broadcast(anchors), "gram").select("doc_id", "query_id", "query")
    pairs = met.join(docs, "doc_id").where(F.contains("text", F.col("query"))).select("doc_id", "source", "query_id", "query")
    short = asked.where(F.size(words(F.col("query"))) < 5)
    return pairs.unionByName(pair_all(docs.select("doc_id", "source", "text"), short, "doc_id").where(F.contains("text", F.col("query"))).drop("text"))


def judged(spark, d):
    docs, asked = read(spark, d, "documents").select("doc_id", "source", "text"), benchmark_queries(spark, d)
    pairs = held_passages(docs, asked)
    path = F.concat_ws("/", "source", "doc_id")
    cases = pairs.groupBy("query_id").agg(F.collect_list(path).alias("expected_paths")).select("query_id", "expected_paths", F.array().cast("array<string>").alias("expected_symbols"), F.when(F.col("query_id") % 3 == 0, F.array(F.lit("third"))).alias("tags"))
    hits = search.bm25(docs, asked, 10).join(docs.select("doc_id", path.alias("rel_path"), F.lit(None).cast("string").alias("symbol")), "doc_id")
    return reports.first_hits(cases, hits)


@query(f"WITH {GOLD_SQL} SELECT {METRICS} FROM cases LEFT JOIN first USING (query_id)")
def eval_recall_mrr(spark, d):
    return reports.metrics(judged(spark, d))


@query(f"WITH {GOLD_SQL} SELECT tag, {METRICS} FROM cases LEFT JOIN first USING (query_id) GROUP BY tag")
def eval_by_tag(spark, d):
    return reports.metrics_by_tag(judged(spark, d))


@query("SELECT 'repo' || user_id % 7 AS repo, count(*) AS runs, CAST(sum(event_id % 5) AS BIGINT) AS files, CAST(sum(event_id % 11) AS BIGINT) AS chunks, CAST(sum(event_id % 3) AS BIGINT) AS embedded, CAST(0 AS BIGINT) AS reused, CAST(count(*) AS BIGINT) AS enricher_cache_hits, max(ts) AS last_seen FROM events WHERE event_type <> 'error' GROUP BY 1")
def cost_rollup(spark, d):
    e = read(spark, d, "events").where("event_type <> 'error'")
    log = e.select(F.col("event_type").alias("event"), F.concat(F.lit("repo"), F.col("user_id") % 7).alias("repo"), (F.col("event_id") % 5).alias("files"), (F.col("event_id") % 11).alias("chunks"), (F.col("event_id") % 3).alias("embedded"), F.lit(None).cast("long").alias("reused"), F.lit(1).cast("long").alias("enricher_cache_hits"), F.col("ts").alias("timestamp"))
    return reports.cost(log)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 3600 SECOND AS ended, count(*) AS changes FROM i GROUP BY user_id, island""")
def debounce_sessions(spark, d):
    return watch.debounced(read(spark, d, "events"), "3600 seconds")


@query(SQL["debounce_sessions"])
def stream_sessions(spark, d):
    """The same operator over a stream of the table, run to its end."""
    schema = read(spark, d, "events").schema
    at = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{d}/events.parquet*")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/table")
    found = watch.debounced(src, "3600 seconds", late="30 days")
    q = found.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/table").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


ROUTES = [(1, "what calls the parse_file", "find_callers", "parse_file", 0.9), (2, "tests for Storage.search", "find_tests_for", "Storage.search", 0.9), (3, "show me the Chunker", "get_symbol", "Chunker", 0.9), (4, "how does the retry logic work", "trace_feature", "retry logic", 0.9), (5, "", "search_code", None, 1.0), (6, "best way to cache things in here", "search_code", None, 0.5), (7, "RrfFusion", "get_symbol", "RrfFusion", 0.9), (8, "what relates to Embedder", "find_related", "Embedder", 0.9)]


@query(f"SELECT query_id, query, intent, subject, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES {values(ROUTES)}) AS t(query_id, query, intent, subject, confidence)")
def route_queries(spark, d):
    return intent.route(rows(spark, [r[:2] for r in ROUTES], "query_id int, query string"))


PROMPTS = [("the def of it", "function"), ("an enum type", "class"), ("how it runs", "how"), ("locate it", "where"), ("unit tests", "test"), ("debug this", "error"), ("something", "other")]


@query(f"SELECT * FROM (VALUES {values(PROMPTS)}) AS t(query, kind)")
def prompt_kinds(spark, d):
    return rows(spark, [(p,) for p, _ in PROMPTS], "query string").select("query", intent.prompt_kind(F.col("query")).alias("kind"))


@query("SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda x: CAST(CAST(sign(CAST(x AS DOUBLE)) * floor(abs(CAST(x AS DOUBLE)) * 100 + 0.5) AS INT) AS VARCHAR)), ',') || '|10|lang=en') AS key FROM embeddings")
def cache_keys(spark, d):
    return read(spark, d, "embeddings").select("vec_id", cache.cache_key(F.col("embedding"), F.lit(10), F.lit("lang=en")).alias("key"))


@query("""WITH o AS (SELECT doc_id, n_chars AS m FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS m FROM documents WHERE doc_id % 10 <> 9)
SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS rel_path, CASE WHEN o.m IS NULL THEN 'added' WHEN n.m IS NULL THEN 'removed' WHEN o.m <> n.m THEN 'changed' END AS change FROM o FULL JOIN n USING (doc_id)) WHERE change IS NOT NULL""")
def snapshot_diff(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("rel_path"), F.col("n_chars").alias("mtime"))
    return watch.snapshot_diff(t.where("doc_id % 10 <> 0"), t.where("doc_id % 10 <> 9").withColumn("mtime", F.when(F.col("doc_id") % 10 == 1, F.col("mtime") + 1).otherwise(F.col("mtime"))))


DIFF_LINES = ["M\ta.py", "A\tb.py", "D\tc.py", "R087\told.py\tnew.py", "C100\tx.py\ty.py", "T\tz.py"]
DELTAS = [("modify", "a.py", None, None), ("add", "b.py", None, None), ("delete", "c.py", None, None), ("rename", "new.py", "old.py", 87), ("add", "y.py", None, 100), ("add", "z.py", None, None)]


@query(f"SELECT * FROM (VALUES {values(DELTAS)}) AS t(action, rel_path, old_path, similarity)".replace("NULL)", "0)"))
def change_feed(spark, d):
    feed = sources.parse_name_status(rows(spark, [(x,) for x in DIFF_LINES], "value string"))
    return feed.withColumn("similarity", F.coalesce("similarity", F.lit(0)))


@query()
def hash_embeddings(spark, d):
    return read(spark, d, "documents").select("doc_id", text.hash_embedding(F.col("text")).alias("embedding"))


def _label_rounds(n):
    out = "both_ AS (SELECT source, target FROM e UNION SELECT target, source FROM e), l0 AS (SELECT DISTINCT source AS node_id, source AS community FROM both_)"
    for i in range(n):
        out += f", v{i} AS (SELECT source, community, count(*) AS n FROM both_ JOIN l{i} ON target = node_id GROUP BY ALL), l{i + 1} AS (SELECT source AS node_id, community FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, community DESC) AS k FROM v{i}) WHERE k = 1)"
    return out


@query(f"WITH {GRAPH_SQL}, e AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'located_in'), {_label_rounds(3)} SELECT * FROM l3")
def communities_by_labels(spark, d):
    return graph.label_propagation(code_graph(spark, d)[1].where("relation = 'located_in'"), 3)


@query("SELECT 'conv' || conv_id AS rel_path, turn, role, CASE WHEN length(text) > 480 THEN rtrim(substr(text, 1, 480), ' ') || '…' ELSE text END AS snippet, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations")
def file_outline(spark, d):
    t = read(spark, d, "conversations")
    return ranked(t.select("conv_id", F.concat(F.lit("conv"), "conv_id").alias("rel_path"), "turn", "role", text.snippet(F.col("text")).alias("snippet")), "conv_id", "turn", "role", name="place").drop("conv_id")


from . import queries_engine  # noqa: E402, F401  registers its queries here
