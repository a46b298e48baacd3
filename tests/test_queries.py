"""Every registered query with an SQL form gives the same rows in DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh import queries as core

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(frame, cols):
    value = lambda v: round(v, 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v.tolist() if hasattr(v, "tolist") else v
    return sorted(tuple(repr(value(v)) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), duck.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert norm(got, cols) == norm(want, cols)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_others_run(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_eval_judges_every_benchmark_row(spark, tmp_path):
    n = 10_050  # beyond the rows that are broadcast
    spark.range(n).selectExpr("id AS item_id", "concat('passage', id, 'x') AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(n).selectExpr("id", "concat('passage', id, 'x') AS text").groupBy((F.col("id") % 50).alias("doc_id")).agg(F.array_join(F.collect_list("text"), " ").alias("text")).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    assert core.QUERIES["eval_recall_mrr"](spark, str(tmp_path)).first().cases == n
    assert sum(r.cases for r in core.QUERIES["eval_by_tag"](spark, str(tmp_path)).collect()) == n


def test_incremental_index_short_files(spark, duck, tmp_path):
    # Of each tenth: too short with and without spaces around it, too short unless words are added, just long enough, long, none.
    texts = ["short", f"  {'x' * 15}  ", "x" * 12, "x" * 19, "x" * 20, f" {'x' * 20} ", "some words\nin two lines", None]
    told = [(c, t, x) for c in (1, 3, 5, 9, 11, None) for t, x in enumerate(texts)]
    spark.createDataFrame(told, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = core.QUERIES["incremental_index"](spark, str(tmp_path)).toPandas(), own.execute(core.SQL["incremental_index"]).df()
    assert len(want) == 12
    assert norm(got, sorted(want.columns)) == norm(want, sorted(want.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
