"""Line dedup over levelled sorted runs of line hashes.

``LineIndex`` keeps every line key seen so far as 128-bit hashes with the smallest document that
holds it, in *runs*: Parquet tables bucketed and sorted by hash. A new batch is reduced to its own
keys, merge-anti-joined with the runs (which need no shuffle: both sides meet bucket by bucket)
and what is new becomes a run of level 0. When a level holds ``fan_out`` runs, they are compacted
to one run of the next level, so a key is rewritten at most once per level.

A batch must hold larger ``doc_id`` than the batches before it; ``dedup`` cuts its input so.
A line is dropped where a smaller document holds its key. Since a key that one document alone
holds never meets a smaller document, this is the rule "keys found in two or more documents stay
in the smallest one only".

Defined cases: a null or empty text is one empty line; lines whose key is shorter than
``min_chars`` code points always stay; repeated lines within the smallest document all stay; rows
that repeat a ``doc_id`` count as one document (each is cut by its own lines); rows with a null
``doc_id`` stand last, together as one document; other columns are carried on request, whatever
their names; an empty table gives an empty result. Hashes have 128 bits, so that two keys that
differ are taken for one with a chance below 1e-14 at 1e12 keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, SPACES, UPPER, shared_dir, staged

MIN_CHARS = 10
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second half"), key)


def _document(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("d")


def _same(text: Column) -> Column:
    """Tells rows that repeat a ``doc_id`` apart: of equal texts the same lines go."""
    return F.xxhash64(text).alias("same")


#: Scans of runs report their order (each bucket is one sorted file), so that joins merge them without
#: sorting them again; and no anti-join is pushed below the aggregation of a batch, which would send
#: every copy of a frequent line to one task.
MERGE_SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def merging(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in MERGE_SETTINGS}
    for k, v in MERGE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LineIndex:
    """The levelled runs. ``buckets`` is fixed over an index's life."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_out: int = 3):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.at = f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.select("h1", "h2", "first_doc").repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", f"{self.at}/{name}").saveAsTable(name))
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """``keys`` (h1, h2, first_doc), one row per key: adds those that no run holds."""
        with merging(self.spark):
            run = self._write(self.fresh(keys))
        self._put(run, 0)

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The batch's keys, sorted once, merge-anti-joined with each sorted run in turn."""
        for name in self.runs():
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def _put(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.unionByName(self.spark.table(name))  # keys of different runs differ
            self._put(self._write(merged), level + 1)
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")

    def first(self) -> DataFrame:
        """All keys with the smallest document of each.

        Read by path, not as bucketed tables: then a join shuffles both sides, and adaptive
        execution can split a key that very many documents hold.
        """
        return self.spark.read.schema("h1 long, h2 long, first_doc long").parquet(*(f"{self.at}/{name}" for name in self.runs()))

    def close(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE {name}")


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line that can be dropped: its document, the text's hash, its place (from 0) and hash."""
    lines = docs.select(_document(F.col("doc_id")), _same(F.col("text")), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    keys = lines.select("d", "same", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = _hashes(F.col("key"))
    return keys.select("d", "same", "place", h1.alias("h1"), h2.alias("h2"))


def dedup(docs: DataFrame, batches: int = 4, min_chars: int = MIN_CHARS, fan_out: int = 3) -> DataFrame:
    """The rows of ``docs`` with ``new_text``, ``n_lines`` (before) and ``n_dropped``.

    The documents go through the index in ``batches`` ranges of ``doc_id`` of about equal size.
    """
    spark = docs.sparkSession
    keys = staged(keyed_lines(docs, min_chars), "line-keys")
    index = LineIndex(spark, fan_out=fan_out)
    inner = F.array(F.lit(0.0), *(F.lit(i / batches) for i in range(1, batches)))
    cuts = keys.agg(F.percentile_approx("d", inner, F.lit(1000)).alias("x")).first().x or [0]
    edges = [None, *sorted(set(cuts[1:])), None]
    for low, high in zip(edges, edges[1:]):
        batch = keys
        if low is not None:
            batch = batch.where(F.col("d") >= low)
        if high is not None:
            batch = batch.where(F.col("d") < high)
        index.add(batch.groupBy("h1", "h2").agg(F.min("d").alias("first_doc")))
    # A key's first document keeps it; the others of the documents that hold it drop it.
    late = keys.join(index.first().hint("merge"), ["h1", "h2"]).where(F.col("d") > F.col("first_doc"))
    # A set: rows that repeat an id and a text name the same places, so it is no larger than the text.
    drops = staged(late.groupBy("d", "same").agg(F.collect_set("place").alias("drops")), "line-drops")
    index.close()
    own = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.select(F.struct(*own).alias("row"), _document(F.col("doc_id")), _same(F.col("text")))
    joined = left.join(drops.hint("shuffle_hash"), ["d", "same"], "left").select("row", F.split(F.coalesce("row.text", F.lit("")), "\n").alias("lines"), "drops")
    # Set difference by hashing, in the order of the places: linear in the lines, however many are dropped.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    done = joined.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return done.select("row", F.array_join("kept", "\n").alias("new_text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))
