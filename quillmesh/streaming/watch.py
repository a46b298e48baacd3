"""The change feed as a stream, and the same operators over batches (both must agree)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rel_path, change): added, changed (newer or older mtime), removed."""
    both = before.select("rel_path", F.col("mtime").alias("was")).join(after.select("rel_path", F.col("mtime").alias("now")), "rel_path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("rel_path", change.alias("change")).where(F.col("change").isNotNull())


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str | None = None, key: str = "user_id") -> DataFrame:
    """(key, started, ended, changes): a reindex is due once a key has been quiet; works on batches and streams."""
    src = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    out = src.groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("changes"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes")


def debounced_batch(events: DataFrame, quiet_seconds: int, key: str = "user_id") -> DataFrame:
    """The same as islands of a window, for tables."""
    by = W.partitionBy(key).orderBy("ts")
    gap = F.col("ts").cast("double") - F.lag("ts").over(by).cast("double")
    marked = events.select(key, "ts", F.when(gap.isNull() | (gap >= quiet_seconds), 1).otherwise(0).alias("fresh"))
    islands = marked.withColumn("island", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min("ts").alias("started"), (F.max("ts") + F.expr(f"interval {quiet_seconds} seconds")).alias("ended"), F.count("*").alias("changes")).drop("island")


def maintain(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``apply(batch, id)`` for each micro-batch; with ``once`` it takes what is there and ends."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
