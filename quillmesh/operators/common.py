"""Joins with a small side, per-query ranks and materialised steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows (counted, not estimated).
BROADCAST_ROWS = 10_000


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pair_all(left: DataFrame, right: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` (a stated set, such as queries).

    A right side of checked size is broadcast; a larger one is repeated over salted groups, which
    is an equi-join that spreads evenly and keeps both sides on disk.
    """
    if right.limit(rows + 1).count() <= rows:
        return left.crossJoin(F.broadcast(right))
    groups = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = left.withColumn("salt_", F.pmod(F.xxhash64(key), F.lit(groups)))
    repeated = right.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return salted.join(repeated, "salt_").drop("salt_")


def containing(texts: DataFrame, needles: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows of ``texts`` joined with the rows of ``needles`` whose ``needle`` the lower-cased ``column`` holds.

    A needle of three or more characters meets only the texts that hold its first three (an equi-join,
    then the test); shorter ones meet every text.
    """
    low = needles.withColumn("needle_", F.lower(needle))
    size = F.length("needle_")
    n = low.agg(F.count_if(size >= 3), F.count_if(size < 3)).first()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(column) - 2), lambda i: F.substring(F.lower(F.col(column)), i, F.lit(3))))
    some = texts.where(F.length(column) >= 3).withColumn("gram_", F.explode(grams))
    long = low.where(size >= 3).withColumn("gram_", F.substring("needle_", 1, 3))
    met = some.join(F.broadcast(long) if n[0] <= BROADCAST_ROWS else long, "gram_")  # counted above
    found = met.where(F.contains(F.lower(column), F.col("needle_"))).drop("gram_", "needle_")
    if not n[1]:
        return found
    return found.unionByName(pair_all(texts, low.where(size < 3), column).where(F.contains(F.lower(column), F.col("needle_"))).drop("needle_"))


def ranked(df: DataFrame, by: str | list[str], *order: Column | str, k: int | None = None, name: str = "rank") -> DataFrame:
    """Numbers rows from 1 within ``by``; with ``k`` only the first k (pruned before the shuffle)."""
    keys = [by] if isinstance(by, str) else by
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillmesh-")  # local tests: one process, one disk
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of an iterative step with a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
