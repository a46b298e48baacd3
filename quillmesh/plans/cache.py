"""Result cache as a table: key by rounded vector, k and filters; expiry by age; bound by recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(vector: Column, k: Column, filters: Column, places: int = 2) -> Column:
    """sha256 of the vector's components rounded half away from zero, as hundredths, with k and the filters."""
    scale = 10**places
    parts = F.transform(vector, lambda x: (F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double")) * scale + 0.5)).cast("int").cast("string"))
    return F.sha2(F.concat_ws("|", F.array_join(parts, ","), k.cast("string"), F.coalesce(filters, F.lit(""))), 256)


def live(cache: DataFrame, now: Column, ttl_seconds: int = 3600, most: int = 500) -> DataFrame:
    """Entries (key, created_at, used_at, …) younger than the limit, at most ``most`` by last use."""
    young = cache.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") < ttl_seconds)
    return young.orderBy(F.desc("used_at"), "key").limit(most)


def split_hits(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered with the cached columns, still to be run) by key."""
    return asked.join(cache, "key"), asked.join(cache.select("key"), "key", "left_anti")
