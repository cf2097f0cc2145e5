"""Time to live: records and a table of (key, expire_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_expiry(ttl: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Applies (key, seconds): a positive time sets the expiry, zero clears it."""
    kept = ttl.join(changes.select("key"), "key", "left_anti")
    return kept.unionByName(changes.filter("seconds > 0").select("key", (now + F.make_interval(secs=F.col("seconds"))).alias("expire_at")))


def expired(expire_at: Column, now: Column) -> Column:
    """Strictly before now; no expiry never expires."""
    return F.coalesce(expire_at < now, F.lit(False))


def with_expiry(records: DataFrame, ttl: DataFrame, now: Column) -> DataFrame:
    return records.join(ttl, "key", "left").withColumn("is_expired", expired(F.col("expire_at"), now))


def active(records: DataFrame, ttl: DataFrame, now: Column) -> DataFrame:
    """Purges: an anti-join on the expired keys, whose condition reaches the ttl table's scan."""
    return records.join(ttl.filter(F.col("expire_at") < now).select("key"), "key", "left_anti")


def remaining_seconds(expire_at: Column, now: Column) -> Column:
    return F.greatest(F.timestamp_diff("SECOND", now, expire_at), F.lit(0))
