"""Shard routing as column expressions, and operations on routed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Router = Callable[[Column, int], Column]
MASK = 0x7FFFFFFF


def _code_points(key: Column) -> Column:
    return F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def hashed(key: Column, shards: int) -> Column:
    """31-bit multiply-by-33 XOR hash over code points, modulo shards."""
    step = lambda h, c: (F.shiftleft(h, 5) + h).bitwiseXOR(c).bitwiseAND(F.lit(MASK))
    return (F.aggregate(_code_points(key), F.lit(5381).cast("long"), step) % shards).cast("int")


def prefixed(prefixes: dict[str, int], default: int = 0) -> Router:
    """The first matching prefix, in order of insertion, names the shard; shards beyond the range are moved into it."""

    def route(key: Column, shards: int) -> Column:
        inside = lambda s: F.lit(min(max(s, 0), shards - 1))
        out = None
        for prefix, shard in prefixes.items():
            out = F.when(key.startswith(prefix), inside(shard)) if out is None else out.when(key.startswith(prefix), inside(shard))
        return (inside(default) if out is None else out.otherwise(inside(default))).cast("int")

    return route


def modulo(key: Column, shards: int) -> Column:
    """Trailing digits modulo shards; without digits the sum of UTF-16 units."""
    digits = F.regexp_extract(key, "([0-9]+)$", 1)
    # a character above U+FFFF is two units, which sum up to 0xD800 + 0xDC00 plus both halves of the offset
    units = lambda c: F.when(c < 0x10000, c).otherwise(F.lit(0xD800 + 0xDC00) + F.shiftright(c - 0x10000, 10) + (c - 0x10000).bitwiseAND(F.lit(0x3FF)))
    total = F.aggregate(_code_points(key), F.lit(0).cast("long"), lambda a, c: a + units(c))
    # digit by digit, since a number may have any length
    rest = F.aggregate(_code_points(digits), F.lit(0).cast("long"), lambda a, c: (a * 10 + (c - 48)) % shards)
    return F.when(digits != "", rest).otherwise(total % shards).cast("int")


def with_shard(df: DataFrame, key: str, shards: int, router: Router = hashed, name: str = "shard") -> DataFrame:
    return df.withColumn(name, router(F.col(key).cast("string"), shards))


def write_sharded(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard; a reader with a condition on the shard reads only that folder.

    Rows are rebalanced by shard: small shards share a task, and large ones are split into tasks of the advisory size.
    """
    df.hint("rebalance", F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)


def get(sharded: DataFrame, key: str, value: str, shards: int, router: Router = hashed, shard: str = "shard") -> DataFrame:
    """Point lookup: the shard of the key becomes a partition filter, which the optimizer cannot derive by itself."""
    at = sharded.sparkSession.range(1).select(router(F.lit(value), shards)).first()[0]
    return sharded.filter((F.col(shard) == at) & (F.col(key) == value))


def balance(sharded: DataFrame, shards: int, shard: str = "shard") -> DataFrame:
    """(shard, entries) for every shard, empty ones included."""
    counts = sharded.groupBy(shard).agg(F.count("*").alias("n"))
    every = sharded.sparkSession.range(shards).select(F.col("id").cast("int").alias(shard))
    return every.join(counts, shard, "left").select(shard, F.coalesce("n", F.lit(0)).alias("entries"))


def fan_out(shards: list[DataFrame], each: Callable[[DataFrame], DataFrame], distinct: bool = False) -> DataFrame:
    """Runs a search on every shard and unites the results."""
    out = each(shards[0])
    for s in shards[1:]:
        out = out.unionByName(each(s))
    return out.distinct() if distinct else out
