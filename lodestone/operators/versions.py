"""Versioned values: conflicts between two copies of a table, and ways to resolve them.

A version is a struct: value, source_id, ts, version, vector_clock (map of counters). Resolvers are column functions
(local, remote) -> version, so a whole sync is one join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Resolver = Callable[[Column, Column], Column]


def last_write_wins(local: Column, remote: Column) -> Column:
    """A tie keeps the local version."""
    return F.when(remote["ts"] > local["ts"], remote).otherwise(local)


def first_write_wins(local: Column, remote: Column) -> Column:
    """A tie takes the remote version."""
    return F.when(local["ts"] < remote["ts"], local).otherwise(remote)


def remote_wins(local: Column, remote: Column) -> Column:
    return remote


def local_wins(local: Column, remote: Column) -> Column:
    return local


def _leads(a: Column, b: Column) -> Column:
    """Whether clock a is at least b in every counter and above it in one; a missing counter is zero."""
    ahead = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    return F.forall(ahead, lambda d: d >= 0) & F.exists(ahead, lambda d: d > 0)


def vector_clock(fallback: Resolver = last_write_wins) -> Resolver:
    """The version whose clock leads; the fallback decides between equal and concurrent clocks."""

    def resolve(local: Column, remote: Column) -> Column:
        a, b = local["vector_clock"], remote["vector_clock"]
        return F.when(_leads(a, b), local).when(_leads(b, a), remote).otherwise(fallback(local, remote))

    return resolve


def clock_order(a: Column, b: Column) -> Column:
    return F.when(_leads(a, b), "local").when(_leads(b, a), "remote").otherwise("neither")


def merged_struct(local: Column, remote: Column, kind: T.StructType, prefer_local: Iterable[str] = (), prefer_remote: Iterable[str] = (), scalars_local: bool = False) -> Column:
    """Deep merge of two structs: named fields take one side at every level, structs merge field by field, other fields take
    the remote side unless told otherwise. In typed records a null field counts as absent.
    """
    mine, theirs = set(prefer_local), set(prefer_remote)
    fields = []
    for f in kind.fields:
        a, b = local[f.name], remote[f.name]
        if f.name in mine:
            column = F.coalesce(a, b)
        elif f.name in theirs or not isinstance(f.dataType, T.StructType):
            column = F.coalesce(a, b) if scalars_local and f.name not in theirs else F.coalesce(b, a)
        else:
            column = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merged_struct(a, b, f.dataType, mine, theirs, scalars_local))
        fields.append(column.alias(f.name))
    return F.struct(*fields)


def merged_map(local: Column, remote: Column, prefer_local: Iterable[str] = (), scalars_local: bool = False) -> Column:
    """Merge of two maps, where an explicit null is a value and only a missing key is absent."""
    mine = list(prefer_local)
    keep = lambda k: (k.isin(mine) if mine else F.lit(False)) | F.lit(scalars_local)
    pick = lambda k, a, b: F.when(F.map_contains_key(local, k) & (keep(k) | ~F.map_contains_key(remote, k)), a).otherwise(b)
    return F.map_zip_with(local, remote, pick)


def bumped(version: Column, source: str, value: Column, ts: Column) -> Column:
    """The next version written by a source: number and the source's counter one higher."""
    clock = version["vector_clock"]
    count = F.coalesce(F.try_element_at(clock, F.lit(source)), F.lit(0)) + 1
    rest = F.map_filter(clock, lambda k, v: k != source)
    return F.struct(value.alias("value"), F.lit(source).alias("source_id"), ts.alias("ts"), (version["version"] + 1).alias("version"), F.map_concat(rest, F.create_map(F.lit(source), count)).alias("vector_clock"))


def conflicts(local: DataFrame, remote: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys on both sides whose values differ; nulls are equal to nulls."""
    a, b = local.select(key, F.col(value).alias("local_value")), remote.select(key, F.col(value).alias("remote_value"))
    return a.join(b, key).filter(~F.col("local_value").eqNullSafe(F.col("remote_value")))


def sync(local: DataFrame, remote: DataFrame, resolver: Resolver, key: str = "key") -> DataFrame:
    """(key, v, outcome) of one pull: both sides' versions `v` meet in one full outer join.

    pulled: only remote; kept: only local; same: equal values; resolved: the resolver chose. The first three go back to the
    remote side unchanged, a push writes the rest.
    """
    both = local.select(key, F.col("v").alias("l")).join(remote.select(key, F.col("v").alias("r")), key, "full_outer")
    l, r = F.col("l"), F.col("r")
    outcome = F.when(l.isNull(), "pulled").when(r.isNull(), "kept").when(l["value"].eqNullSafe(r["value"]), "same").otherwise("resolved")
    chosen = F.when(l.isNull(), r).when(r.isNull() | l["value"].eqNullSafe(r["value"]), l).otherwise(resolver(l, r))
    return both.select(key, chosen.alias("v"), outcome.alias("outcome"))


def deferred(local: DataFrame, remote: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The local side stays; differing pairs go to a queue (key, l, r)."""
    queue = local.select(key, F.col("v").alias("l")).join(remote.select(key, F.col("v").alias("r")), key).filter(~F.col("l.value").eqNullSafe(F.col("r.value")))
    return local, queue


def batches(df: DataFrame, size: int, key: str = "key", spread: int = 64) -> DataFrame:
    """Numbers rows into batches of `size` for a push, in order of key within `spread` slices: (slice, batch).

    Numbering inside hashed slices needs no global sort; only the last batch of a slice is short.
    """
    at = Window.partitionBy("slice").orderBy(key)
    return df.withColumn("slice", F.pmod(F.hash(key), F.lit(spread))).withColumn("batch", F.floor((F.row_number().over(at) - 1) / size))
