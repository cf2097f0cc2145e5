"""Rate limiters: ordered folds over each key's requests. Times are integer microseconds, tokens are integers too (millionths),
so that the folds are exact.

In batch a key's requests are gathered and folded inside the JVM. A key whose requests exceed an array (about 10^7) must be
folded as a stream: `limited_stream` keeps only the fold's state for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UNIT = 1_000_000  # a whole token

Step = Callable[[Column, Column], Column]


def _fold(requests: DataFrame, key: str, time: str, order: str, start: Column, step: Step) -> DataFrame:
    """(key, requests, accepted) by a fold whose state has a field `accepted`, over requests in order of (time, order)."""
    each = requests.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(order).alias("o")))).alias("r"))
    return each.select(key, F.size("r").cast("long").alias("requests"), F.aggregate("r", start, step)["accepted"].alias("accepted"))


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def fixed_window(requests: DataFrame, key: str, time: str, order: str, most: int, window_us: int) -> DataFrame:
    """A window starts at the first request after the last one ended, not on a grid."""
    start = F.struct(F.lit(None).cast("long").alias("begun"), _long(0).alias("used"), _long(0).alias("accepted"))

    def step(s: Column, r: Column) -> Column:
        fresh = s["begun"].isNull() | (r["t"] - s["begun"] >= window_us)
        used = F.when(fresh, _long(0)).otherwise(s["used"])
        ok = F.when(used < most, _long(1)).otherwise(_long(0))
        return F.struct(F.when(fresh, r["t"]).otherwise(s["begun"]).alias("begun"), (used + ok).alias("used"), (s["accepted"] + ok).alias("accepted"))

    return _fold(requests, key, time, order, start, step)


def sliding_window(requests: DataFrame, key: str, time: str, order: str, most: int, window_us: int) -> DataFrame:
    """Only accepted requests count, and one exactly as old as the window still does. The state is the last `most` accepted times."""
    start = F.struct(F.array().cast("array<bigint>").alias("times"), _long(0).alias("accepted"))

    def step(s: Column, r: Column) -> Column:
        live = F.filter(s["times"], lambda t: t >= r["t"] - window_us)
        ok = F.size(live) < most
        return F.struct(F.when(ok, F.array_append(live, r["t"])).otherwise(live).alias("times"), (s["accepted"] + F.when(ok, _long(1)).otherwise(_long(0))).alias("accepted"))

    return _fold(requests, key, time, order, start, step)


def token_bucket(requests: DataFrame, key: str, time: str, order: str, capacity: int, per_second: int, cost: int = 1) -> DataFrame:
    """A bucket starts full; a second brings `per_second` tokens, a microsecond as many millionths. Requests that find too few pass by."""
    full = capacity * UNIT
    start = F.struct(F.lit(None).cast("long").alias("last"), _long(full).alias("tokens"), _long(0).alias("accepted"))

    def step(s: Column, r: Column) -> Column:
        tokens = F.least(_long(full), s["tokens"] + (r["t"] - F.coalesce(s["last"], r["t"])) * per_second)
        ok = tokens >= cost * UNIT
        return F.struct(r["t"].alias("last"), (tokens - F.when(ok, _long(cost * UNIT)).otherwise(_long(0))).alias("tokens"), (s["accepted"] + F.when(ok, _long(1)).otherwise(_long(0))).alias("accepted"))

    return _fold(requests, key, time, order, start, step)


def composite(requests: DataFrame, op: str, time: str, order: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """A bucket for each operation of `limits` (capacity, tokens a second): (op, requests, accepted, violations)."""
    out = None
    for name, (capacity, rate) in limits.items():
        part = token_bucket(requests.filter(F.col(op) == name), op, time, order, capacity, rate)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("violations", F.col("requests") - F.col("accepted"))


def _ring_step(full: int, rate: int, most: int) -> Step:
    def step(s: Column, r: Column) -> Column:
        tokens = F.least(_long(full), s["tokens"] + (r["t"] - F.coalesce(s["last"], r["t"])) * rate)
        ok = tokens >= UNIT
        kept = F.slice(F.array_append(s["ring"], r), F.greatest(F.size(s["ring"]) + 2 - most, F.lit(1)), F.lit(most))
        return F.struct(r["t"].cast("long").alias("last"), (tokens - F.when(ok, _long(UNIT)).otherwise(_long(0))).alias("tokens"), F.when(ok, s["ring"]).otherwise(kept).alias("ring"))

    return step


def violations(requests: DataFrame, op: str, time: str, order: str, limits: dict[str, tuple[int, int]], most: int = 500) -> DataFrame:
    """(op, t, o) of the newest `most` rejected requests over all operations, newest first. Each operation's fold keeps as many at most."""
    out = None
    for name, (capacity, rate) in limits.items():
        each = requests.filter(F.col(op) == name).groupBy(op).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(order).alias("o")))).alias("r"))
        start = F.struct(F.lit(None).cast("long").alias("last"), _long(capacity * UNIT).alias("tokens"), F.array().cast(each.schema["r"].dataType).alias("ring"))
        ring = F.aggregate("r", start, _ring_step(capacity * UNIT, rate, most))["ring"]
        part = each.select(op, F.explode(ring).alias("v")).select(op, "v.t", "v.o")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("t"), F.desc("o")).limit(most)


class _Bucket(StatefulProcessor):
    """Token bucket of one key: the last time and the tokens, dropped after `idle_ms` without requests."""

    def __init__(self, capacity: int, per_second: int, idle_ms: int | None):
        self.full, self.rate, self.idle_ms = capacity * UNIT, per_second, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "last bigint, tokens bigint", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        last, tokens = self.state.get() if self.state.exists() else (None, self.full)
        requests = sorted(t for part in rows for t in part["t"].tolist())
        accepted = 0
        for t in requests:
            tokens = min(self.full, tokens + (t - (t if last is None else last)) * self.rate)
            last = t
            if tokens >= UNIT:
                tokens -= UNIT
                accepted += 1
        self.state.update((last, tokens))
        yield pd.DataFrame({"key": [key[0]], "requests": [len(requests)], "accepted": [accepted]})

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, capacity: int, per_second: int, idle_ms: int | None = None) -> DataFrame:
    """(key, requests, accepted) for each key and micro-batch of a stream (key, t)."""
    return requests.groupBy("key").transformWithStateInPandas(statefulProcessor=_Bucket(capacity, per_second, idle_ms), outputStructType="key string, requests bigint, accepted bigint", outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None")


def lru_trace(accesses: DataFrame, group: str, order: str, item: str, capacity: int) -> DataFrame:
    """(group, accesses, hits, evictions) of a least-recently-used cache for each group's accesses; the state is the cached items, oldest first."""
    each = accesses.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("i")))).alias("r"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), _long(0).alias("hits"), _long(0).alias("evictions"))

    def step(s: Column, r: Column) -> Column:
        hit = F.array_contains(s["kept"], r["i"])
        moved = F.array_append(F.array_remove(s["kept"], r["i"]), r["i"])
        over = F.size(moved) > capacity
        return F.struct(F.when(over, F.slice(moved, 2, capacity)).otherwise(moved).alias("kept"), (s["hits"] + hit.cast("long")).alias("hits"), (s["evictions"] + over.cast("long")).alias("evictions"))

    done = F.aggregate("r", start, step)
    return each.select(group, F.size("r").cast("long").alias("accesses"), done["hits"].alias("hits"), done["evictions"].alias("evictions"))
