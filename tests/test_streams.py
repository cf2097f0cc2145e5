"""Streams give what the batch forms give; limiters on literal sequences; connectors."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.sources.remote import FolderRemote, LogSource
from lodestone.streaming import changes, limits

c = F.col


def _changes(spark, path):
    start = datetime(2026, 1, 1)
    rows = [(f"k{i % 5}", "saved" if i % 3 else "deleted", start + timedelta(seconds=37 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, type string, ts timestamp")
    df.repartition(4).write.parquet(path)
    return df


def _collect(into):
    return lambda batch, _: into.extend(batch.collect())


def test_watch(spark, tmp_path):
    path = str(tmp_path / "changes")
    df = _changes(spark, path)
    schema = "key string, type string, ts timestamp"
    seen: list = []
    changes.run_available(changes.watch_keys(changes.watch_all(spark, path, schema), ["k1", "k2"]), _collect(seen), str(tmp_path / "c1"))
    assert sorted(seen) == sorted(df.filter("key in ('k1', 'k2')").collect())
    # a restart sees only what is new
    df.limit(3).write.mode("append").parquet(path)
    more: list = []
    changes.run_available(changes.watch_table(changes.watch_all(spark, path, schema), spark.createDataFrame([("k1",), ("k2",)], "key string")), _collect(more), str(tmp_path / "c2"))
    again: list = []
    changes.run_available(changes.watch_keys(changes.watch_all(spark, path, schema), ["k1", "k2"]), _collect(again), str(tmp_path / "c1"))
    assert len(more) == len(seen) + len(again)


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "log")
    df = _changes(spark, path)
    seen: dict = {}
    stream = changes.snapshots(changes.watch_all(spark, path, "key string, type string, ts timestamp"), "ts", "60 seconds", "type", "10 minutes")
    changes.run_available(stream, lambda batch, _: seen.update({(r.window.start, r.type): r.n for r in batch.collect()}), str(tmp_path / "c"), "update")
    want = {(r.window.start, r.type): r.n for r in changes.snapshots(df, "ts", "60 seconds", "type").collect()}
    assert seen == want


def test_purge(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    _changes(spark, path)
    ttl = spark.createDataFrame([("k1", datetime(2020, 1, 1)), ("k2", datetime(2099, 1, 1))], "key string, expire_at timestamp")
    changes.run_available(changes.watch_all(spark, path, "key string, type string, ts timestamp"), changes.purge_each_batch(out, ttl, lambda: datetime(2026, 1, 1)), str(tmp_path / "c"))
    assert {r.key for r in spark.read.parquet(out).select("key").distinct().collect()} == {"k0", "k2", "k3", "k4"}


def _requests(spark, times):
    return spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "key string, t bigint, o bigint")


def test_limiters(spark):
    second = 1_000_000
    accepted = lambda df: df.first().accepted
    # a window begins with a request: 9 s and 11 s share the one begun at 9 s
    times = [0, 1 * second, 9 * second, 11 * second, 12 * second]
    assert accepted(limits.fixed_window(_requests(spark, [9 * second, 11 * second, 12 * second, 19 * second]), "key", "t", "o", 2, 10 * second)) == 3
    assert accepted(limits.sliding_window(_requests(spark, times), "key", "t", "o", 2, 10 * second)) == 4
    # exactly as old as the window still counts
    assert accepted(limits.sliding_window(_requests(spark, [0, 10 * second, 10 * second + 1]), "key", "t", "o", 1, 10 * second)) == 2
    assert accepted(limits.token_bucket(_requests(spark, [0, 0, 0, second, second]), "key", "t", "o", 2, 1)) == 3
    lru = limits.lru_trace(spark.createDataFrame([("g", i, x) for i, x in enumerate("abacbd")], "g string, o bigint, x string"), "g", "o", "x", 2).first()
    assert (lru.hits, lru.evictions) == (1, 3)


def test_limited_stream_keeps_state_between_batches(spark, tmp_path):
    path = str(tmp_path / "requests")
    second = 1_000_000
    for i, times in enumerate(([0, 0, 0], [second, second], [5 * second] * 4)):
        spark.createDataFrame([("a", t) for t in times], "key string, t bigint").coalesce(1).write.mode("append").parquet(path)
    everything = spark.read.parquet(path).withColumn("o", F.monotonically_increasing_id())
    want = limits.token_bucket(everything, "key", "t", "o", 2, 1).first().accepted
    stream = spark.readStream.schema("key string, t bigint").option("maxFilesPerTrigger", 1).parquet(path)
    seen: list = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes.run_available(limits.limited_stream(stream, 2, 1), _collect(seen), str(tmp_path / "c"), "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(seen) == 3 and sum(r.accepted for r in seen) == want == 5


def test_connectors(spark, tmp_path):
    spark.dataSource.register(LogSource)
    df = spark.read.format("keyed_log").option("fetch", "lodestone.sources.remote.sample_log").option("cursor", 5).option("last", 105).load()
    assert df.count() == 100 and df.filter("key = 'key:7'").count() == 10
    remote = FolderRemote(spark, str(tmp_path / "remote"))
    remote.push(df)
    remote.delete_keys(spark.createDataFrame([("key:7", 200)], "key string, ts bigint"))
    assert remote.fetch_since(104).collect()[0].value is None and remote.fetch_since(100).count() == 5


def test_sync(spark, tmp_path):
    from lodestone.sources.sync import sync

    remote = FolderRemote(spark, str(tmp_path / "remote"))
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string, ts bigint")
    remote.push(rows(("a", "remote", 5), ("b", "same", 5), ("c", "old", 3), ("c", "new", 6)))
    local = rows(("a", "local", 9), ("b", "same", 1), ("d", "mine", 2))
    first = sync(local, remote, 0)
    assert {tuple(r) for r in first.merged.collect()} == {("a", "local", 9), ("b", "same", 1), ("c", "new", 6), ("d", "mine", 2)}
    assert (first.pulled, first.resolved, first.pushed, first.cursor) == (1, 1, 0, 6)
    remote.push(rows(("d", None, 8)))
    second = sync(spark.createDataFrame(first.merged.collect()), remote, first.cursor, deletes=True)
    assert {r.key for r in second.merged.collect()} == {"a", "b", "c"} and (second.pushed, second.cursor) == (3, 8)


def test_event_log(spark, tmp_path):
    import time

    from lodestone.sources.sync import EventLog

    path = str(tmp_path / "changes")
    _changes(spark, path)
    log = EventLog()
    spark.streams.addListener(log)
    changes.run_available(changes.watch_all(spark, path, "key string, type string, ts timestamp"), _collect([]), str(tmp_path / "c"))
    for _ in range(50):
        if any(k == "terminated" for k, *_ in log.events):
            break
        time.sleep(0.2)
    spark.streams.removeListener(log)
    assert {"started", "progress", "terminated"} <= {k for k, *_ in log.events} and sum(n for _, _, n in log.events) == 200
