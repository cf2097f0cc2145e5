"""Kept index, codecs, sealed entries, key store, hook outcomes, routing of long numbers, commits at once, the log writer, replayed batches."""

from __future__ import annotations

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import records, routing, search, store
from lodestone.sources import codec
from lodestone.sources.keys import KeyStore
from lodestone.sources.remote import LogSource, committed_parts
from lodestone.streaming import changes, limits

c = F.col


def found(index, query, how="all"):
    return sorted(r.key for r in index.search(query, how).collect())


def test_token_index(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, text string")
    index = search.TokenIndex(spark, str(tmp_path / "index"), 8)
    assert found(index, "red") == []
    index.insert(rows(("a", "red green"), ("b", "red blue"), ("c", None)), "id", "text")
    assert (found(index, "red"), found(index, "red blue"), found(index, "green blue", "any"), found(index, "gr", "prefix"), found(index, "the red"), found(index, "!")) == (["a", "b"], ["b"], ["a", "b"], ["a"], [], [])
    index.insert(rows(("a", "yellow"), ("d", "red")), "id", "text")  # replaces a
    assert found(index, "green") == [] and found(index, "yellow") == ["a"] and found(index, "red") == ["b", "d"]
    index.remove(spark.createDataFrame([("b",)], "key string"))
    assert found(index, "red") == ["d"]
    index.insert(rows(("b", "blue")), "id", "text")
    again = index.rebuild(str(tmp_path / "again"))
    for kept in (index, again):
        assert found(kept, "red") == ["d"] and found(kept, "blue") == ["b"] and found(kept, "re", "prefix") == ["d"]
        assert sorted(map(tuple, kept.live().collect())) == [("blue", "b"), ("red", "d"), ("yellow", "a")]
    assert again._postings().count() == 3 < index._postings().count()
    plan = index.search("yellow")._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0] and "In(token" in plan or "EqualTo(token,yellow)" in plan


def test_search_prefilter_keeps_every_match(spark):
    texts = ["red", "a red-dish", "reddish", "RED", "x_red red", "infrared", "مُرed", "red" + "\u064e", "", None, "ared red2", " ".join(f"w{i}" for i in range(120)) + " red"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    index = search.postings(df, "key", "text")
    for query, how in (("red", "all"), ("red dish", "all"), ("red dish", "any"), ("re", "prefix"), ("redd", "prefix"), ("x_", "prefix")):
        assert sorted(r.key for r in search.search(df, "text", query, how).collect()) == sorted(r.key for r in search.search_keys(index, query, how).collect()), (query, how)


def test_statistics_of_records(spark):
    df = spark.createDataFrame([("a", "foo bar baz"), ("b", "foo qux"), ("c", "the"), ("d", None)], "key string, text string")
    assert search.record_statistics(df, "key", "text").first() == search.index_statistics(search.postings(df, "key", "text")).first()
    assert search.record_statistics(df.filter("false"), "key", "text").first().entries == 0


def test_codecs_shrink_and_return(spark):
    text = "the same words again and again. " * 200
    rows = [(i, x, f) for i, x in enumerate([text.encode(), b"", None, b"short", bytes(range(256))]) for f in (codec.NONE, codec.GZIP, codec.LZ4, codec.DEFLATE)]
    df = spark.createDataFrame([(*r,) for r in rows], "id int, data binary, wanted int")
    packed = df.select("*", codec.compressed(c("data"), c("wanted")).alias("p"))
    for r in packed.select("*", codec.decompressed(c("p.data"), c("p.flag")).alias("back")).collect():
        assert r.back == r.data
        shrinks = r.id == 0 and r.wanted != codec.NONE
        assert r.p.flag == (r.wanted if shrinks else codec.NONE) and (r.data is None or (len(r.p.data) < len(r.data) // 10 if shrinks else r.p.data == r.data))
    gz = packed.filter(f"id = 0 and wanted = {codec.GZIP}").first().p.data
    assert gz[:2] == b"\x1f\x8b"


def test_sealed_entries(spark):
    key, wrong = (F.lit(codec.derived_key(p, b"0123456789abcdef", 10)) for p in ("secret", "other"))
    df = spark.createDataFrame([(i, f"text {i % 2}".encode()) for i in range(20)] + [(20, b"")], "id int, data binary").withColumn("x", codec.sealed(c("data"), key))
    df = spark.createDataFrame(df.collect(), df.schema)  # one draw of salts
    assert df.select(F.substring("x", 1, 16)).distinct().count() == 21
    assert df.filter(codec.opened(c("x"), key) != c("data")).count() == 0
    with pytest.raises(Exception, match="AES|decrypt|tag|CRYPTO"):
        df.select(codec.opened(c("x"), wrong)).collect()
    with pytest.raises(Exception, match="AES|decrypt|tag|CRYPTO"):
        df.select(codec.opened(F.concat(c("x"), F.lit(b"0")), key)).collect()


def test_archive_parts_follow_size(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i}", f"value {i}" * 20) for i in range(100)], "key string, value string")
    assert codec.archive(df, "key", "value").count() == 1 and codec.archive(df.filter("false"), "key", "value").count() == 0
    monkeypatch.setattr(codec, "PART_BYTES", 2000)
    parts = codec.archive(df, "key", "value")
    assert parts.count() > 4
    assert sorted((r.key, r.value.decode()) for r in codec.unarchive(parts).collect()) == sorted(map(tuple, df.collect()))


def test_rotations_count_over_pieces(spark):
    log = spark.createDataFrame([(i, "s" if i % 3 else None, 10 + i % 7) for i in range(1000)], "id long, store string, bytes long")
    due = lambda piece: sorted(map(tuple, codec.rotations(log, "id", "bytes", 50, 777, "store", piece).select("id", "reason", "n", "total").collect()))
    assert due(7) == due(10**6) and len(due(7)) > 20


def test_key_store(tmp_path):
    keys = KeyStore(str(tmp_path / "keys"), archive=2)
    first = keys.get_or_create("main")
    assert keys.get_or_create("main") == first and len(first) == 32 and not keys.exists("other")
    with pytest.raises(KeyError):
        keys.rotate("other")
    pending = keys.rotate("main")
    assert (pending.old, keys.get("main"), keys.get(pending.pending)) == (first, first, pending.new)
    keys.abort(pending)
    assert keys.get("main") == first and not keys.exists(pending.pending)
    for i in range(3):
        pending = keys.rotate("main")
        keys.commit(pending, f"2026-01-0{i + 1}", i, "count")
        assert keys.get("main") == pending.new and not keys.exists(pending.pending)
    assert [e["generation"] for e in keys.history()] == [2, 3]
    assert (tmp_path / "keys").stat().st_mode & 0o077 == 0
    keys.delete("main")
    assert keys.get("main") is None


def test_cancelled_hooks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, value long")
    odd = records.Hook(1, "odd", allow=lambda d: c("value") % 2 == 1)
    double = records.Hook(2, "double", change=lambda d: d.withColumn("value", c("value") * 2))
    with pytest.raises(records.Cancelled) as e:
        records.save_through(df, [odd, double])
    assert e.value.by == {"odd": 1}
    assert sorted(map(tuple, records.save_through(df.filter("key <> 'b'"), [double, odd.__class__(3, "any", allow=lambda d: F.lit(True))]).collect())) == [("a", 2), ("c", 6)]
    assert sorted(map(tuple, records.get_through(df, [odd, double]).collect())) == [("a", 2), ("b", None), ("c", 6)]
    assert sorted(r.key for r in records.delete_through(df, df.filter("key <> 'a'"), [odd]).collect()) == ["a", "b"]


def test_routing_of_long_numbers(spark, tmp_path):
    keys = ["k" + "9" * 45, "7" * 400, "k0", "0012", ""]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: r.m for r in df.select("key", routing.modulo(c("key"), 7).alias("m")).collect()}
    assert got == {keys[0]: int("9" * 45) % 7, keys[1]: int("7" * 400) % 7, "k0": 0, "0012": 12 % 7, "": 0}
    path = str(tmp_path / "shards")
    routing.write_sharded(routing.with_shard(spark.range(500).select(F.concat(F.lit("k"), "id").alias("key")), "key", 5), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 5 and spark.read.parquet(path).count() == 500


def test_commits_at_once(spark, tmp_path):
    """Two transactions that commit at once both count, one after the other."""
    root = str(tmp_path / "table")
    base = store.Transaction(spark, root)
    base.write("a", "0")
    base.write("gone", "0")
    base.commit()
    txs = [store.Transaction(spark, root) for _ in range(3)]
    for i, tx in enumerate(txs):
        tx.write(f"k{i}", str(i))
    txs[0].delete("gone")
    threads = [threading.Thread(target=tx.commit) for tx in txs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(tuple, store.Transaction(spark, root).base().collect())) == [("a", "0"), ("k0", "0"), ("k1", "1"), ("k2", "2")]
    late = store.Transaction(spark, root)
    assert late._point(max(late._pointers()), "x") is False  # a number is taken once
    assert late._point(max(late._pointers()) + 1, "") is True and late.base().count() == 4  # a commit that died before its pointer had content


def test_log_writer(spark, tmp_path):
    spark.dataSource.register(LogSource)
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(f"k{i}", f"é {i}", i) for i in range(50)], "key string, value string, ts bigint").repartition(3)
    save = lambda d, mode: d.write.format("keyed_log").mode(mode).option("path", path).save()
    read = lambda: sorted((r.key, r.value, r.ts) for r in spark.read.schema(df.schema).json([f"{path}/{p}" for p in committed_parts(path)]).collect())
    save(df, "append")
    assert read() == sorted(map(tuple, df.collect()))
    save(df.limit(5), "append")
    assert len(read()) == 55
    with pytest.raises(Exception):
        save(df.withColumn("value", F.raise_error(F.lit("boom")).cast("string")), "append")
    assert len(read()) == 55
    save(df.limit(7), "overwrite")
    assert len(read()) == 7 and len([f for f in (tmp_path / "log").iterdir() if f.name.startswith("part-")]) == len(committed_parts(path))


def test_replayed_batch_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    ttl = spark.createDataFrame([("k1", datetime(2020, 1, 1))], "key string, expire_at timestamp")
    sink = changes.purge_each_batch(out, ttl, lambda: datetime(2026, 1, 1))
    batch = spark.createDataFrame([("k1",), ("k2",)], "key string")
    for number in (0, 0, 1):
        sink(batch, number)
    assert spark.read.parquet(out).groupBy("key").count().collect()[0].asDict() == {"key": "k2", "count": 2}


def test_violation_ring(spark):
    rows = [("a", 0, i) for i in range(20)] + [("b", 0, 100 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "op string, t bigint, o bigint")
    got = limits.violations(df, "op", "t", "o", {"a": (2, 1), "b": (2, 1)}, most=5).collect()
    assert [(r.op, r.o) for r in got] == [("b", 102), ("a", 19), ("a", 18), ("a", 17), ("a", 16)]
