"""Literal expectations: query builder, search, routing, conflicts, transactions, metrics, expiry, hooks, codecs."""

from __future__ import annotations

import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import query_tokens, tokens
from lodestone.operators import expiry, metrics, records, reports, routing, search, store, versions
from lodestone.plans.query import Query
from lodestone.sources import codec

c = F.col


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("emp:1", "1", "Alice", "Engineering", 95000, "Senior Engineer", True, ("Paris",)), ("emp:2", "2", "Bob", "Engineering", 72000, "Engineer", True, ("Rome",)), ("emp:3", "3", "Charlie", "Sales", 65000, "Account Executive", True, None),
        ("emp:4", "4", "Diana", "Engineering", 110000, "Staff Engineer", True, (None,)), ("emp:5", "5", "Eve", "HR", 58000, "HR Manager", False, ("Paris",)),
    ]
    return spark.createDataFrame(rows, "key string, id string, name string, department string, salary long, role string, active boolean, address struct<city string>")


def ids(df):
    return [int(r.id) for r in df.collect()]


def test_predicates_and_folds(people):
    q = Query()
    assert q.execute(people).total_count() == 5
    assert ids(q.where("department").equals("Engineering").filtered(people)) == [1, 2, 4]
    assert ids(q.where("department").equals("Engineering").and_("salary").greater_than(90000).filtered(people)) == [1, 4]
    assert ids(q.where("department").equals("Sales").or_("department").equals("HR").filtered(people)) == [3, 5]
    # (Sales or Engineering) and salary < 70000: no precedence
    assert ids(q.where("department").equals("Sales").or_("department").equals("Engineering").and_("salary").less_than(70000).filtered(people)) == [3]
    assert ids(q.where("role").contains("senior").filtered(people)) == [1]
    assert ids(q.where("active").equals(False).filtered(people)) == [5]
    assert ids(q.where("address.city").equals("Paris").filtered(people)) == [1, 5]
    assert ids(q.where("address.city").is_null().filtered(people)) == [3, 4]
    assert ids(q.where("address.city.deep").is_null().filtered(people)) == [1, 2, 3, 4, 5]
    assert ids(q.where("salary").equals("95000").filtered(people)) == []
    assert ids(q.where("salary").not_equals("95000").filtered(people)) == [1, 2, 3, 4, 5]
    assert ids(q.where("address.city").less_than("Q").filtered(people)) == [1, 3, 4, 5]
    assert ids(q.where("name").is_in([]).filtered(people)) == []
    assert ids(q.where("missing").is_not_in(["x"]).filtered(people)) == [1, 2, 3, 4, 5]


def test_sort_page_projection(people):
    engineers = Query().where("department").equals("Engineering")
    assert [r.salary for r in engineers.order_by("salary").apply(people).collect()] == [72000, 95000, 110000]
    assert [r.salary for r in engineers.order_by_desc("salary").apply(people).collect()] == [110000, 95000, 72000]
    page = Query().limit(2).execute(people)
    assert (page.records.count(), page.total_count(), page.has_more()) == (2, 5, True)
    assert Query().limit(3).execute(people).next_offset() == 3
    assert not Query().offset(3).limit(2).execute(people).has_more()
    assert Query().key_prefix("emp:").apply(people).count() == 5
    assert Query().select("name", "nothing").exclude("name").apply(people).columns == ["key", "name"]
    assert "salary" not in Query().order_by("salary").exclude("salary").apply(people).columns
    for bad in (lambda: Query().limit(0), lambda: Query().offset(-1)):
        with pytest.raises(ValueError):
            bad()


def test_pushdown(spark, people, tmp_path):
    path = str(tmp_path / "p")
    people.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = Query().where("salary").less_than(70000).select("name").apply(stored).select("name")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(IsNull(salary),LessThan(salary,70000))]" in plan
    assert "ReadSchema: struct<name:string,salary:bigint>" in plan
    top = Query().order_by("salary").limit(2).apply(stored)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top


CORPUS = [("INV-001", "Invoice Ahmed Salim Laptop and Printer"), ("INV-002", "Invoice Mohamed Karim Monitor"), ("CLI-001", "Client Ahmed"), ("CLI-002", "Client Ahlam"), ("E", None)]


def test_search(spark):
    df = spark.createDataFrame(CORPUS, "key string, text string")
    find = lambda q, how="all": sorted(r.key for r in search.search(df, "text", q, how).collect())
    assert find("Ahmed") == ["CLI-001", "INV-001"] and find("Ahmed Laptop") == ["INV-001"] and find("unknown") == []
    assert find("laptop monitor", "any") == ["INV-001", "INV-002"]
    assert find("Ah", "prefix") == ["CLI-001", "CLI-002", "INV-001"] and find("", "prefix") == [] and find("INV-2026", "prefix") == []
    assert find("laptop and") == []  # stop words stay in searches and are never indexed
    index = search.postings(df, "key", "text")
    for q, how in (("Ahmed", "all"), ("laptop monitor", "any"), ("Ah", "prefix")):
        assert sorted(r.key for r in search.search_keys(index, q, how).collect()) == find(q, how)
    two = search.postings(spark.createDataFrame([("a", "foo bar baz"), ("b", "foo qux")], "key string, text string"), "key", "text")
    s = search.index_statistics(two).first()
    assert (s.entries, s.keywords, s.keywords_per_entry) == (2, 4, 2.5)
    one = lambda text: spark.createDataFrame([(text,)], "t string").select(tokens(c("t")).alias("w")).first().w
    assert one("Café the_end X yy") == ["caf", "the_end", "yy"] and one("مُحَمَّد") == ["محمد"] and len(one(" ".join(f"w{i}" for i in range(300)))) == 100
    assert query_tokens("The  THE café") == ["the", "caf"]


def test_routing(spark):
    keys = spark.createDataFrame([("user:42",), ("order:99",), ("product:5",), ("config:app",), ("key0",), ("key4",), ("key1",), ("😀",)], "key string")
    by = {r.key: r for r in keys.select("key", routing.prefixed({"user:": 0, "order:": 1, "product:": 2}, 3)(c("key"), 4).alias("p"), routing.modulo(c("key"), 4).alias("m"), routing.modulo(c("key"), 1000).alias("big"), routing.hashed(c("key"), 2**31).alias("h")).collect()}
    assert [by[k].p for k in ("user:42", "order:99", "product:5", "config:app")] == [0, 1, 2, 3]
    assert [by[k].m for k in ("key0", "key4", "key1")] == [0, 0, 1]
    assert by["user:42"].h == 266915048
    assert by["😀"].big == (0xD83D + 0xDE00) % 1000
    spread = spark.range(100).select(routing.hashed(F.concat(F.lit("key"), c("id").cast("string")), 4).alias("s")).distinct().count()
    assert spread == 4


def test_shard_pruning(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(200).select(F.concat(F.lit("user:"), c("id").cast("string")).alias("key"), "id")
    routing.write_sharded(routing.with_shard(df, "key", 8), path)
    got = routing.get(spark.read.parquet(path), "key", "user:42", 8)
    assert [r.id for r in got.collect()] == [42]
    assert "PartitionFilters: [isnotnull(shard" in got._jdf.queryExecution().toString()


VERSION = "struct<value:string,source_id:string,ts:timestamp,version:int,vector_clock:map<string,int>>"


def test_resolvers(spark):
    t = datetime(2026, 1, 1)
    pair = lambda a, b, later=0, ca=None, cb=None: spark.createDataFrame([(("l", "L", t, 1, ca or {}), ("r", "R", t + timedelta(seconds=later), 1, cb or {}))], f"l {VERSION}, r {VERSION}")
    win = lambda resolver, **k: pair("l", "r", **k).select(resolver(c("l"), c("r"))["value"].alias("v")).first().v
    assert win(versions.last_write_wins) == "l" and win(versions.last_write_wins, later=1) == "r"
    assert win(versions.first_write_wins) == "r" and win(versions.first_write_wins, later=1) == "l"
    vv = versions.vector_clock()
    assert win(vv, ca={"A": 3, "B": 2}, cb={"A": 2, "B": 2}) == "l"
    assert win(vv, ca={"A": 1, "B": 1}, cb={"A": 2, "B": 1}) == "r"
    assert win(vv, ca={"A": 2, "B": 1}, cb={"A": 1, "B": 2}, later=1) == "r"
    assert win(vv, ca={"A": 1}, cb={"A": 1, "B": 0}) == "l"


def test_merges(spark):
    nested = "struct<score:int,address:struct<street:string,city:string,zip:string>>"
    df = spark.createDataFrame([((10, ("Main", "Springfield", None)), (20, (None, "Shelbyville", "1234")))], f"l {nested}, r {nested}")
    kind = df.schema["l"].dataType
    m = df.select(versions.merged_struct(c("l"), c("r"), kind).alias("m")).first().m
    assert m.score == 20 and tuple(m.address) == ("Main", "Shelbyville", "1234")
    assert df.select(versions.merged_struct(c("l"), c("r"), kind, prefer_local=["score"]).alias("m")).first().m.score == 10
    maps = spark.createDataFrame([({"a": 1, "b": None, "c": 3}, {"a": 2, "b": 5, "d": None})], "l map<string,int>, r map<string,int>")
    assert maps.select(versions.merged_map(c("l"), c("r"), ["b"]).alias("m")).first().m == {"a": 2, "b": None, "c": 3, "d": None}
    left = spark.createDataFrame([("k1", "old"), ("k2", "same")], "key string, value string")
    right = spark.createDataFrame([("k1", "new"), ("k2", "same"), ("k3", "x")], "key string, value string")
    assert [r.key for r in versions.conflicts(left, right).collect()] == ["k1"]


def test_transactions(spark, tmp_path):
    root = str(tmp_path / "tx")
    with store.transaction(spark, root) as tx:
        tx.write("a", "1")
        tx.write("b", "1")
        tx.delete("b")
        tx.write("b", "2")
        tx.savepoint("s")
        tx.write("c", "3")
        tx.savepoint("later")
        tx.rollback_to("s")
        assert "later" not in tx.savepoints
    assert {tuple(r) for r in tx.base().collect()} == {("a", "1"), ("b", "2")}
    with pytest.raises(RuntimeError):
        tx.write("z", "1")
    with pytest.raises(RuntimeError):
        tx.rollback()
    with pytest.raises(ZeroDivisionError), store.transaction(spark, root) as failed:
        failed.delete("a")
        assert {tuple(r) for r in failed.read().collect()} == {("b", "2")}
        1 / 0
    again = store.Transaction(spark, root)
    again.write("a", "9")
    again.write("a", "10")
    assert again.commit() == {"writes": 2, "deletes": 0, "operations": 2}
    assert {tuple(r) for r in again.base().collect()} == {("a", "10"), ("b", "2")}


def test_boxes(spark, tmp_path):
    path = str(tmp_path / "box")
    spark.range(3).write.parquet(path)
    boxes = store.Boxes(spark)
    assert boxes.open("numbers", path).count() == 3 and boxes.get_or_open("numbers", path).count() == 3
    with pytest.raises(ValueError):
        boxes.open("numbers", path)
    assert spark.sql("select count(*) as n from numbers").first().n == 3
    boxes.close_all()
    assert boxes.names() == []
    store.compact(spark.range(100).repartition(8), str(tmp_path / "small"), 2)
    assert spark.read.parquet(str(tmp_path / "small")).rdd.getNumPartitions() <= 2


def test_histograms(spark):
    frame = lambda values: spark.createDataFrame([("read", v) for v in values], "op string, us long")
    p = metrics.percentiles(frame([100, 5000, 250]), "op", "us").first()
    assert (p.min_us, p.max_us) == (100, 5000)
    assert metrics.percentiles(frame([1000, 3000]), "op", "us").first().mean_us == 2000
    assert 0 < metrics.percentiles(frame([i * 100 for i in range(1, 101)]), "op", "us").first().p50_us <= 10000
    p = metrics.percentiles(frame([i * 50 for i in range(1, 201)]), "op", "us").first()
    assert p.p99_us >= p.p95_us >= p.p50_us
    assert metrics.percentiles(frame([600_000, 700_000]), "op", "us").first().p50_us == 700_000
    empty = metrics.summary(spark.createDataFrame([], "original_size int, compressed_size int, from_cache boolean, elapsed_us long")).first()
    assert (empty.entries, empty.compression_ratio, empty.cache_hit_ratio) == (0, 0.0, 0.0)


def test_expiry(spark):
    now = F.lit(datetime(2026, 1, 1))
    ttl = spark.createDataFrame([("EXP-1", datetime(2025, 1, 1)), ("EXP-2", datetime(2025, 12, 31)), ("EDGE", datetime(2026, 1, 1)), ("KEEP", datetime(2027, 1, 1))], "key string, expire_at timestamp")
    boxes = spark.createDataFrame([(k,) for k in ("EXP-1", "EXP-2", "EDGE", "KEEP", "NEVER")], "key string")
    assert sorted(r.key for r in expiry.active(boxes, ttl, now).collect()) == ["EDGE", "KEEP", "NEVER"]
    left = {r.key: r.s for r in ttl.select("key", expiry.remaining_seconds(c("expire_at"), now).alias("s")).collect()}
    assert left["EXP-1"] == 0 and left["KEEP"] == 365 * 86400


def test_hooks(spark):
    df = spark.createDataFrame([("Bob", "x", "1")], "name string, password string, ssn string")
    assert tuple(records.mask(df, ["password", "ssn", "other"]).first()) == ("Bob", "***", "***")
    docs = spark.createDataFrame([('{"name":"Bob","age":30,"email":"b"}',), ('{"name":"Bob","age":30}',), ('{"name":"Bob","age":"30","email":"b"}',)], "j string").select(F.parse_json("j").alias("v"))
    kinds = records.variant_types("v", ["name", "age", "email"])
    bad = [r.f for r in docs.select(records.schema_violation({"name": "string", "age": "bigint", "email": "string"}, kinds).alias("f")).collect()]
    assert bad == [None, "email", "age"]


def test_codecs(spark):
    df = spark.createDataFrame([("a" * 5000,), ("tiny",), ("",), (None,)], "t string").select(c("t").cast("binary").alias("b"))
    back = df.select("b", codec.inflated(codec.deflated(F.when(F.octet_length("b") > 100, c("b")))).alias("x")).collect()
    assert back[0].x == back[0].b
    small = df.select(F.octet_length(codec.deflated(c("b"))).alias("n")).collect()
    assert small[0].n < 100 and small[1].n == 4 and small[2].n == 0 and small[3].n is None
    frame = codec.framed(c("b"), F.lit(codec.GZIP), F.lit(codec.GCM))
    parts = codec.parsed(frame)
    rows = df.select(frame.alias("f"), *(v.alias(k) for k, v in parts.items())).collect()
    assert rows[1].f[:7] == b"\x01\x01\x02\x00\x00\x00\x04" and rows[1].valid and (rows[1].compression, rows[1].encryption) == (1, 2)
    assert not spark.createDataFrame([(bytearray(b"\x01\x00"),)], "f binary").select(codec.parsed(c("f"))["valid"].alias("v")).first().v
    now = F.lit(datetime(2026, 1, 31))
    due = lambda created: spark.range(1).select(codec.rotation_due(F.lit(created).cast("timestamp"), now, 30).alias("d")).first().d
    assert due(datetime(2026, 1, 1)) and not due(datetime(2026, 1, 2)) and not due(None)


def test_ledger_never_falls_below_zero(spark):
    rows = [("p", 1, "in", 5.0, datetime(2026, 1, 1)), ("p", 2, "out", 9.0, datetime(2026, 1, 2)), ("p", 3, "in", 2.0, datetime(2026, 1, 3))]
    df = spark.createDataFrame(rows, "product string, id long, type string, quantity double, ts timestamp")
    assert tuple(reports.ledger(df).first()) == ("p", 3, 2)


def test_compression_returns_bytes_that_do_not_shrink(spark):
    raw = [None, b"", b"x", b"short", b"x marks", zlib.compress(b"a"), bytes(range(256)), b"long " * 100]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    back = df.select("i", codec.inflated(codec.deflated(c("b"))).alias("x")).collect()
    assert [None if r.x is None else bytes(r.x) for r in sorted(back)] == raw
