"""Registered queries: metrics, routing, transactions, conflicts, expiry, hooks, codecs, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import expiry, metrics, records, reports, routing, store, versions
from ..sources import codec
from ..streaming import changes, limits
from .data import Data, c, query


@query("a1_summary", "SELECT count(*) AS entries, CAST(sum(original_size) AS BIGINT) AS original_bytes, CAST(sum(compressed_size) AS BIGINT) AS compressed_bytes, round(1 - sum(compressed_size)::DOUBLE / sum(original_size), 4) AS compression_ratio, count(*) FILTER (from_cache) AS cache_hits, count(*) FILTER (NOT from_cache) AS cache_misses, round(count(*) FILTER (from_cache)::DOUBLE / count(*), 4) AS cache_hit_ratio, CAST(sum(elapsed_us) // 1000 AS BIGINT) AS elapsed_ms FROM audit", "audit")
def _(d: Data) -> DataFrame:
    return metrics.summary(d.audit())


@query("a1_actions", "SELECT op, count(*) AS n FROM log GROUP BY op", "log")
def _(d: Data) -> DataFrame:
    return d.log().groupBy("op").agg(F.count("*").alias("n"))


@query("a2_recent_errors", "SELECT event_id, op FROM log WHERE is_error ORDER BY ts DESC, event_id DESC LIMIT 20", "log")
def _(d: Data) -> DataFrame:
    return metrics.recent(d.log().filter("is_error"), 20).select("event_id", "op")


@query("a3_ring", "SELECT event_id FROM log ORDER BY ts DESC, event_id DESC LIMIT 1000", "log")
def _(d: Data) -> DataFrame:
    return metrics.ring(d.log(), 1000, "ts", "event_id").select("event_id")


@query("a4_ratio", "SELECT event_id, CASE WHEN original_size <> 0 THEN 1 - compressed_size::DOUBLE / original_size END AS ratio FROM audit", "audit")
def _(d: Data) -> DataFrame:
    return d.audit().select("event_id", metrics.compression_ratio(c("original_size"), c("compressed_size")).alias("ratio"))


BUCKET = "CAST(CASE " + " ".join(f"WHEN us <= {b} THEN {b}" for b in metrics.BOUNDS) + f" ELSE {metrics.OVERFLOW} END AS INTEGER)"


@query("a5_histogram", f"SELECT op, {BUCKET} AS bucket, count(*) AS n FROM log GROUP BY 1, 2", "log")
def _(d: Data) -> DataFrame:
    return metrics.histogram(d.log(), "op", "us")


def _percentile(p: int) -> str:
    return f"(SELECT CASE WHEN min(b) IS NULL THEN t.max_us ELSE min(b) END FROM cum WHERE cum.op = t.op AND upto >= ceil(t.n * {p} / 100.0)) AS p{p}_us"


@query("a6_percentiles", f"WITH h AS (SELECT op, {BUCKET} AS b, count(*) AS n FROM log GROUP BY 1, 2), cum AS (SELECT op, CAST(b AS BIGINT) AS b, sum(n) OVER (PARTITION BY op ORDER BY b) AS upto FROM h WHERE b > 0), t AS (SELECT op, count(*) AS n, sum(us)::DOUBLE / count(*) AS mean_us, min(us) AS min_us, max(us) AS max_us FROM log GROUP BY op) SELECT op, n, mean_us, min_us, max_us, {_percentile(50)}, {_percentile(95)}, {_percentile(99)} FROM t", "log")
def _(d: Data) -> DataFrame:
    return metrics.percentiles(d.log(), "op", "us")


@query("a7_moments", "SELECT count(*) AS n, sum(us)::DOUBLE / count(*) AS mean, min(us) AS min, max(us) AS max FROM log", "log")
def _(d: Data) -> DataFrame:
    return d.log().agg(F.count("*").alias("n"), F.avg("us").alias("mean"), F.min("us").alias("min"), F.max("us").alias("max"))


@query("a8_counters", "SELECT op, count(*) AS n, count(*) FILTER (us > 200000) AS errors, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (us > 200000)::DOUBLE / count(*) AS error_rate FROM log GROUP BY op", "log")
def _(d: Data) -> DataFrame:
    return metrics.counters(d.log(), "op", c("us") > 200000, c("bytes"))


@query("a9_throughput", "SELECT op, round(count(*)::DOUBLE / (max(t) // 1000000 - min(t) // 1000000), 9) AS per_second FROM log GROUP BY op", "log")
def _(d: Data) -> DataFrame:
    seconds = F.floor(F.max("t") / 1_000_000) - F.floor(F.min("t") / 1_000_000)
    return d.log().groupBy("op").agg(F.round(F.count("*") / seconds, 9).alias("per_second"))


@query("a10_delta", "SELECT op, count(*) - count(*) FILTER (event_id < 5000) AS n, CAST(sum(bytes) - coalesce(sum(bytes) FILTER (event_id < 5000), 0) AS BIGINT) AS bytes FROM log GROUP BY op", "log")
def _(d: Data) -> DataFrame:
    snap = lambda df: df.groupBy("op").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return metrics.delta(snap(d.log().filter("event_id < 5000")), snap(d.log()), ["op"], ["n", "bytes"])


@query("a11_rate", "SELECT count(*) FILTER (is_error)::DOUBLE / 86400 AS per_second FROM log WHERE t < 86400000000", "log")
def _(d: Data) -> DataFrame:
    return d.log().filter("t < 86400000000").agg((F.count_if("is_error") / 86400).alias("per_second"))


@query("a12_saved", "SELECT CAST(sum(greatest(original_size - 1500, 0)) AS BIGINT) AS saved FROM audit", "audit")
def _(d: Data) -> DataFrame:
    return d.audit().agg(metrics.saved_bytes(c("original_size"), F.lit(1500)).alias("saved"))


@query("a13_stats", "SELECT count(*) AS writes, CAST(sum(compressed_size) AS BIGINT) AS bytes_written, CAST(sum(greatest(original_size - compressed_size, 0)) AS BIGINT) AS bytes_saved, sum(greatest(original_size - compressed_size, 0))::DOUBLE / CAST(sum(compressed_size) + sum(greatest(original_size - compressed_size, 0)) AS DOUBLE) AS compression_ratio FROM audit WHERE original_size IS NOT NULL", "audit")
def _(d: Data) -> DataFrame:
    return metrics.statistics(d.audit().filter("original_size IS NOT NULL"), "original_size", "compressed_size")


HEALTH = "WITH s AS (SELECT op, count(*) AS reads, count(*) FILTER (from_cache)::DOUBLE / count(*) AS hit_ratio, max(event_id) * 15 AS indexed, count(*) FILTER (us > 100000) AS writes, (count(*) % 10) / 50.0 AS compression_ratio, count(*) * 80 AS entries FROM log GROUP BY op)"


@query("a14_health", HEALTH + " SELECT op, 'LOW_CACHE_HIT_RATIO' AS code, 'warning' AS severity FROM s WHERE reads > 100 AND hit_ratio < 0.5 UNION ALL SELECT op, 'CACHE_OK', 'info' FROM s WHERE reads > 100 AND hit_ratio >= 0.5 UNION ALL SELECT op, 'LARGE_INDEX', 'warning' FROM s WHERE indexed > 100000 UNION ALL SELECT op, 'LOW_COMPRESSION_RATIO', 'warning' FROM s WHERE writes > 50 AND compression_ratio < 0.1 UNION ALL SELECT op, 'EMPTY', 'warning' FROM s WHERE entries = 0 AND writes > 0 UNION ALL SELECT op, 'PARTIAL_INDEX', 'info' FROM s WHERE entries > 0 AND indexed < entries * 0.5", "log")
def _(d: Data) -> DataFrame:
    n = F.count("*")
    stats = d.log().groupBy("op").agg(n.alias("reads"), (F.count_if("from_cache") / n).alias("hit_ratio"), (F.max("event_id") * 15).alias("indexed"), F.count_if(c("us") > 100000).alias("writes"), ((n % 10) / 50).alias("compression_ratio"), (n * 80).alias("entries"))
    return metrics.health(stats.withColumns({"cache_capacity": F.lit(100), "algorithm": F.lit("gzip")})).select("op", "code", "severity")


@query("a16_timing", "SELECT op, sum(us)::DOUBLE / count(*) AS mean_us FROM log GROUP BY op", "log")
def _(d: Data) -> DataFrame:
    return d.log().groupBy("op").agg(F.avg("us").alias("mean_us"))


@query("a17_hit_ratio", "SELECT user_id, count(*) FILTER (from_cache)::DOUBLE / count(*) AS hit_ratio FROM log GROUP BY user_id", "log")
def _(d: Data) -> DataFrame:
    return d.log().groupBy("user_id").agg(metrics.ratio(F.count_if("from_cache"), F.count("*")).alias("hit_ratio"))


@query("a18_grouping_sets", "SELECT op, from_cache, count(*) AS n FROM log GROUP BY CUBE (op, from_cache)", "log")
def _(d: Data) -> DataFrame:
    return d.log().cube("op", "from_cache").agg(F.count("*").alias("n"))


@query("a19_report", "SELECT string_agg(event_id || ' ' || op, chr(10) ORDER BY ts DESC, event_id DESC) AS report FROM (SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 20)", "log")
def _(d: Data) -> DataFrame:
    last = metrics.recent(d.log(), 20).select(F.struct((-c("t")).alias("a"), (-c("event_id")).alias("b"), F.concat_ws(" ", "event_id", "op").alias("line")).alias("e"))
    return last.agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"]), "\n").alias("report"))


@query("s15_audit_json", "SELECT event_id, '{\"event_id\":' || event_id || ',\"op\":\"' || op || '\",\"from_cache\":' || from_cache || '}' AS line FROM audit", "audit")
def _(d: Data) -> DataFrame:
    return d.audit().select("event_id", F.to_json(F.struct("event_id", "op", "from_cache")).alias("line"))


@query("s16_prometheus", "SELECT '# HELP store_operations_total Total operations by type' || chr(10) || '# TYPE store_operations_total counter' || chr(10) || string_agg('store_operations_total{operation=\"' || op || '\"} ' || n, chr(10) ORDER BY op) || chr(10) AS text FROM (SELECT op, count(*) AS n FROM log GROUP BY op)", "log")
def _(d: Data) -> DataFrame:
    return metrics.prometheus(d.log().groupBy("op").agg(F.count("*").alias("n")), "op", "store")


BUCKET_CASE = "CASE " + " ".join(f"WHEN us <= {b} THEN {b}" for b in metrics.BOUNDS) + " END"
AT = "CAST(coalesce(min(b) FILTER (upto >= ceil(total * {} / 100.0)), max(high)) AS BIGINT)"
EXPOSED = f"""WITH b AS (SELECT op, {BUCKET_CASE} AS b, count(*) AS n, max(us) AS most FROM log GROUP BY 1, 2),
u AS (SELECT op, b, sum(n) OVER (PARTITION BY op ORDER BY b NULLS LAST) AS upto, sum(n) OVER (PARTITION BY op) AS total, max(most) OVER (PARTITION BY op) AS high FROM b),
q AS (SELECT op, {AT.format(50)} AS p50, {AT.format(95)} AS p95, {AT.format(99)} AS p99 FROM u GROUP BY op),
s AS (SELECT op, count(*) AS n, CAST(floor(sum(us)::DOUBLE / count(*)) * count(*) AS BIGINT) AS total FROM log GROUP BY op),
x AS (SELECT string_agg('store_operations_total{{operation="' || op || '"}} ' || n, chr(10) ORDER BY op) AS c,
  string_agg('store_latency_microseconds{{operation="' || op || '",quantile="0.5"}} ' || p50 || chr(10) || 'store_latency_microseconds{{operation="' || op || '",quantile="0.95"}} ' || p95 || chr(10) || 'store_latency_microseconds{{operation="' || op || '",quantile="0.99"}} ' || p99 || chr(10)
    || 'store_latency_microseconds_sum{{operation="' || op || '"}} ' || total || chr(10) || 'store_latency_microseconds_count{{operation="' || op || '"}} ' || n, chr(10) ORDER BY op) AS l FROM s JOIN q USING (op))
SELECT '# HELP store_operations_total Total operations by type' || chr(10) || '# TYPE store_operations_total counter' || chr(10) || c || chr(10) || '# HELP store_latency_microseconds Operation latency' || chr(10) || '# TYPE store_latency_microseconds summary' || chr(10) || l || chr(10)
  || '# HELP store_error_rate Current error rate (0-1)' || chr(10) || '# TYPE store_error_rate gauge' || chr(10) || 'store_error_rate ' || (SELECT printf('%.4f', count(*) FILTER (is_error)::DOUBLE / count(*)) FROM log) || chr(10)
  || '# HELP store_uptime_seconds Uptime in seconds' || chr(10) || '# TYPE store_uptime_seconds counter' || chr(10) || 'store_uptime_seconds 42' || chr(10) AS text FROM x"""


@query("s16_exposition", EXPOSED, "log")
def _(d: Data) -> DataFrame:
    return metrics.exposition(d.log(), "op", "us", c("is_error"), "store", 42)


# --- routing ---

DJB2 = "list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT)), lambda a, x: xor((a * 33), x) & 2147483647)"


@query("h1_djb2", "SELECT c_custkey, CAST(" + DJB2.format("c_name") + " % 16 AS INTEGER) AS shard FROM customer")
def _(d: Data) -> DataFrame:
    return d.customer.select("c_custkey", routing.hashed(c("c_name"), 16).alias("shard"))


@query("h2_prefix", "SELECT key, CAST(CASE WHEN starts_with(key, 'order:1') THEN 0 WHEN starts_with(key, 'order:12') THEN 1 WHEN starts_with(key, 'order:2') THEN 3 ELSE 2 END AS INTEGER) AS shard FROM keyed_orders", "keyed_orders")
def _(d: Data) -> DataFrame:
    route = routing.prefixed({"order:1": 0, "order:12": 1, "order:2": 99}, default=2)
    return d.keyed_orders().select("key", route(c("key"), 4).alias("shard"))


@query("h3_modulo", "SELECT c_custkey, CAST(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) % 7 AS INTEGER) AS digits, CAST(list_sum(list_transform(string_split(c_mktsegment, ''), lambda x: unicode(x)::BIGINT)) % 7 AS INTEGER) AS letters FROM customer")
def _(d: Data) -> DataFrame:
    return d.customer.select("c_custkey", routing.modulo(c("c_name"), 7).alias("digits"), routing.modulo(c("c_mktsegment"), 7).alias("letters"))


@query("h4_custom", "SELECT c_custkey, CAST(length(c_name || c_custkey) % 5 AS INTEGER) AS shard FROM customer")
def _(d: Data) -> DataFrame:
    named = d.customer.select("c_custkey", F.concat("c_name", c("c_custkey").cast("string")).alias("key"))
    return routing.with_shard(named, "key", 5, lambda key, n: (F.char_length(key) % n).cast("int")).select("c_custkey", "shard")


@query("h5_fanout", "SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'hold')")
def _(d: Data) -> DataFrame:
    sharded = routing.with_shard(d.customer, "c_name", 4)
    return routing.fan_out([sharded.filter(c("shard") == i) for i in range(4)], lambda s: s.filter(F.lower("c_mktsegment").contains("hold")).select("c_custkey"))


@query("a15_balance", "SELECT CAST(i AS INTEGER) AS shard, count(c_custkey) AS entries FROM range(20) r(i) LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_custkey % 17 END AS s FROM customer) ON s = i GROUP BY 1")
def _(d: Data) -> DataFrame:
    sharded = d.customer.withColumn("shard", F.when(c("c_custkey") % 3 == 0, 1).otherwise(c("c_custkey") % 17).cast("int"))
    return routing.balance(sharded, 20)


# --- transactions ---

LAST = "WITH last AS (SELECT key, arg_max(op, seq) AS op, max_by(struct_pack(v := value), seq).v AS value FROM wal {} GROUP BY key) "


@query("x3_lastop", LAST.format("") + "SELECT key, op, value FROM last", "wal")
def _(d: Data) -> DataFrame:
    return store.last_operations(d.wal())


READ = "SELECT coalesce(a.key, l.key) AS key, CASE WHEN l.op IS NULL THEN a.value ELSE l.value END AS value FROM accounts a FULL JOIN last l ON a.key = l.key WHERE l.op IS NULL OR l.op = 'write'"


@query("x2_read", LAST.format("") + READ, "wal accounts")
def _(d: Data) -> DataFrame:
    return store.read_through(d.accounts(), d.wal())


@query("x4_savepoint", LAST.format("WHERE seq <= 300") + READ, "wal accounts")
def _(d: Data) -> DataFrame:
    return store.read_through(d.accounts(), d.wal(), upto=300)


@query("x5_receipt", "SELECT count(*) FILTER (op = 'write') AS writes, count(*) FILTER (op = 'delete') AS deletes, count(*) AS operations FROM wal", "wal")
def _(d: Data) -> DataFrame:
    return store.receipt(d.wal())


@query("x8_pending", LAST.format("") + "SELECT key, op FROM last", "wal")
def _(d: Data) -> DataFrame:
    return store.pending_keys(d.wal())


# --- conflicts ---

PAIRS = "FROM local l JOIN remote r USING (key)"
LWW, FWW = "CASE WHEN r.ts > l.ts THEN 'B' ELSE 'A' END", "CASE WHEN l.ts < r.ts THEN 'A' ELSE 'B' END"
AHEAD = "(l.a >= r.a AND l.b >= r.b AND l.c >= r.c AND (l.a > r.a OR l.b > r.b OR l.c > r.c))"
BEHIND = "(l.a <= r.a AND l.b <= r.b AND l.c <= r.c AND (l.a < r.a OR l.b < r.b OR l.c < r.c))"


def _pairs(d: Data) -> DataFrame:
    return d.local().select("key", c("v").alias("l")).join(d.remote().select("key", c("v").alias("r")), "key")


for name, sql, resolver in [
    ("c1_lww", LWW, versions.last_write_wins),
    ("c2_fww", FWW, versions.first_write_wins),
    ("c3_remote", "'B'", versions.remote_wins),
    ("c3_local", "'A'", versions.local_wins),
    ("c5_vv", f"CASE WHEN {AHEAD} THEN 'A' WHEN {BEHIND} THEN 'B' ELSE {LWW} END", versions.vector_clock()),
    ("c7_custom", "CASE WHEN l.value >= r.value THEN 'A' ELSE 'B' END", lambda l, r: F.when(l["value"] >= r["value"], l).otherwise(r)),
]:
    query(name, f"SELECT key, {sql} AS winner {PAIRS}", "local remote")(lambda d, resolver=resolver: _pairs(d).select("key", resolver(c("l"), c("r"))["source_id"].alias("winner")))


@query("c4_merge", "SELECT key, r.value AS value, l.ts AS ts, least(l.a, r.a) AS low, r.c AS clock_c FROM local l JOIN remote r USING (key)".replace("least(l.a, r.a)", "r.a"), "local remote")
def _(d: Data) -> DataFrame:
    shape = lambda v: F.struct(c(f"{v}.value").alias("value"), F.struct(c(f"{v}.ts").alias("ts"), F.try_element_at(c(f"{v}.vector_clock"), F.lit("A")).alias("low")).alias("meta"), F.try_element_at(c(f"{v}.vector_clock"), F.lit("C")).alias("clock_c"))
    both = _pairs(d).select("key", shape("l").alias("l"), shape("r").alias("r"))
    merged = versions.merged_struct(c("l"), c("r"), both.schema["l"].dataType, prefer_local=["ts"])
    return both.select("key", merged.alias("m")).select("key", "m.value", "m.meta.ts", "m.meta.low", "m.clock_c")


@query("c4_merge_maps", "SELECT key, l.a AS a, l.b AS b, r.c AS c FROM local l JOIN remote r USING (key)", "local remote")
def _(d: Data) -> DataFrame:
    merged = versions.merged_map(c("l.vector_clock"), c("r.vector_clock"), prefer_local=["A"])
    return _pairs(d).select("key", merged.alias("m")).select("key", *(F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in "ABC"))


@query("c6_deferred", f"SELECT key, l.value AS local_value, r.value AS remote_value {PAIRS} WHERE l.value <> r.value", "local remote")
def _(d: Data) -> DataFrame:
    return versions.deferred(d.local(), d.remote())[1].select("key", c("l.value").alias("local_value"), c("r.value").alias("remote_value"))


@query("c8_detect", f"SELECT key {PAIRS} WHERE l.value IS DISTINCT FROM r.value", "local remote")
def _(d: Data) -> DataFrame:
    return versions.conflicts(d.local().select("key", "v.value"), d.remote().select("key", "v.value")).select("key")


@query("c9_bump", "SELECT key, CAST(2 AS INTEGER) AS version, a, b + 1 AS b FROM local", "local")
def _(d: Data) -> DataFrame:
    bumped = d.local().select("key", versions.bumped(c("v"), "B", c("v.value"), c("v.ts")).alias("v"))
    return bumped.select("key", "v.version", *(F.element_at("v.vector_clock", F.lit(k)).alias(k.lower()) for k in "AB"))


SYNC = f"WITH s AS (SELECT key, CASE WHEN l.value IS NULL THEN 'pulled' WHEN r.value IS NULL THEN 'kept' WHEN l.value = r.value THEN 'same' ELSE 'resolved' END AS outcome, CASE WHEN l.value IS NULL THEN 'B' WHEN r.value IS NULL OR l.value = r.value THEN 'A' ELSE {LWW} END AS winner FROM local l FULL JOIN remote r USING (key)) "


@query("c10_sync", SYNC + "SELECT * FROM s", "local remote")
def _(d: Data) -> DataFrame:
    return versions.sync(d.local(), d.remote(), versions.last_write_wins).select("key", "outcome", c("v.source_id").alias("winner"))


@query("c10_counts", SYNC + "SELECT outcome, count(*) AS n FROM s GROUP BY outcome", "local remote")
def _(d: Data) -> DataFrame:
    return versions.sync(d.local(), d.remote(), versions.last_write_wins).groupBy("outcome").agg(F.count("*").alias("n"))


@query("c11_batches", "SELECT count(*) AS n, true AS bounded FROM local", "local")
def _(d: Data) -> DataFrame:
    each = versions.batches(d.local().select("key"), 100).groupBy("slice", "batch").agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("n"), (F.max("n") <= 100).alias("bounded"))


# --- expiry ---

NOW = "TIMESTAMP '1998-06-01'"


def _now():
    return F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'")


@query("e1_set", f"SELECT key, CAST(epoch_us(CASE WHEN n % 3 = 0 THEN {NOW} + INTERVAL 1 HOUR ELSE expire_at END) AS BIGINT) AS at FROM (SELECT *, CAST(split_part(key, ':', 2) AS BIGINT) AS n FROM expiries) WHERE n % 3 <> 1", "expiries")
def _(d: Data) -> DataFrame:
    n = F.split_part("key", F.lit(":"), F.lit(2)).cast("bigint")
    edits = d.expiries().filter(n % 3 != 2).select("key", F.when(n % 3 == 0, 3600).otherwise(0).alias("seconds"))
    return expiry.set_expiry(d.expiries(), edits, _now()).select("key", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', expire_at)").alias("at"))


@query("e2_expired", f"SELECT key FROM expiries WHERE expire_at < {NOW}", "expiries")
def _(d: Data) -> DataFrame:
    return expiry.with_expiry(d.keyed_orders().select("key"), d.expiries(), _now()).filter("is_expired").select("key")


@query("e2_active", f"SELECT key FROM keyed_orders WHERE key NOT IN (SELECT key FROM expiries WHERE expire_at < {NOW})", "keyed_orders expiries")
def _(d: Data) -> DataFrame:
    return expiry.active(d.keyed_orders().select("key"), d.expiries(), _now())


@query("e3_remaining", f"SELECT key, greatest((epoch_us(expire_at) - epoch_us({NOW})) // 1000000, 0) AS seconds FROM expiries", "expiries")
def _(d: Data) -> DataFrame:
    return d.expiries().select("key", F.greatest(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1998-06-01 00:00:00', expire_at)"), F.lit(0)).alias("seconds"))


# --- hooks and migrations ---


@query("g1_chain", "SELECT c_custkey, '***' AS c_name, c_acctbal, CAST(NULL AS VARCHAR) AS rejected_by FROM customer WHERE c_acctbal >= 0 AND c_custkey % 10 <> 3 UNION ALL SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name ELSE '***' END, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'solvent' ELSE 'ids' END FROM customer WHERE c_acctbal < 0 OR c_custkey % 10 = 3")
def _(d: Data) -> DataFrame:
    hooks = [records.Hook(20, "ids", allow=lambda df: c("c_custkey") % 10 != 3), records.Hook(5, "solvent", allow=lambda df: c("c_acctbal") >= 0), records.Hook(10, "mask", change=lambda df: records.mask(df, ["c_name", "password"]))]
    passed, rejected = records.run_chain(d.customer.select("c_custkey", "c_name", "c_acctbal"), hooks)
    return passed.withColumn("rejected_by", F.lit(None).cast("string")).unionByName(rejected)


@query("g1_get", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def _(d: Data) -> DataFrame:
    return records.get_through(d.customer.select("c_custkey", "c_name", "c_acctbal"), [records.Hook(1, "solvent", allow=lambda df: c("c_acctbal") >= 0)], "c_custkey")


@query("g1_delete", "SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 8 = 0")
def _(d: Data) -> DataFrame:
    customers = d.customer.select("c_custkey")
    return records.delete_through(customers, customers.filter("c_custkey % 4 = 0"), [records.Hook(1, "locked", allow=lambda df: c("c_custkey") % 8 != 0)], "c_custkey")


@query("g2_mask", "SELECT c_custkey, '***' AS c_name FROM customer")
def _(d: Data) -> DataFrame:
    return records.mask(d.customer.select("c_custkey", "c_name"), ["c_name", "ssn"])


@query("g3_validate", "SELECT c_custkey, CASE WHEN segment IS NULL THEN 'segment' END AS failing FROM segments", "segments")
def _(d: Data) -> DataFrame:
    return d.segments().select("c_custkey", records.schema_violation({"c_custkey": "bigint", "segment": "string"}).alias("failing"))


@query("g3_validate_dynamic", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'name' WHEN event_id % 3 = 2 THEN 'age' END AS failing FROM events")
def _(d: Data) -> DataFrame:
    n = c("event_id") % 3
    text = F.when(n == 0, '{"name":"Bob","age":30}').when(n == 1, '{"age":30}').otherwise('{"name":"Bob","age":"30"}')
    kinds = records.variant_types("v", ["name", "age"])
    return d.events.select("event_id", F.parse_json(text).alias("v")).select("event_id", records.schema_violation({"name": "string", "age": "bigint"}, kinds).alias("failing"))


@query("g4_keyname", "SELECT key FROM keyed_orders WHERE regexp_matches(key, ':[1-4]+$')", "keyed_orders")
def _(d: Data) -> DataFrame:
    return d.keyed_orders().filter(records.key_allowed(c("key"), ":[1-4]+$")).select("key")


@query("m1_migrate", "SELECT c_custkey, upper(c_name) AS full_name, c_mktsegment || '-v3' AS segment FROM customer")
def _(d: Data) -> DataFrame:
    steps = [
        records.Migration(2, 3, lambda df: df.withColumn("segment", F.concat("segment", F.lit("-v3")))),
        records.Migration(1, 2, lambda df: df.withColumnsRenamed({"c_name": "full_name", "c_mktsegment": "segment"}).withColumn("full_name", F.upper("full_name"))),
        records.Migration(3, 4, lambda df: df.withColumn("late", F.lit(1))),
    ]
    return records.migrate(d.customer.select("c_custkey", "c_name", "c_mktsegment"), steps, 1, 3)


# --- codecs ---


def _size_case(col: str, kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} < {b} THEN {v}::DOUBLE" if b else f"ELSE {v}::DOUBLE" for b, v in codec.ESTIMATES[kind]) + " END"


@query("z1_autoflag", "SELECT doc_id, CAST(CASE WHEN strlen(text) < 64 THEN 0 WHEN strlen(text) >= 4096 THEN 1 ELSE 2 END AS INTEGER) AS flag FROM documents")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id", codec.auto_flag(F.octet_length("text")).alias("flag"))


@query("z1_roundtrip", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id", F.sha2(codec.inflated(codec.deflated(c("text"))), 256).alias("digest"))


@query("z1_codecs", "SELECT doc_id, sha256(text) AS digest, strlen(text) >= 4096 AS packed_large, true AS no_larger FROM documents")
def _(d: Data) -> DataFrame:
    packed = d.documents.select("doc_id", F.octet_length("text").alias("size"), codec.compressed(c("text"), codec.auto_flag(F.octet_length("text"))).alias("p"))
    # prose of 4 kB and more always shrinks; a text that does not is kept as it is, and the flag says so
    large = (c("size") >= 4096) & (c("p.flag") == codec.GZIP) & (F.octet_length("p.data") < c("size"))
    return packed.select("doc_id", F.sha2(codec.decompressed(c("p.data"), c("p.flag")), 256).alias("digest"), large.alias("packed_large"), (F.octet_length("p.data") <= c("size")).alias("no_larger"))


@query("z2_estimate", "SELECT doc_id, " + ", ".join(f"{_size_case('strlen(text)', k)} AS {k}" for k in codec.ESTIMATES) + " FROM documents")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id", *(codec.estimated_ratio(F.octet_length("text"), k).alias(k) for k in codec.ESTIMATES))


@query("z3_gcm", "SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) + 28 AS INTEGER) AS size FROM documents")
def _(d: Data) -> DataFrame:
    key = F.lit(codec.derived_key("secret", b"0123456789abcdef", 1000))
    coded = codec.encrypted(c("text").cast("binary"), key)
    return d.documents.select("doc_id", coded.alias("x")).select("doc_id", F.sha2(codec.decrypted(c("x"), key), 256).alias("digest"), F.octet_length("x").alias("size"))


@query("z3_sealed", "SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) + 44 AS INTEGER) AS size, true AS own_salt FROM documents")
def _(d: Data) -> DataFrame:
    key = F.lit(codec.derived_key("secret", b"0123456789abcdef", 1000))
    twice = d.documents.select("doc_id", *(codec.sealed(c("text").cast("binary"), key).alias(x) for x in "xy"))
    return twice.select("doc_id", F.sha2(codec.opened(c("x"), key), 256).alias("digest"), F.octet_length("x").alias("size"), (F.substring("x", 1, 16) != F.substring("y", 1, 16)).alias("own_salt"))


@query("z4_cbc_rotated", "SELECT doc_id, sha256(text) AS digest, CAST(16 + (strlen(text) // 16 + 1) * 16 AS INTEGER) AS size FROM documents")
def _(d: Data) -> DataFrame:
    old, new = (F.lit(codec.derived_key(p, b"0123456789abcdef", 1000)) for p in ("old", "new"))
    coded = codec.reencrypted(codec.encrypted(c("text").cast("binary"), old, "CBC"), old, new, "CBC")
    return d.documents.select("doc_id", coded.alias("x")).select("doc_id", F.sha2(codec.decrypted(c("x"), new, "CBC"), 256).alias("digest"), F.octet_length("x").alias("size"))


@query("z5_frame", "SELECT doc_id, true AS valid, false AS broken, CAST(1 AS INTEGER) AS version, sha256(text) AS digest FROM documents")
def _(d: Data) -> DataFrame:
    frame = codec.framed(c("text").cast("binary"), F.lit(codec.NONE), F.lit(codec.PLAIN))
    framed = d.documents.select("doc_id", frame.alias("f"))
    good, bad = codec.parsed(c("f")), codec.parsed(F.concat(F.substring(c("f"), F.lit(1), F.octet_length("f") - 1), F.unhex(F.when(F.hex(F.substring(c("f"), F.octet_length("f"), F.lit(1))) == "00", "01").otherwise("00"))))
    return framed.select("doc_id", good["valid"].alias("valid"), bad["valid"].alias("broken"), good["version"].alias("version"), F.sha2(good["data"], 256).alias("digest"))


@query("z7_rotations", "WITH w AS (SELECT event_id, op, bytes, count(*) OVER p AS n, sum(bytes) OVER p AS total FROM log WINDOW p AS (PARTITION BY op ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, op, CASE WHEN n % 500 = 0 THEN 'count' ELSE 'bytes' END AS reason FROM w WHERE n % 500 = 0 OR total // 400000 > (total - bytes) // 400000", "log")
def _(d: Data) -> DataFrame:
    return codec.rotations(d.log().select("event_id", "op", "bytes"), "event_id", "bytes", 500, 400_000, "op").select("event_id", "op", "reason")


# --- streams and limits ---


@query("st2_watch", "SELECT event_id, user_id FROM events WHERE user_id IN (3, 5, 8)")
def _(d: Data) -> DataFrame:
    return changes.watch_keys(d.events, [3, 5, 8], "user_id").select("event_id", "user_id")


@query("st3_events", "SELECT key, 'saved' AS type, o_orderkey AS ts FROM keyed_orders", "keyed_orders")
def _(d: Data) -> DataFrame:
    return changes.events_of(d.keyed_orders(), "saved", "o_orderkey")


@query("st4_tumbling", "SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, op, count(*) AS n FROM log GROUP BY 1, 2", "log")
def _(d: Data) -> DataFrame:
    return changes.snapshots(d.log(), "ts", "60 minutes", "op").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "op", "n")


SIX_HOURS = 6 * 3600 * 1_000_000
ROWS = "r AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM log)"


@query("st5_fixed", f"WITH RECURSIVE {ROWS}, f(user_id, k, begun, used, accepted) AS (SELECT user_id, k, t, 1::BIGINT, 1::BIGINT FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, CASE WHEN r.t - begun >= {SIX_HOURS} THEN r.t ELSE begun END, CASE WHEN r.t - begun >= {SIX_HOURS} THEN 1 WHEN used < 2 THEN used + 1 ELSE used END, accepted + CASE WHEN r.t - begun >= {SIX_HOURS} OR used < 2 THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1) SELECT user_id, max(k) AS requests, arg_max(accepted, k) AS accepted FROM f GROUP BY user_id", "log")
def _(d: Data) -> DataFrame:
    return limits.fixed_window(d.log(), "user_id", "t", "event_id", 2, SIX_HOURS)


LIVE = f"list_filter(times, lambda x: x >= r.t - {SIX_HOURS})"


@query("st6_sliding", f"WITH RECURSIVE {ROWS}, f(user_id, k, times, accepted) AS (SELECT user_id, k, [t], 1::BIGINT FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, CASE WHEN len({LIVE}) < 2 THEN list_append({LIVE}, r.t) ELSE {LIVE} END, accepted + CASE WHEN len({LIVE}) < 2 THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1) SELECT user_id, max(k) AS requests, arg_max(accepted, k) AS accepted FROM f GROUP BY user_id", "log")
def _(d: Data) -> DataFrame:
    return limits.sliding_window(d.log(), "user_id", "t", "event_id", 2, SIX_HOURS)


HOUR = "t // 3600"  # a bucket that refills one token an hour, in units of an hour


@query("st7_bucket", "WITH RECURSIVE r AS (SELECT user_id, t // 3600 AS t, row_number() OVER (PARTITION BY user_id ORDER BY t // 3600, event_id) AS k FROM log), f(user_id, k, last, tokens, accepted) AS (SELECT user_id, k, t, 2000000::BIGINT, 1::BIGINT FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.t, least(3000000, tokens + r.t - last) - CASE WHEN least(3000000, tokens + r.t - last) >= 1000000 THEN 1000000 ELSE 0 END, accepted + CASE WHEN least(3000000, tokens + r.t - last) >= 1000000 THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1) SELECT user_id, max(k) AS requests, arg_max(accepted, k) AS accepted FROM f GROUP BY user_id", "log")
def _(d: Data) -> DataFrame:
    slow = d.log().withColumn("t", F.floor(c("t") / 3600))
    return limits.token_bucket(slow, "user_id", "t", "event_id", 3, 1)


LIMITS = {"view": (2, 1), "click": (5, 1), "purchase": (3, 1), "signup": (4, 2), "error": (1, 1)}
FULL, RATE = (f"CASE r.op {' '.join(f'WHEN {chr(39)}{op}{chr(39)} THEN {v[i] * unit}' for op, v in LIMITS.items())} END" for i, unit in ((0, 1_000_000), (1, 1)))
REFILLED = f"least({FULL}, tokens + (r.t - last) * {RATE})"
BUCKETS = f"WITH RECURSIVE r AS (SELECT op, t // 3600 AS t, event_id, row_number() OVER (PARTITION BY op ORDER BY t // 3600, event_id) AS k FROM log), f(op, k, t, event_id, last, tokens, ok) AS (SELECT op, k, t, event_id, t, ({FULL} - 1000000)::BIGINT, true FROM r WHERE k = 1 UNION ALL SELECT r.op, r.k, r.t, r.event_id, r.t, {REFILLED} - CASE WHEN {REFILLED} >= 1000000 THEN 1000000 ELSE 0 END, {REFILLED} >= 1000000 FROM f JOIN r ON r.op = f.op AND r.k = f.k + 1) "


@query("st9_composite", BUCKETS + "SELECT op, count(*) AS requests, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS violations FROM f GROUP BY op", "log")
def _(d: Data) -> DataFrame:
    return limits.composite(d.log().withColumn("t", F.floor(c("t") / 3600)), "op", "t", "event_id", LIMITS)


@query("st9_violations", BUCKETS + "SELECT op, t, event_id AS o FROM f WHERE NOT ok ORDER BY t DESC, event_id DESC LIMIT 500", "log")
def _(d: Data) -> DataFrame:
    return limits.violations(d.log().withColumn("t", F.floor(c("t") / 3600)), "op", "t", "event_id", LIMITS)


@query("st12_lru", "WITH RECURSIVE r AS (SELECT user_id, event_id % 5 AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM log), f(user_id, k, kept, hits, evictions) AS (SELECT user_id, k, [i], 0::BIGINT, 0::BIGINT FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, list_append(list_filter(kept, lambda x: x <> r.i), r.i)[-3:], hits + CASE WHEN list_contains(kept, r.i) THEN 1 ELSE 0 END, evictions + CASE WHEN NOT list_contains(kept, r.i) AND len(kept) = 3 THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1) SELECT user_id, max(k) AS accesses, arg_max(hits, k) AS hits, arg_max(evictions, k) AS evictions FROM f GROUP BY user_id", "log")
def _(d: Data) -> DataFrame:
    return limits.lru_trace(d.log().withColumn("item", c("event_id") % 5), "user_id", "event_id", "item", 3)


@query("u_sets", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 400")
def _(d: Data) -> DataFrame:
    users = lambda condition: d.events.filter(condition).select("user_id")
    return users("event_type = 'click'").intersect(users("event_type = 'purchase'")).subtract(users("event_type = 'signup' AND value > 400"))


@query("w_windows", "SELECT event_id, row_number() OVER w AS nth, lag(us) OVER w AS before, sum(us) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS three FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", "log")
def _(d: Data) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return d.log().select("event_id", F.row_number().over(w).cast("long").alias("nth"), F.lag("us").over(w).alias("before"), F.sum("us").over(w.rowsBetween(-2, 0)).alias("three"))


@query("r21_floor", "SELECT product, count(*) AS n FROM movements GROUP BY product", "movements")
def _(d: Data) -> DataFrame:
    return reports.ledger(d.movements()).select("product", "n")
