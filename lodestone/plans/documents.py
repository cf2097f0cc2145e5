"""Registered queries: predicates and pages, keyed tables, token search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import routing, search, store
from ..sources import codec
from .data import Data, c, placed, query
from .query import Query, first_match, open_range, scalar_records, search_fields

ORDER = "SELECT key, o_orderkey, o_totalprice FROM keyed_orders WHERE "


def _orders(d: Data, q: Query) -> DataFrame:
    return q.apply(d.keyed_orders()).select("key", "o_orderkey", "o_totalprice")


def _items(d: Data, q: Query) -> DataFrame:
    return q.filtered(d.items())


def flagship(d: Data) -> DataFrame:
    """Key prefix, left-folded conditions, sort, page, projection."""
    q = Query().key_prefix("order:1").where("o_orderstatus").equals("O").or_("o_orderpriority").equals("1-URGENT").and_("o_totalprice").greater_than(100000)
    return q.order_by_desc("o_totalprice").offset(5).limit(20).select("o_orderkey", "o_totalprice", "o_orderstatus").apply(d.keyed_orders())


query("flagship", "SELECT key, o_orderkey, o_totalprice, o_orderstatus FROM keyed_orders WHERE starts_with(key, 'order:1') AND (o_orderstatus = 'O' OR o_orderpriority = '1-URGENT') AND o_totalprice > 100000 ORDER BY o_totalprice DESC, key LIMIT 20 OFFSET 5", "keyed_orders")(flagship)

ITEM = "SELECT * FROM items WHERE "
for name, sql, test in [
    ("p_eq", ORDER + "status = 'O'", lambda q: q.where("status").equals("O")),
    ("p_eq_null", ORDER + "status IS NULL", lambda q: q.where("status").equals(None)),
    ("p_ne_null", ORDER + "status IS DISTINCT FROM 'O'", lambda q: q.where("status").not_equals("O")),
    ("p_in_null", ORDER + "status IN ('F') OR status IS NULL", lambda q: q.where("status").is_in(["F", None])),
    ("p_notin", ORDER + "status IS NULL OR status NOT IN ('F')", lambda q: q.where("status").is_not_in(["F"])),
    ("p_notin_null", ORDER + "status IS NOT NULL AND status NOT IN ('F')", lambda q: q.where("status").is_not_in(["F", None])),
    ("p_isnull", ORDER + "status IS NULL", lambda q: q.where("status").is_null()),
    ("p_isnotnull", ORDER + "status IS NOT NULL", lambda q: q.where("status").is_not_null()),
    ("p_missing_field", ORDER + "true", lambda q: q.where("nothing.here").is_null()),
    ("p_between", ORDER + "o_totalprice BETWEEN 100000 AND 200000", lambda q: q.where("o_totalprice").between(100000, 200000)),
    ("p_between_open", ORDER + "o_totalprice <= 50000", lambda q: q.where("o_totalprice").between(None, 50000)),
    ("p_regex_null", ORDER + "regexp_matches(coalesce(status, ''), '(?i)^(o|$)')", lambda q: q.where("status").matches("^(o|$)")),
    ("p_leftfold", ORDER + "((status = 'O' OR o_totalprice > 400000) AND o_orderpriority = '2-HIGH') OR o_orderkey = 3", lambda q: q.where("status").equals("O").or_("o_totalprice").greater_than(400000).and_("o_orderpriority").equals("2-HIGH").or_("o_orderkey").equals(3)),
    ("p_mixed_types", ORDER + "CAST(o_orderkey AS VARCHAR) > '5' AND o_orderkey IS NOT NULL", lambda q: q.where("o_orderkey").greater_than("5").and_("o_orderkey").not_equals("7")),
    ("p_keyprefix", ORDER + "starts_with(key, 'order:12')", lambda q: q.key_prefix("order:12")),
    ("p_page", ORDER + "o_totalprice > 1000 ORDER BY o_totalprice, key LIMIT 10 OFFSET 30", lambda q: q.where("o_totalprice").greater_than(1000).order_by("o_totalprice").offset(30).limit(10)),
]:
    query(name, sql, "keyed_orders")(lambda d, test=test: _orders(d, test(Query())))

PLACED = "SELECT key, o_orderkey, o_totalprice, row_number() OVER (ORDER BY {}) - 1 AS place FROM keyed_orders"
for name, order, test in [
    ("p_multisort", "o_orderpriority, o_totalprice DESC, key", lambda q: q.order_by("o_orderpriority").then_by_desc("o_totalprice")),
    ("p_sort_nulls", "status NULLS FIRST, key", lambda q: q.order_by("status")),
]:
    query(name, PLACED.format(order), "keyed_orders")(lambda d, test=test: placed(_orders(d, test(Query()))))

for name, sql, test in [
    ("p_gt", ITEM + "discount > 0.07::DOUBLE", lambda q: q.where("discount").greater_than(0.07)),
    ("p_ge", ITEM + "discount >= 0.07::DOUBLE", lambda q: q.where("discount").greater_than_or_equal(0.07)),
    ("p_lt_nullpass", ITEM + "discount IS NULL OR discount < 0.03::DOUBLE", lambda q: q.where("discount").less_than(0.03)),
    ("p_le_nullpass", ITEM + "discount IS NULL OR discount <= 0.03::DOUBLE", lambda q: q.where("discount").less_than_or_equal(0.03)),
    ("p_null_operands", ITEM + "discount IS NULL", lambda q: q.where("discount").less_than_or_equal(None).and_("discount").greater_than_or_equal(None)),
]:
    query(name, sql, "items")(lambda d, test=test: _items(d, test(Query())))

for name, sql, test in [
    ("p_contains_ci", "SELECT * FROM part WHERE contains(lower(p_name), 'widget')", lambda q: q.where("p_name").contains("WIDGET")),
    ("p_prefix_ci", "SELECT * FROM part WHERE starts_with(lower(p_type), 'eco')", lambda q: q.where("p_type").starts_with("Eco")),
    ("p_suffix_ci", "SELECT * FROM part WHERE ends_with(lower(p_name), 'bolt')", lambda q: q.where("p_name").ends_with("BOLT")),
]:
    query(name, sql)(lambda d, test=test: test(Query()).filtered(d.part))


@query("p_nested", "SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def _(d: Data) -> DataFrame:
    records = d.events.withColumn("props", F.from_json("props", "k bigint"))
    return Query().where("props.k").greater_than(90).filtered(records).select("event_id", "user_id")


@query("p_nested_variant", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def _(d: Data) -> DataFrame:
    return Query().where("props.k").equals("42").filtered(d.events.withColumn("props", F.parse_json("props"))).select("event_id")


@query("p_select", "SELECT key, o_custkey, status FROM keyed_orders", "keyed_orders")
def _(d: Data) -> DataFrame:
    return Query().select("o_custkey", "status", "unknown").apply(d.keyed_orders())


@query("p_exclude", "SELECT key, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM keyed_orders", "keyed_orders")
def _(d: Data) -> DataFrame:
    return Query().exclude("o_orderdate", "o_orderpriority", "status").apply(d.keyed_orders())


@query("p_count", "SELECT count(*) AS total, 10 AS page, count(*) > 30 AS has_more FROM keyed_orders WHERE status = 'F'", "keyed_orders")
def _(d: Data) -> DataFrame:
    found = Query().where("status").equals("F").order_by("key").offset(20).limit(10).execute(d.keyed_orders())
    return found.filtered.agg(F.count("*").alias("total"), F.lit(10).alias("page"), (F.count("*") > found.offset + found.limit).alias("has_more"))


@query("p_scalar", "SELECT c_custkey, segment AS __value FROM segments WHERE segment IS NOT NULL AND contains(lower(segment), 'hold')", "segments")
def _(d: Data) -> DataFrame:
    return Query().where("__value").contains("HOLD").filtered(scalar_records(d.segments(), "segment"))


@query("p_multisearch", "SELECT 'part' AS entity, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 're') OR contains(lower(p_brand), 're') UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE contains(lower(s_name), 're')")
def _(d: Data) -> DataFrame:
    found = lambda df, entity, id_, fields: search_fields(df, fields, "RE").select(F.lit(entity).alias("entity"), c(id_).cast("string").alias("id"))
    return found(d.part, "part", "p_partkey", ["p_name", "p_type", "p_brand"]).unionByName(found(d.supplier, "supplier", "s_suppkey", ["s_name"]))


@query("p_firstmatch", "SELECT * FROM part WHERE p_name = 'red widget' ORDER BY p_partkey LIMIT 1")
def _(d: Data) -> DataFrame:
    return first_match(d.part.withColumn("key", c("p_partkey")).orderBy("key"), "p_name", "red widget").drop("key")


@query("p_openrange", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
def _(d: Data) -> DataFrame:
    from datetime import datetime

    return open_range(d.orders, "o_orderdate", datetime(1996, 1, 1), datetime(1996, 3, 1)).select("o_orderkey")


# --- keyed tables ---


@query("s_keys", "SELECT key FROM keyed_orders", "keyed_orders")
def _(d: Data) -> DataFrame:
    return store.keys(d.keyed_orders())


@query("s_get", ORDER + "key = 'order:77'", "keyed_orders")
def _(d: Data) -> DataFrame:
    return store.get(d.keyed_orders(), "order:77").select("key", "o_orderkey", "o_totalprice")


@query("s_multiget", "SELECT key, o_orderkey FROM keyed_orders WHERE key IN (SELECT 'order:' || (c_custkey * 3) FROM customer)", "keyed_orders")
def _(d: Data) -> DataFrame:
    wanted = d.customer.select(F.concat(F.lit("order:"), (c("c_custkey") * 3).cast("string")).alias("key"))
    return store.get_many(d.keyed_orders(), wanted).select("key", "o_orderkey")


@query("s_exists", "SELECT count(*) > 0 AS found FROM keyed_orders WHERE key = 'order:5'", "keyed_orders")
def _(d: Data) -> DataFrame:
    return store.exists(d.keyed_orders(), "order:5")


@query("s_upsert", "WITH last AS (SELECT key, arg_max(value, seq) AS value FROM wal WHERE op = 'write' GROUP BY key) SELECT key, value FROM accounts WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, value FROM last", "accounts wal")
def _(d: Data) -> DataFrame:
    return store.upsert(d.accounts(), d.wal().filter("op = 'write'").select("key", "value", "seq"), order="seq")


@query("s_delete", "SELECT key, value FROM accounts WHERE key NOT IN (SELECT key FROM wal WHERE op = 'delete')", "accounts wal")
def _(d: Data) -> DataFrame:
    return store.delete(d.accounts(), d.wal().filter("op = 'delete'"))


@query("s_archive", "SELECT key, value FROM accounts", "accounts")
def _(d: Data) -> DataFrame:
    secret = F.lit(codec.derived_key("secret", b"0123456789abcdef", 1000))
    packed = codec.archive(d.accounts(), "key", "value", 4, secret)
    return codec.unarchive(packed, secret).select("key", c("value").cast("string").alias("value"))


@query("s_sharded_archive", "SELECT key, value FROM accounts", "accounts")
def _(d: Data) -> DataFrame:
    sharded = routing.with_shard(d.accounts(), "key", 4)
    parts = [codec.unarchive(codec.archive(sharded.filter(c("shard") == i), "key", "value")) for i in range(4)]
    return routing.fan_out(parts, lambda df: df).select("key", c("value").cast("string").alias("value"))


@query("s_json_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(d: Data) -> DataFrame:
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
    coded = d.orders.select(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus")).alias("j"))
    return coded.select(F.from_json("j", schema).alias("r")).select("r.*")


@query("s_repository", "SELECT key, value FROM accounts WHERE key NOT IN ('user:2', 'user:4') UNION ALL SELECT 'user:2', 'NEW'", "accounts")
def _(d: Data) -> DataFrame:
    box = store.Repository(d.accounts()).delete_all(["user:4"])
    return box.save_all(d.spark.createDataFrame([("user:2", "NEW")], "key string, value string")).get_all()


# --- token search ---

STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
TOKENS = f"WITH tok AS (SELECT doc_id, list_filter(string_split_regex(trim(lower(regexp_replace(regexp_replace(text, '{text.DIACRITICS}', '', 'g'), '{text.TATWEEL}', '', 'g'))), '{text.SEPARATORS}'), lambda w: length(w) >= 2 AND w NOT IN {STOP}) AS w FROM documents), first AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:100] AS t FROM tok) "  # noqa: E501


def _index(d: Data) -> DataFrame:
    return search.postings(d.documents, "doc_id", "text")


@query("t_postings", TOKENS + "SELECT unnest(t) AS token, doc_id AS key FROM first")
def _(d: Data) -> DataFrame:
    return _index(d)


@query("t_token_count", TOKENS + "SELECT doc_id, len(t) AS n FROM first")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id", F.size(text.tokens(c("text"))).cast("long").alias("n"))


for name, sql, how, needle in [
    ("t_and", "list_contains(t, 'er') AND list_contains(t, 'th')", "all", "Er, TH"),
    ("t_or", "list_contains(t, 'zu') OR list_contains(t, 'que')", "any", "zu que"),
    ("t_prefix", "len(list_filter(t, lambda x: starts_with(x, 'tion'))) > 0", "prefix", " Tion"),
    ("t_prefix_separator", "false", "prefix", "a-b"),
    ("t_stopword_and", "false", "all", "the er"),
    ("t_empty", "false", "all", " ! "),
]:
    query(name, TOKENS + f"SELECT doc_id FROM first WHERE {sql}")(lambda d, how=how, needle=needle: search.search(d.documents, "text", needle, how).select("doc_id"))
    query(name + "_index", TOKENS + f"SELECT doc_id AS key FROM first WHERE {sql}")(lambda d, how=how, needle=needle: search.search_keys(_index(d), needle, how))


@query("t_search_values", TOKENS + "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM first WHERE list_contains(t, 'er') AND list_contains(t, 'th'))")
def _(d: Data) -> DataFrame:
    return search.records_of(d.documents, "doc_id", search.search_keys(_index(d), "er th")).select("doc_id", "lang", "source")


@query("t_stats", TOKENS + ", p AS (SELECT unnest(t) AS token, doc_id FROM first), a AS (SELECT token, count(*) AS n FROM p GROUP BY token), b AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id) SELECT CAST((SELECT count(*) FROM b) AS BIGINT) AS entries, CAST((SELECT count(*) FROM a) AS BIGINT) AS keywords, (SELECT sum(n) FROM b)::DOUBLE / (SELECT count(*) FROM b) AS keywords_per_entry, CAST((SELECT sum(length(token) * 2 + n * 32) FROM a) + (SELECT sum(length(CAST(doc_id AS VARCHAR)) * 2 + n * 20) FROM b) AS BIGINT) AS memory_bytes")
def _(d: Data) -> DataFrame:
    return search.record_statistics(d.documents, "doc_id", "text")


@query("t_extract", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ' ' || c_name || ' ' || CAST(c_nationkey AS VARCHAR) || ' ' || c_mktsegment AS text FROM customer")
def _(d: Data) -> DataFrame:
    packed = d.customer.select("c_custkey", F.struct("c_name", "c_nationkey", F.struct("c_mktsegment").alias("more")).alias("record"))
    return packed.select("c_custkey", text.searchable_text([(f.name, f.dataType) for f in packed.schema.fields], {"c_custkey", "record", "c_name", "c_nationkey", "more", "c_mktsegment"}).alias("text"))


@query("t_dump", TOKENS + "SELECT token, count(DISTINCT doc_id) AS n_keys FROM (SELECT unnest(t) AS token, doc_id FROM first) GROUP BY token ORDER BY token LIMIT 20")
def _(d: Data) -> DataFrame:
    return search.dump(_index(d))


@query("t_indexed", TOKENS + "SELECT doc_id AS key FROM first WHERE len(t) > 0")
def _(d: Data) -> DataFrame:
    return _index(d).select("key").distinct()


@query("t_crossbox", "SELECT 'parts' AS module, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE list_contains(string_split(p_name, ' '), 'red') UNION ALL SELECT 'segments', CAST(c_custkey AS VARCHAR) FROM customer WHERE lower(c_mktsegment) = 'red'")
def _(d: Data) -> DataFrame:
    return search.search_modules({"parts": (d.part, "p_partkey", "p_name"), "segments": (d.customer, "c_custkey", "c_mktsegment")}, "Red")
