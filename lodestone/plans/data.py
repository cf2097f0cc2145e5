"""The tables of the registered queries, as Spark DataFrames and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Data:
    """Tables of one scale factor, and views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def keyed_orders(self) -> DataFrame:
        return self.orders.select(F.concat(F.lit("order:"), c("o_orderkey").cast("string")).alias("key"), "*", F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("status"))

    def items(self) -> DataFrame:
        return self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(c("l_discount") != 0.05, c("l_discount")).alias("discount"))

    def segments(self) -> DataFrame:
        return self.customer.select("c_custkey", F.when(c("c_mktsegment") != "BUILDING", c("c_mktsegment")).alias("segment"))

    def products(self) -> DataFrame:
        key = c("p_partkey")
        return self.part.select(
            key.alias("id"), c("p_name").alias("name"), c("p_brand").alias("category"), F.when(key % 10 != 0, key % 120).alias("supplier"), (key * 7 % 61).alias("stock"), F.lit(15).alias("min_stock"), F.lit(20).alias("reorder_point"), F.lit(50).alias("reorder_qty"), F.lit(55).alias("max_stock"),
            c("p_retailprice").alias("cost"), (c("p_retailprice") + c("p_size")).alias("price"), (c("p_size") % 5 != 0).alias("active"), (key * 13 % 997).alias("created"),
        )

    def categories(self) -> DataFrame:
        known = self.part.select(c("p_brand").alias("id")).distinct().filter(~c("id").isin("Brand#3", "Brand#13"))
        return known.unionByName(self.spark.createDataFrame([("Brand#99",)], "id string")).select("id", F.concat(F.lit("Category "), "id").alias("name"))

    def suppliers(self) -> DataFrame:
        return self.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"))

    def movements(self) -> DataFrame:
        return self.lineitem.select(((c("l_orderkey") * 10 + c("l_linenumber")) * 100000 + c("l_partkey")).alias("id"), c("l_partkey").alias("product"), F.when(c("l_returnflag") == "N", "out").otherwise("in").alias("type"), c("l_quantity").alias("quantity"), c("l_shipdate").alias("ts"), c("l_linestatus").alias("note"))

    def purchase_orders(self) -> DataFrame:
        status = F.when(c("o_orderstatus") == "O", "ordered").when(c("o_orderstatus") == "F", "received").otherwise("cancelled")
        return self.orders.select(c("o_orderkey").alias("order_id"), (c("o_custkey") % 120).alias("supplier"), status.alias("status"), c("o_totalprice").alias("amount"), c("o_orderdate").alias("ts"), c("o_orderpriority").alias("note"))

    def order_lines(self) -> DataFrame:
        return self.lineitem.select(c("l_orderkey").alias("order_id"), c("l_linenumber").alias("line"), c("l_partkey").alias("product"), c("l_quantity").alias("ordered"), F.when(c("l_linestatus") == "F", c("l_quantity")).otherwise(F.floor(c("l_quantity") / 2).cast("double")).alias("received"), c("l_extendedprice").alias("unit_cost"))

    def log(self) -> DataFrame:
        return self.events.select("event_id", "user_id", c("event_type").alias("op"), "ts", F.round(c("value") * 1000).cast("long").alias("us"), (c("event_type") == "error").alias("is_error"), (c("event_id") % 5000).alias("bytes"), (c("event_id") % 3 == 0).alias("from_cache"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("t"))

    def audit(self) -> DataFrame:
        size = F.when(c("event_id") % 7 != 0, c("event_id") % 4096)
        return self.log().withColumns({"original_size": size, "compressed_size": F.floor(size / 2), "elapsed_us": c("us")})

    def wal(self) -> DataFrame:
        return self.events.select(c("event_id").alias("seq"), F.concat(F.lit("user:"), c("user_id").cast("string")).alias("key"), F.when(c("event_type") == "error", "delete").otherwise("write").alias("op"), F.when(c("event_type") != "error", c("event_type")).alias("value"))

    def accounts(self) -> DataFrame:
        return self.customer.filter(c("c_custkey") % 2 == 0).select(F.concat(F.lit("user:"), c("c_custkey").cast("string")).alias("key"), c("c_mktsegment").alias("value"))

    def local(self) -> DataFrame:
        key = c("o_orderkey")
        day = F.datediff(c("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        clock = F.create_map(F.lit("A"), key % 3 + 1, F.lit("B"), key % 2)
        return self.orders.filter(key % 5 != 0).select(key.alias("key"), F.struct(c("o_totalprice").alias("value"), F.lit("A").alias("source_id"), day.alias("ts"), F.lit(1).alias("version"), clock.alias("vector_clock")).alias("v"))

    def remote(self) -> DataFrame:
        key = c("o_orderkey")
        day = F.datediff(c("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        clock = F.create_map(F.lit("A"), key % 4, F.lit("C"), key % 3)
        return self.orders.filter(key % 7 != 0).select(key.alias("key"), F.struct((c("o_totalprice") + key % 2).alias("value"), F.lit("B").alias("source_id"), (day + key % 3 - 1).alias("ts"), F.lit(1).alias("version"), clock.alias("vector_clock")).alias("v"))

    def expiries(self) -> DataFrame:
        key = c("o_orderkey")
        return self.orders.filter(key % 4 != 0).select(F.concat(F.lit("order:"), key.cast("string")).alias("key"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 400 AS INT))").alias("expire_at"))


#: WITH items of the same views for the oracle.
VIEWS = {
    "keyed_orders": "SELECT 'order:' || o_orderkey AS key, *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders",
    "items": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_discount <> 0.05::DOUBLE THEN l_discount END AS discount FROM lineitem",
    "segments": "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer",
    "products": "SELECT p_partkey AS id, p_name AS name, p_brand AS category, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 120 END AS supplier, p_partkey * 7 % 61 AS stock, 15 AS min_stock, 20 AS reorder_point, 50 AS reorder_qty, 55 AS max_stock, p_retailprice AS cost, p_retailprice + p_size AS price, p_size % 5 <> 0 AS active, p_partkey * 13 % 997 AS created FROM part",
    "categories": "SELECT id, 'Category ' || id AS name FROM (SELECT DISTINCT p_brand AS id FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#13') UNION ALL SELECT 'Brand#99')",
    "suppliers": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "movements": "SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, l_partkey AS product, CASE WHEN l_returnflag = 'N' THEN 'out' ELSE 'in' END AS type, l_quantity AS quantity, l_shipdate AS ts, l_linestatus AS note FROM lineitem",
    "purchase_orders": "SELECT o_orderkey AS order_id, o_custkey % 120 AS supplier, CASE o_orderstatus WHEN 'O' THEN 'ordered' WHEN 'F' THEN 'received' ELSE 'cancelled' END AS status, o_totalprice AS amount, o_orderdate AS ts, o_orderpriority AS note FROM orders",
    "order_lines": "SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product, l_quantity AS ordered, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE floor(l_quantity / 2) END AS received, l_extendedprice AS unit_cost FROM lineitem",
    "log": "SELECT event_id, user_id, event_type AS op, ts, CAST(round(value * 1000) AS BIGINT) AS us, event_type = 'error' AS is_error, event_id % 5000 AS bytes, event_id % 3 = 0 AS from_cache, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t FROM events",
    "audit": "SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_id % 4096 END AS original_size, CASE WHEN event_id % 7 <> 0 THEN (event_id % 4096) // 2 END AS compressed_size, us AS elapsed_us FROM log",
    "wal": "SELECT event_id AS seq, 'user:' || user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events",
    "accounts": "SELECT 'user:' || c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0",
    "local": "SELECT o_orderkey AS key, o_totalprice AS value, 'A' AS source, CAST(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS BIGINT) AS ts, o_orderkey % 3 + 1 AS a, o_orderkey % 2 AS b, 0 AS c FROM orders WHERE o_orderkey % 5 <> 0",
    "remote": "SELECT o_orderkey AS key, o_totalprice + o_orderkey % 2 AS value, 'B' AS source, CAST(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS BIGINT) + o_orderkey % 3 - 1 AS ts, o_orderkey % 4 AS a, 0 AS b, o_orderkey % 3 AS c FROM orders WHERE o_orderkey % 7 <> 0",
    "expiries": "SELECT 'order:' || o_orderkey AS key, o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) AS expire_at FROM orders WHERE o_orderkey % 4 <> 0",
}
_NEEDS = {"audit": ["log"]}


def placed(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place from 0, counted partition by partition."""
    numbered = rows.rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return rows.sparkSession.createDataFrame(numbered, rows.schema.add("place", "long"))


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query over Data, with the SQL that gives the same rows; `views` names what the SQL selects from."""

    def add(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql is not None:
            names = [n for v in views.split() for n in (*_NEEDS.get(v, []), v)]
            items = ", ".join(f"{v} AS ({VIEWS[v]})" for v in dict.fromkeys(names))
            body = sql.strip()
            if items:
                body = f"WITH RECURSIVE {items}, {body[15:]}" if body.startswith("WITH RECURSIVE ") else f"WITH {items}, {body[5:]}" if body.startswith("WITH ") else f"WITH {items} {body}"
            ORACLE_SQL[name] = body
        return f

    return add
