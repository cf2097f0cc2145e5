"""Registered queries: joins and inventory reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports as r
from ..operators import versions
from .data import Data, c, placed, query

COST, SELL = "stock * CAST(cost AS DECIMAL(18,2))", "stock * CAST(price AS DECIMAL(18,2))"
DEC = "CAST({} AS DOUBLE)"
LOOKUPS = "FROM products p LEFT JOIN categories c ON c.id = p.category LEFT JOIN suppliers s ON s.id = p.supplier"


@query("j_lookup", f"SELECT p.id, coalesce(c.name, 'Unknown') AS category_name {LOOKUPS}", "products categories suppliers")
def _(d: Data) -> DataFrame:
    return r.lookup(d.products(), d.categories(), "category", "category_name", "Unknown").select("id", "category_name")


@query("j_two_dim", f"SELECT p.id, coalesce(c.name, 'Unknown') AS category_name, s.name AS supplier_name {LOOKUPS}", "products categories suppliers")
def _(d: Data) -> DataFrame:
    one = r.lookup(d.products(), d.categories(), "category", "category_name", "Unknown")
    return r.lookup(one, d.suppliers(), "supplier", "supplier_name", None).select("id", "category_name", "supplier_name")


@query("j_inner", "SELECT p.id, s.name AS supplier_name FROM products p JOIN suppliers s ON s.id = p.supplier", "products suppliers")
def _(d: Data) -> DataFrame:
    return r.lookup(d.products(), d.suppliers(), "supplier", "supplier_name", None, "inner").select("id", "supplier_name")


@query("j_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(d: Data) -> DataFrame:
    return d.part.join(d.lineitem.filter("l_quantity > 49"), c("p_partkey") == c("l_partkey"), "left_semi").select("p_partkey")


@query("j_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(d: Data) -> DataFrame:
    return d.part.join(d.lineitem.filter("l_quantity > 49"), c("p_partkey") == c("l_partkey"), "left_anti").select("p_partkey")


@query("j_conflict", "SELECT l.key, l.value AS local_value, r.value AS remote_value FROM local l JOIN remote r USING (key) WHERE l.value <> r.value", "local remote")
def _(d: Data) -> DataFrame:
    return versions.conflicts(d.local().select("key", "v.value"), d.remote().select("key", "v.value"))


@query("j_full", "SELECT key, l.value AS local_value, r.value AS remote_value FROM local l FULL JOIN remote r USING (key)", "local remote")
def _(d: Data) -> DataFrame:
    return d.local().select("key", c("v.value").alias("local_value")).join(d.remote().select("key", c("v.value").alias("remote_value")), "key", "full_outer")


@query("j_parent_detail", "SELECT s.id, p.id AS product FROM suppliers s JOIN products p ON p.supplier = s.id", "suppliers products")
def _(d: Data) -> DataFrame:
    return d.suppliers().join(d.products().select(c("id").alias("product"), "supplier"), c("id") == c("supplier")).select("id", "product")


@query("j_division", "SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def _(d: Data) -> DataFrame:
    wanted = ["click", "purchase", "error"]
    return d.events.filter(c("event_type").isin(wanted)).groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).filter(c("n") == len(wanted)).select("user_id")


# --- reports ---


@query("r1_dashboard", f"SELECT count(*) AS products, count(*) FILTER (active) AS active, count(*) FILTER (active AND stock <= min_stock) AS low_stock, count(*) FILTER (active AND stock <= 0) AS out_of_stock, count(*) FILTER (active AND stock >= max_stock) AS overstock, CAST(sum({COST}) FILTER (active) AS DOUBLE) AS cost_value, CAST(sum({SELL}) FILTER (active) AS DOUBLE) AS selling_value, CAST(sum({SELL} - {COST}) FILTER (active) AS DOUBLE) AS profit FROM products", "products")
def _(d: Data) -> DataFrame:
    return r.dashboard(d.products())


@query("r1_by_category", f"SELECT coalesce(c.name, 'Uncategorised') AS category_name, count(*) AS n, CAST(sum({COST}) AS DOUBLE) AS value {LOOKUPS} WHERE active GROUP BY 1", "products categories suppliers")
def _(d: Data) -> DataFrame:
    return r.by_category(d.products(), d.categories())


STOCK = f"SELECT p.id, p.name, coalesce(c.name, 'Unknown') AS category_name, s.name AS supplier_name, stock, min_stock, reorder_point, cost {LOOKUPS} WHERE active AND "


@query("r2_low_stock", STOCK + "stock <= min_stock", "products categories suppliers")
def _(d: Data) -> DataFrame:
    return r.stock_list(d.products(), d.categories(), d.suppliers(), r.low_stock())


@query("r3_valuation", f"SELECT p.id, coalesce(c.name, 'Unknown') AS category_name, stock AS quantity, CAST({COST} AS DOUBLE) AS cost_value, CAST({SELL} AS DOUBLE) AS selling_value, CAST({SELL} - {COST} AS DOUBLE) AS profit, CASE WHEN stock > 0 THEN round(CAST({SELL} - {COST} AS DOUBLE) / CAST({SELL} AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS margin {LOOKUPS} WHERE active", "products categories suppliers")
def _(d: Data) -> DataFrame:
    return r.valuation(d.products(), d.categories())


@query("r3_totals", f"SELECT CAST(sum({COST}) AS DOUBLE) AS cost_value, CAST(sum({SELL}) AS DOUBLE) AS selling_value FROM products WHERE active", "products")
def _(d: Data) -> DataFrame:
    return r.valuation_totals(d.products())


@query("r4_movements", "SELECT id, product, quantity FROM movements WHERE ts > TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1997-06-01' AND type = 'out'", "movements")
def _(d: Data) -> DataFrame:
    return r.movement_report(d.movements(), datetime(1997, 1, 1), datetime(1997, 6, 1), type_="out").select("id", "product", "quantity")


@query("r5_reorder", STOCK + "stock <= reorder_point", "products categories suppliers")
def _(d: Data) -> DataFrame:
    return r.stock_list(d.products(), d.categories(), d.suppliers(), r.needs_reorder())


@query("r6_categories", f"WITH f AS (SELECT category, count(*) AS n, CAST(sum({COST}) AS DOUBLE) AS cost_value, CAST(sum({SELL}) AS DOUBLE) AS selling_value, count(*) FILTER (stock <= min_stock) AS low_stock, count(*) FILTER (stock <= 0) AS out_of_stock FROM products GROUP BY category) SELECT coalesce(c.id, f.category) AS category, coalesce(c.name, 'Unknown') AS category_name, coalesce(n, 0) AS n, coalesce(cost_value, 0) AS cost_value, coalesce(selling_value, 0) AS selling_value, coalesce(low_stock, 0) AS low_stock, coalesce(out_of_stock, 0) AS out_of_stock FROM categories c FULL JOIN f ON c.id = f.category", "products categories")
def _(d: Data) -> DataFrame:
    return r.category_report(d.products(), d.categories())


IN_OUT = "CAST(coalesce(sum(quantity) FILTER (type = 'in'), 0) AS DOUBLE) AS quantity_in, CAST(coalesce(sum(quantity) FILTER (type = 'out'), 0) AS DOUBLE) AS quantity_out"


@query("r7_daily", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {IN_OUT} FROM movements GROUP BY 1 ORDER BY 1 DESC LIMIT 7", "movements")
def _(d: Data) -> DataFrame:
    return r.daily_totals(d.movements()).withColumn("day", c("day").cast("string"))


@query("r8_totals", f"SELECT {IN_OUT} FROM movements", "movements")
def _(d: Data) -> DataFrame:
    return r.movement_totals(d.movements())


@query("r9_top", f"SELECT id, name, CAST({COST} AS DOUBLE) AS value FROM products ORDER BY value DESC, id LIMIT 5", "products")
def _(d: Data) -> DataFrame:
    return r.top_by_value(d.products())


@query("r10_share", f"SELECT category, round(CAST(sum({COST}) AS DOUBLE) / CAST((SELECT sum({COST}) FROM products) AS DOUBLE), 6) AS share FROM products GROUP BY category", "products")
def _(d: Data) -> DataFrame:
    return r.share_by_category(d.products())


@query("r11_orders", "SELECT order_id, CAST(sum(CAST(ordered AS DECIMAL(18,2)) * CAST(unit_cost AS DECIMAL(18,2))) AS DOUBLE) AS value, round(least(greatest(CAST(sum(received) AS DOUBLE) / sum(ordered), 0), 1), 6) AS progress FROM order_lines WHERE order_id IN (SELECT order_id FROM purchase_orders) GROUP BY order_id", "order_lines purchase_orders")
def _(d: Data) -> DataFrame:
    return r.order_totals(d.purchase_orders(), d.order_lines())


@query("r12_suppliers", "SELECT s.id, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS value, count(*) FILTER (status NOT IN ('received', 'cancelled')) AS active_orders FROM suppliers s LEFT JOIN purchase_orders o ON o.supplier = s.id GROUP BY s.id", "suppliers purchase_orders")
def _(d: Data) -> DataFrame:
    return r.supplier_stats(d.suppliers(), d.purchase_orders())


@query("r13_requests", "SELECT s.id AS supplier, s.name AS supplier_name, string_agg(p.id || ':' || reorder_qty, ',' ORDER BY p.id) AS lines FROM products p JOIN suppliers s ON s.id = p.supplier WHERE active AND stock <= reorder_point GROUP BY 1, 2", "products suppliers")
def _(d: Data) -> DataFrame:
    found = r.reorder_requests(d.products(), d.suppliers())
    return found.withColumn("lines", F.array_join(F.transform("lines", lambda l: F.concat_ws(":", l["id"], l["reorder_qty"])), ","))


LABEL = "CASE WHEN stock <= 0 THEN 'out of stock' WHEN stock <= min_stock THEN 'low' WHEN stock >= max_stock THEN 'overstock' ELSE 'in stock' END"


@query("r14_status", f"SELECT id, {LABEL} AS label FROM products", "products")
def _(d: Data) -> DataFrame:
    return d.products().select("id", r.stock_status().alias("label"))


ALERTS = "WITH a AS (SELECT id AS product, CASE WHEN stock <= 0 THEN 'out_of_stock' ELSE 'low_stock' END AS type, CASE WHEN stock <= 0 THEN 'critical' ELSE 'warning' END AS severity FROM products WHERE stock <= min_stock UNION ALL SELECT id, 'reorder', 'info' FROM products WHERE stock <= reorder_point AND stock > min_stock)"


def _alerts(d: Data) -> DataFrame:
    existing = d.products().filter("id % 6 = 0").select(c("id").alias("product"), F.lit("low_stock").alias("type"))
    return r.alerts(d.products(), existing)


@query("r15_alerts", ALERTS + " SELECT * FROM a WHERE NOT (type = 'low_stock' AND product % 6 = 0)", "products")
def _(d: Data) -> DataFrame:
    return _alerts(d)


@query("r16_signed", "SELECT id, CASE WHEN type = 'in' THEN quantity ELSE -quantity END AS delta, greatest(20 + CASE WHEN type = 'in' THEN quantity ELSE -quantity END, 0) AS stock_after FROM movements", "movements")
def _(d: Data) -> DataFrame:
    delta = r.signed(c("type"), c("quantity"))
    return d.movements().select("id", delta.alias("delta"), F.greatest(20 + delta, F.lit(0.0)).alias("stock_after"))


@query("r17_variance", "SELECT id, stock, stock + id % 3 - 1 + 0.0001::DOUBLE AS counted, stock + id % 3 - 1 + 0.0001::DOUBLE - stock AS variance FROM products WHERE id % 3 <> 1", "products")
def _(d: Data) -> DataFrame:
    counted = d.products().select("id", (c("stock") + c("id") % 3 - 1 + 0.0001).alias("counted"))
    return r.variances(d.products(), counted)


@query("r18_pending", "SELECT order_id FROM purchase_orders WHERE status NOT IN ('received', 'cancelled')", "purchase_orders")
def _(d: Data) -> DataFrame:
    return d.purchase_orders().filter(~c("status").isin("received", "cancelled")).select("order_id")


@query("r19_retention", "SELECT order_id FROM purchase_orders WHERE ts >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY", "purchase_orders")
def _(d: Data) -> DataFrame:
    return d.purchase_orders().filter(c("ts") >= F.expr("TIMESTAMP_NTZ'2001-08-01' - INTERVAL 365 DAY")).select("order_id")


@query("r20_receive", "SELECT order_id, CASE WHEN bool_and(least(ordered, received + 10) >= ordered) THEN 'received' ELSE 'partial' END AS status, sum(least(ordered, received + 10)) AS received FROM order_lines WHERE order_id IN (SELECT order_id FROM purchase_orders) GROUP BY order_id", "order_lines purchase_orders")
def _(d: Data) -> DataFrame:
    done = r.receive(r.orders_with_lines(d.purchase_orders(), d.order_lines()), 10)
    return done.select("order_id", "status", F.aggregate("lines", F.lit(0.0), lambda a, l: a + l["received"]).alias("received"))


# stock with a floor at zero is the running sum less its least value so far, if that is negative: no recursion is needed
@query("r21_ledger", "WITH s AS (SELECT product, ts, id, CAST(CASE WHEN type = 'in' THEN quantity ELSE -quantity END AS BIGINT) AS delta FROM movements), b AS (SELECT product, row_number() OVER w AS k, CAST(sum(delta) OVER w AS BIGINT) AS balance FROM s WINDOW w AS (PARTITION BY product ORDER BY ts, id, delta ROWS UNBOUNDED PRECEDING)) SELECT product, max(k) AS n, arg_max(balance, k) - least(min(balance), 0) AS final_stock FROM b GROUP BY product", "movements")
def _(d: Data) -> DataFrame:
    return r.ledger(d.movements())


@query("r21_running", "SELECT id, product, CAST(sum(CASE WHEN type = 'in' THEN quantity ELSE -quantity END) OVER (PARTITION BY product ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM movements", "movements")
def _(d: Data) -> DataFrame:
    return r.running_stock(d.movements())


@query("r22_filters", "SELECT id FROM products WHERE category = 'Brand#5' AND supplier = 7 UNION ALL (SELECT order_id FROM purchase_orders WHERE status = 'ordered' ORDER BY ts DESC, order_id LIMIT 10)", "products purchase_orders")
def _(d: Data) -> DataFrame:
    recent = d.purchase_orders().filter("status = 'ordered'").orderBy(c("ts").desc(), "order_id").limit(10)
    return d.products().filter("category = 'Brand#5' AND supplier = 7").select("id").union(recent.select("order_id"))


@query("r23_numbers", "SELECT order_id, 'PO-2026-' || lpad(CAST(row_number() OVER (ORDER BY order_id) AS VARCHAR), 5, '0') AS number FROM purchase_orders", "purchase_orders")
def _(d: Data) -> DataFrame:
    return r.numbered(d.purchase_orders(), 2026)


@query("r24_bulk_update", "SELECT order_id, status, status = 'received' OR amount < 1000 AS is_read FROM purchase_orders", "purchase_orders")
def _(d: Data) -> DataFrame:
    marked = d.purchase_orders().withColumn("is_read", c("amount") < 1000)
    return marked.withColumn("is_read", F.when(c("status") == "received", True).otherwise(c("is_read"))).select("order_id", "status", "is_read")


@query("r25_list", f"SELECT id FROM products WHERE (contains(lower(name), 'red') OR contains(lower(category), 'red')) AND {LABEL} = 'in stock'", "products")
def _(d: Data) -> DataFrame:
    return r.product_list(d.products(), "Red", None, "in stock").select("id")


@query("r26_dense", f"SELECT strftime(d, '%Y-%m-%d') AS day, {IN_OUT} FROM generate_series(DATE '2002-01-01' - INTERVAL 6 DAY, TIMESTAMP '2002-01-01', INTERVAL 1 DAY) AS g(d) LEFT JOIN movements ON ts >= d AND ts < d + INTERVAL 1 DAY GROUP BY 1", "movements")
def _(d: Data) -> DataFrame:
    return r.dense_days(d.movements(), "2002-01-01").withColumn("day", c("day").cast("string"))


@query("r27_movement_list", "SELECT m.id, m.product FROM movements m LEFT JOIN products p ON p.id = m.product WHERE (contains(lower(coalesce(p.name, '')), 'widget') OR contains(lower(note), 'widget')) AND ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1998-02-01' AND type = 'in'", "movements products")
def _(d: Data) -> DataFrame:
    return r.movement_list(d.movements(), d.products(), "Widget", "1998-01-01", "1998-01-31", "in").select("id", "product")


@query("r28_status_counts", "SELECT s.status, count(o.order_id) AS n, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS amount FROM (SELECT unnest(['draft', 'ordered', 'received', 'cancelled']) AS status) s LEFT JOIN purchase_orders o USING (status) GROUP BY 1", "purchase_orders")
def _(d: Data) -> DataFrame:
    return r.status_counts(d.purchase_orders(), ["draft", "ordered", "received", "cancelled"])


@query("r29_sorted", f"SELECT id, row_number() OVER (ORDER BY {COST} DESC, id) - 1 AS place FROM products", "products")
def _(d: Data) -> DataFrame:
    return placed(r.sorted_products(d.products(), "value", True).select("id"))


@query("r30_children", "SELECT s.id, count(p.id) AS n FROM suppliers s LEFT JOIN products p ON p.supplier = s.id GROUP BY s.id", "suppliers products")
def _(d: Data) -> DataFrame:
    return r.child_counts(d.suppliers(), d.products().select("supplier"), "supplier")


@query("r31_severity", ALERTS + " SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM a WHERE NOT (type = 'low_stock' AND product % 6 = 0)", "products")
def _(d: Data) -> DataFrame:
    return r.severity_counts(_alerts(d))


@query("r32_vertical", "SELECT CAST(id AS VARCHAR) AS id, name, cost FROM products WHERE id % 3 <> 0", "products")
def _(d: Data) -> DataFrame:
    public, private = r.vertical_split(d.products().select("id", "name", "cost"), "id", ["cost"])
    lost = F.regexp_extract("id", "^([0-9]+)", 1).cast("bigint") % 3 == 0
    return r.vertical_join(public, private.filter(~lost), "id")
