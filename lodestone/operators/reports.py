"""Inventory reports over products, categories, suppliers, movements and orders. Money is summed as decimals."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def total(x: Column) -> Column:
    """Exact sum, as a double."""
    return F.coalesce(F.sum(x), F.lit(0)).cast("double")


def low_stock() -> Column:
    return c("stock") <= c("min_stock")


def needs_reorder() -> Column:
    return c("stock") <= c("reorder_point")


def cost_value() -> Column:
    return c("stock") * money(c("cost"))


def selling_value() -> Column:
    return c("stock") * money(c("price"))


def lookup(facts: DataFrame, dim: DataFrame, on: str, name: str, default: str | None, how: str = "left") -> DataFrame:
    """Adds dim's name for a foreign key, or a label where there is none. Its size decides whether Spark broadcasts dim."""
    named = dim.select(c("id").alias(on), c("name").alias(name))
    out = facts.join(named, on, how)
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def dashboard(products: DataFrame) -> DataFrame:
    active = c("active")
    one = products.agg(
        F.count("*").alias("products"), F.count_if(active).alias("active"), F.count_if(active & low_stock()).alias("low_stock"), F.count_if(active & (c("stock") <= 0)).alias("out_of_stock"), F.count_if(active & (c("stock") >= c("max_stock"))).alias("overstock"),
        total(F.when(active, cost_value())).alias("cost_value"), total(F.when(active, selling_value())).alias("selling_value"), F.sum(F.when(active, selling_value() - cost_value())).cast("double").alias("profit"),
    )
    return one


def by_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    named = lookup(products.filter("active"), categories, "category", "category_name", "Uncategorised")
    return named.groupBy("category_name").agg(F.count("*").alias("n"), total(cost_value()).alias("value"))


def stock_list(products: DataFrame, categories: DataFrame, suppliers: DataFrame, condition: Column) -> DataFrame:
    """Low-stock and reorder reports: active products under a condition, with both lookups; a supplier may be missing."""
    found = products.filter(c("active") & condition)
    found = lookup(found, categories, "category", "category_name", "Unknown")
    found = lookup(found, suppliers, "supplier", "supplier_name", None)
    return found.select("id", "name", "category_name", "supplier_name", "stock", "min_stock", "reorder_point", "cost").orderBy("stock", "id")


def valuation(products: DataFrame, categories: DataFrame) -> DataFrame:
    named = lookup(products.filter("active"), categories, "category", "category_name", "Unknown")
    valued = named.select("id", "category_name", c("stock").alias("quantity"), cost_value().cast("double").alias("cost_value"), selling_value().cast("double").alias("selling_value"), (selling_value() - cost_value()).cast("double").alias("profit"))
    margin = F.when(c("selling_value") > 0, c("profit") / c("selling_value")).otherwise(0.0)
    return valued.withColumn("margin", F.round(margin, 6)).orderBy(c("cost_value").desc(), "id")


def valuation_totals(products: DataFrame) -> DataFrame:
    active = products.filter("active")
    return active.agg(total(cost_value()).alias("cost_value"), total(selling_value()).alias("selling_value"))


def movement_report(movements: DataFrame, after: Any, before: Any, product: Any = None, type_: str | None = None) -> DataFrame:
    """Between two moments (both excluded), with optional product and type, newest first."""
    out = movements.filter((c("ts") > F.lit(after)) & (c("ts") < F.lit(before)))
    if product is not None:
        out = out.filter(c("product") == product)
    if type_ is not None:
        out = out.filter(c("type") == type_)
    return out.orderBy(c("ts").desc(), "id")


def category_report(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category, those without products at zero, and unknown ones that products name."""
    facts = products.groupBy("category").agg(F.count("*").alias("n"), total(cost_value()).alias("cost_value"), total(selling_value()).alias("selling_value"), F.count_if(low_stock()).alias("low_stock"), F.count_if(c("stock") <= 0).alias("out_of_stock"))
    both = categories.select(c("id").alias("category"), c("name").alias("category_name")).join(facts, "category", "full_outer")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "cost_value", "selling_value", "low_stock", "out_of_stock")]
    return both.select("category", F.coalesce("category_name", F.lit("Unknown")).alias("category_name"), *zero)


def daily_totals(movements: DataFrame, days: int = 7) -> DataFrame:
    """In and out quantities of the last days that have movements."""
    per_day = movements.groupBy(F.to_date("ts").alias("day")).agg(total(F.when(c("type") == "in", c("quantity"))).alias("quantity_in"), total(F.when(c("type") == "out", c("quantity"))).alias("quantity_out"))
    return per_day.orderBy(c("day").desc()).limit(days)


def dense_days(movements: DataFrame, last: Any, days: int = 7) -> DataFrame:
    """The same for each of the last days up to `last`, days without movements at zero."""
    end = F.lit(last).cast("date")
    calendar = movements.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    # the range reaches the scan, so that only the window is read
    inside = movements.filter((c("ts") >= F.date_sub(end, days - 1).cast("timestamp_ntz")) & (c("ts") < F.date_add(end, 1).cast("timestamp_ntz")))
    sums = inside.groupBy(F.to_date("ts").alias("day")).agg(total(F.when(c("type") == "in", c("quantity"))).alias("quantity_in"), total(F.when(c("type") == "out", c("quantity"))).alias("quantity_out"))
    return calendar.join(sums, "day", "left").select("day", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("quantity_in", "quantity_out")))


def movement_totals(movements: DataFrame) -> DataFrame:
    return movements.agg(total(F.when(c("type") == "in", c("quantity"))).alias("quantity_in"), total(F.when(c("type") == "out", c("quantity"))).alias("quantity_out"))


def top_by_value(products: DataFrame, n: int = 5) -> DataFrame:
    return products.select("id", "name", cost_value().cast("double").alias("value")).orderBy(c("value").desc(), "id").limit(n)


def share_by_category(products: DataFrame) -> DataFrame:
    """Each category's share of the total value. The total is joined as one row, not a window over all groups."""
    sums = products.groupBy("category").agg(F.sum(cost_value()).alias("v"))
    whole = sums.agg(F.sum("v").alias("t")).withColumn("one", F.lit(1))
    joined = sums.withColumn("one", F.lit(1)).join(whole, "one")
    return joined.select("category", F.round(c("v").cast("double") / c("t").cast("double"), 6).alias("share"))


def orders_with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with an array `lines` of (line, product, ordered, received, unit_cost)."""
    packed = lines.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("line", "product", "ordered", "received", "unit_cost"))).alias("lines"))
    return orders.join(packed, "order_id")


def order_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Value and progress of receipt, between 0 and 1, of orders with lines. Lines are added up before they are shuffled."""
    exact = lambda of: F.sum(of.cast("decimal(28,4)"))
    sums = lines.groupBy("order_id").agg(exact(money(c("ordered")) * money(c("unit_cost"))).cast("double").alias("value"), exact(money(c("ordered"))).alias("o"), exact(money(c("received"))).alias("r"))
    progress = F.when(c("o") > 0, F.least(F.greatest(c("r").cast("double") / c("o").cast("double"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return orders.select("order_id").join(sums, "order_id").select("order_id", "value", F.round(progress, 6).alias("progress"))


def receive(nested: DataFrame, add: float) -> DataFrame:
    """Adds a received quantity to each line, up to what was ordered; an order is received iff every line is."""
    lines = F.transform("lines", lambda l: l.withField("received", F.least(l["ordered"], l["received"] + add)))
    done = F.forall("lines", lambda l: l["received"] >= l["ordered"])  # the new lines
    return nested.withColumn("lines", lines).withColumn("status", F.when(done, "received").otherwise("partial"))


def supplier_stats(suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    """Order value and active orders of every supplier."""
    sums = orders.groupBy("supplier").agg(total(money(c("amount"))).alias("value"), F.count_if(~c("status").isin("received", "cancelled")).alias("active_orders"))
    return suppliers.join(sums, suppliers["id"] == sums["supplier"], "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("active_orders", F.lit(0)).alias("active_orders"))


def reorder_requests(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(supplier, name, lines) of products to reorder; products without a known supplier are left out."""
    found = products.filter(c("active") & needs_reorder()).join(suppliers.select(c("id").alias("supplier"), c("name").alias("supplier_name")), "supplier")
    return found.groupBy("supplier", "supplier_name").agg(F.sort_array(F.collect_list(F.struct("id", "reorder_qty"))).alias("lines"))


def stock_status() -> Column:
    """The first label that applies."""
    return F.when(c("stock") <= 0, "out of stock").when(low_stock(), "low").when(c("stock") >= c("max_stock"), "overstock").otherwise("in stock")


def alerts(products: DataFrame, existing: DataFrame) -> DataFrame:
    """New alerts (product, type, severity): out of stock, else low; reorder if not low; none that exists already."""
    out, low = c("stock") <= 0, low_stock()
    rules = F.array_compact(F.array(F.when(out, F.struct(F.lit("out_of_stock").alias("type"), F.lit("critical").alias("severity"))).when(low, F.struct(F.lit("low_stock").alias("type"), F.lit("warning").alias("severity"))), F.when(needs_reorder() & ~low, F.struct(F.lit("reorder").alias("type"), F.lit("info").alias("severity")))))
    raised = products.select(c("id").alias("product"), F.explode(rules).alias("a")).select("product", "a.type", "a.severity")
    return raised.join(existing.select("product", "type"), ["product", "type"], "left_anti").select("product", "type", "severity")


def signed(type_: Column, quantity: Column) -> Column:
    return F.when(type_ == "in", quantity).otherwise(-quantity)


def ledger(movements: DataFrame) -> DataFrame:
    """(product, n, final_stock): replays each product's movements in order of (ts, id); stock never falls below zero.

    Stock with a floor at zero is the sum of all deltas less the least running sum, if that is negative. So no replay in one
    place is needed: time is cut into days, each day gives its sum and its least running sum, and the days are put in order.
    """
    delta = signed(c("type"), c("quantity").cast("long"))
    each = movements.select("product", "ts", "id", delta.alias("delta"), F.to_date("ts").alias("day"))
    inside = Window.partitionBy("product", "day").orderBy("ts", "id", "delta").rowsBetween(Window.unboundedPreceding, 0)
    days = each.withColumn("upto", F.sum("delta").over(inside)).groupBy("product", "day").agg(F.count("*").alias("n"), F.sum("delta").alias("sum"), F.min("upto").alias("low"))
    before = Window.partitionBy("product").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    placed = days.withColumn("low", F.col("low") + F.coalesce(F.sum("sum").over(before), F.lit(0)))
    return placed.groupBy("product").agg(F.sum("n").alias("n"), (F.sum("sum") - F.least(F.min("low"), F.lit(0))).alias("final_stock"))


def running_stock(movements: DataFrame) -> DataFrame:
    """Every movement with the sum of deltas up to it, without the floor at zero."""
    w = Window.partitionBy("product").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return movements.select("id", "product", F.sum(signed(c("type"), c("quantity").cast("long"))).over(w).alias("balance"))


def variances(products: DataFrame, counted: DataFrame) -> DataFrame:
    """Stocktake differences, those under a thousandth ignored."""
    both = products.select("id", "stock").join(counted, "id").withColumn("variance", c("counted") - c("stock"))
    return both.filter(F.abs("variance") >= 0.001)


def numbered(orders: DataFrame, year: int, start: int = 0, piece: int = 100_000) -> DataFrame:
    """Order numbers PO-<year>-<five digits>, in order of id. Ids are numbered in ranges, each after the counts before it."""
    at = orders.withColumn("__range", F.floor(c("order_id") / piece))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = at.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy("order_id"))
    out = at.withColumn("nth", nth).join(firsts, "__range")
    return out.select("order_id", F.concat(F.lit(f"PO-{year}-"), F.lpad((c("first") + c("nth") + start).cast("string"), 5, "0")).alias("number"))


def product_list(products: DataFrame, needle: str | None = None, category: Any = None, label: str | None = None) -> DataFrame:
    """Optional conditions, all of which must hold."""
    out = products
    if needle:
        out = out.filter(F.lower("name").contains(needle.lower()) | F.lower("category").contains(needle.lower()))
    if category is not None:
        out = out.filter(c("category") == category)
    if label is not None:
        out = out.filter(stock_status() == label)
    return out


def movement_list(movements: DataFrame, products: DataFrame, needle: str, first_day: Any, last_day: Any, type_: str | None = None) -> DataFrame:
    """Text in the product's name or the movement's own, whole days, newest first."""
    days = movements.filter((c("ts") >= F.lit(first_day).cast("timestamp_ntz")) & (c("ts") < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")))
    if type_ is not None:
        days = days.filter(c("type") == type_)
    named = lookup(days, products, "product", "product_name", "")
    return named.filter(F.lower("product_name").contains(needle.lower()) | F.lower("note").contains(needle.lower())).orderBy(c("ts").desc(), "id")


def status_counts(orders: DataFrame, statuses: list[str]) -> DataFrame:
    """A count for every status, those without orders included."""
    every = orders.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(orders.groupBy("status").agg(F.count("*").alias("n"), total(money(c("amount"))).alias("amount")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


def sorted_products(products: DataFrame, by: str, descending: bool = False) -> DataFrame:
    order = {"name": F.lower("name"), "stock": c("stock"), "value": cost_value(), "created": c("created")}[by]
    return products.orderBy(order.desc() if descending else order.asc(), "id")


def child_counts(parents: DataFrame, children: DataFrame, on: str) -> DataFrame:
    """(id, n) for every parent."""
    counts = children.groupBy(c(on).alias("id")).agg(F.count("*").alias("n"))
    return parents.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def severity_counts(found: DataFrame, severities: tuple[str, ...] = ("critical", "warning", "info")) -> DataFrame:
    return found.agg(*(F.count_if(c("severity") == s).alias(s) for s in severities))


def vertical_split(df: DataFrame, key: str, private: list[str]) -> tuple[DataFrame, DataFrame]:
    """Public and private halves of each record, under `<key>-public` and `<key>-private`."""
    public = df.drop(*private).withColumn(key, F.concat(c(key).cast("string"), F.lit("-public")))
    return public, df.select(key, *private).withColumn(key, F.concat(c(key).cast("string"), F.lit("-private")))


def vertical_join(public: DataFrame, private: DataFrame, key: str) -> DataFrame:
    """Whole records of the keys that have both halves."""
    base = lambda df, half: df.withColumn(key, F.regexp_replace(c(key), f"-{half}$", ""))
    return base(public, "public").join(base(private, "private"), key)
