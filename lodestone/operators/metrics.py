"""Operation logs: counters, fixed-bucket latency histograms, audit summaries, health rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: upper bounds of the latency buckets, in microseconds
BOUNDS = (100, 500, 1000, 5000, 10000, 25000, 50000, 100000, 250000, 500000)
OVERFLOW = -1


def bucket(us: Column) -> Column:
    """The first bound that is at least the value; OVERFLOW beyond the last."""
    out = F.when(us <= BOUNDS[0], BOUNDS[0])
    for b in BOUNDS[1:]:
        out = out.when(us <= b, b)
    return out.otherwise(OVERFLOW).cast("int")


def histogram(log: DataFrame, op: str, us: str) -> DataFrame:
    return log.groupBy(op, bucket(F.col(us)).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(log: DataFrame, op: str, us: str, wanted: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Per operation: count, mean, min, max, and for each percentile the bound of the bucket that holds it (the maximum for
    the overflow). One aggregate with a counter for each bucket: no sort, no second shuffle.
    """
    at = bucket(F.col(us))
    counted = log.groupBy(op).agg(F.count("*").alias("n"), F.avg(us).alias("mean_us"), F.min(us).alias("min_us"), F.max(us).alias("max_us"), *(F.count_if(at == b).alias(f"b{i}") for i, b in enumerate(BOUNDS)))
    out = [op, "n", "mean_us", "min_us", "max_us"]
    for p in wanted:
        target, below = F.ceil(F.col("n") * p / 100), F.lit(0)
        column = None
        for i, b in enumerate(BOUNDS):
            below = below + F.col(f"b{i}")
            column = F.when(below >= target, F.lit(b)) if column is None else column.when(below >= target, F.lit(b))
        out.append(column.otherwise(F.col("max_us")).cast("long").alias(f"p{p}_us"))
    return counted.select(*out)


def counters(log: DataFrame, op: str, is_error: Column, size: Column) -> DataFrame:
    grouped = log.groupBy(op).agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"), F.sum(size).alias("bytes"))
    return grouped.withColumn("error_rate", F.try_divide(F.col("errors"), F.col("n")))


def ratio(hits: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(hits / total)


def summary(audit: DataFrame) -> DataFrame:
    """One row of totals over audit entries: sizes, ratios to four places, cache hits over all entries, elapsed milliseconds."""
    original, packed = (F.coalesce(F.sum(c), F.lit(0)) for c in ("original_size", "compressed_size"))
    total = audit.agg(F.count("*").alias("entries"), original.alias("original_bytes"), packed.alias("compressed_bytes"), F.count_if("from_cache").alias("cache_hits"), F.coalesce(F.sum("elapsed_us"), F.lit(0)).alias("us"))
    saved = F.when(F.col("original_bytes") == 0, 0.0).otherwise(1 - F.col("compressed_bytes") / F.col("original_bytes"))
    return total.select("entries", "original_bytes", "compressed_bytes", F.round(saved, 4).alias("compression_ratio"), "cache_hits", (F.col("entries") - F.col("cache_hits")).alias("cache_misses"), F.round(ratio(F.col("cache_hits"), F.col("entries")), 4).alias("cache_hit_ratio"), F.floor(F.col("us") / 1000).alias("elapsed_ms"))


def compression_ratio(original: Column, packed: Column) -> Column:
    return F.when(original != 0, 1 - packed / original)


def recent(audit: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Newest first; an empty log gives nothing."""
    return audit.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(max(n, 0))


def delta(before: DataFrame, after: DataFrame, keys: list[str], counters_: list[str]) -> DataFrame:
    """Counters of one snapshot less those of an earlier one; a counter that is new starts from zero."""
    old = before.select(*keys, *(F.col(c).alias(f"__{c}") for c in counters_))
    return after.join(old, keys, "left").select(*keys, *((F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in counters_))


def saved_bytes(original: Column, stored: Column) -> Column:
    return F.sum(F.greatest(original - stored, F.lit(0)))


def statistics(writes: DataFrame, original: str, stored: str) -> DataFrame:
    one = writes.agg(F.count("*").alias("writes"), F.sum(stored).alias("bytes_written"), saved_bytes(F.col(original), F.col(stored)).alias("bytes_saved"))
    return one.withColumn("compression_ratio", ratio(F.col("bytes_saved"), F.col("bytes_written") + F.col("bytes_saved")))


def health(stats: DataFrame) -> DataFrame:
    """Rules, thresholds and codes. (code, severity) for a row of cache_capacity, reads, hit_ratio, indexed, writes, compression_ratio, algorithm, entries."""
    c = F.col
    busy = (c("cache_capacity") > 0) & (c("reads") > 100)
    rules = [
        (busy & (c("hit_ratio") < 0.5), "LOW_CACHE_HIT_RATIO", "warning"),
        (busy & (c("hit_ratio") >= 0.5), "CACHE_OK", "info"),
        (c("indexed") > 100000, "LARGE_INDEX", "warning"),
        ((c("writes") > 50) & (c("compression_ratio") < 0.1) & (c("algorithm") != "None"), "LOW_COMPRESSION_RATIO", "warning"),
        ((c("entries") == 0) & (c("writes") > 0), "EMPTY", "warning"),
        ((c("entries") > 0) & (c("indexed") < c("entries") * 0.5), "PARTIAL_INDEX", "info"),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for test, code, level in rules)))
    keep = [x for x in stats.columns if x not in ("code", "severity")]
    return stats.select(*keep, F.explode(found).alias("issue")).select(*keep, "issue.code", "issue.severity")


def prometheus(counts: DataFrame, op: str, name: str) -> DataFrame:
    """One row `text` in the exposition format: a sample for each operation, in order of name. Operations are few."""
    line = F.format_string(f'{name}_operations_total{{operation="%s"}} %d', F.col(op), F.col("n"))
    lines = counts.select(line.alias("line")).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    head = f"# HELP {name}_operations_total Total operations by type\n# TYPE {name}_operations_total counter\n"
    return lines.select(F.concat(F.lit(head), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def exposition(log: DataFrame, op: str, us: str, is_error: Column, name: str, uptime_seconds: int) -> DataFrame:
    """One row `text` with all metric families: operations, latency summaries, error rate, uptime. Operations are few."""
    of = percentiles(log, op, us).withColumn("sum_us", F.floor("mean_us") * F.col("n"))
    head = lambda family, text, kind: f"# HELP {name}_{family} {text}\n# TYPE {name}_{family} {kind}\n"
    sample = lambda family, labels, value: F.format_string(f"{name}_{family}{{operation=\"%s\"{labels}}} %d", F.col(op), value)
    counts = sample("operations_total", "", F.col("n"))
    quantiles = [sample("latency_microseconds", f',quantile=\"{q}\"', F.col(p)) for q, p in (("0.5", "p50_us"), ("0.95", "p95_us"), ("0.99", "p99_us"))]
    latency = F.concat_ws("\n", *quantiles, sample("latency_microseconds_sum", "", F.col("sum_us")), sample("latency_microseconds_count", "", F.col("n")))
    lines = of.agg(F.sort_array(F.collect_list(F.struct(F.col(op).alias("op"), counts.alias("counts"), latency.alias("latency")))).alias("x"))
    rate = log.agg(F.coalesce(F.count_if(is_error) / F.count("*"), F.lit(0.0)).alias("rate"))
    both = lines.withColumn("one", F.lit(1)).join(rate.withColumn("one", F.lit(1)), "one")  # two one-row tables
    block = lambda part: F.when(F.size("x") > 0, F.concat(F.array_join(F.transform("x", lambda e: e[part]), "\n"), F.lit("\n"))).otherwise("")
    return both.select(F.concat(
        F.lit(head("operations_total", "Total operations by type", "counter")), block("counts"), F.lit(head("latency_microseconds", "Operation latency", "summary")), block("latency"),
        F.lit(head("error_rate", "Current error rate (0-1)", "gauge")), F.format_string(f"{name}_error_rate %.4f\n", "rate"), F.lit(head("uptime_seconds", "Uptime in seconds", "counter") + f"{name}_uptime_seconds {uptime_seconds}\n"),
    ).alias("text"))


def ring(log: DataFrame, size: int, ts: str, tie: str) -> DataFrame:
    """The last `size` entries: a top-k, which keeps `size` rows for each partition and never sorts the whole log."""
    return log.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(size)


def running(partition: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
