"""Change streams: a table of (key, type, ts) rows that grows, read as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch_all(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def watch_keys(changes: DataFrame, keys: Iterable[object], key: str = "key") -> DataFrame:
    return changes.filter(F.col(key).isin(list(keys)))


def watch_table(changes: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """A key set too large for a list: a semi join of the stream with a table."""
    return changes.join(keys.select(key), key, "left_semi")


def events_of(saved: DataFrame, type_: str, ts: str, key: str = "key") -> DataFrame:
    """One event for each key of a batch."""
    return saved.select(F.col(key), F.lit(type_).alias("type"), F.col(ts).alias("ts"))


def snapshots(log: DataFrame, ts: str, every: str, op: str, late: str | None = None) -> DataFrame:
    """Tumbling counters of an operation log, the same for batch and stream; late rows are dropped after `late` on a stream."""
    if late is not None:
        log = log.withWatermark(ts, late)
    return log.groupBy(F.window(ts, every), op).agg(F.count("*").alias("n"))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there in micro-batches and stops; a restart goes on after the last committed batch."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def purge_each_batch(records_path: str, ttl: DataFrame, now: Callable[[], object]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps only the records that have not expired when the batch runs, in a folder for each batch: one that is replayed replaces its rows."""

    def sink(batch: DataFrame, number: int) -> None:
        gone = ttl.filter(F.col("expire_at") < F.lit(now())).select("key")
        batch.join(gone, "key", "left_anti").write.mode("overwrite").parquet(f"{records_path}/batch={number}")

    return sink
