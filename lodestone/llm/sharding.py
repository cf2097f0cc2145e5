"""Sharding by histogram sort (operator 6), in DataFrame operations only.

Rows are ordered by a 64-bit key: the upper 40 bits hash the text, the lower 24 the id. Rows with equal texts (a group)
are therefore neighbours, and a group is cut only where it is so large that no border between groups is near enough to
an ideal one. The n - 1 splitters between shards are found as in histogram sort: each round counts, on all partitions,
the exact bytes below candidate borders (12 more bits of the key, only in the bins that still hold an unsettled
splitter), until every splitter is within the tolerance of its ideal byte position or its bin is a single key. The
counts are summed before their shuffle and number at most 4096 per splitter, whatever the input. Only then do the rows
go through an exchange, once, as (doc_id, size, crc, key) without their texts.

Slots. A shard is numbered in pieces (hash of the id): each piece is numbered alone and starts after the pieces before
it, so that no task has to hold a whole shard; the pieces' counts are a small table.

Defined cases: a null text has no bytes and the checksum of the empty text; a null doc_id is kept; rows with equal keys
(same id and text) stay in one shard and are numbered in any order, which the result does not show; an empty table gives
an empty result; empty shards appear where there are fewer keys than shards; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS, ROW_BYTES, ID_BITS, STEP = 40, 16, 24, 12
#: A splitter may miss its ideal position by this share of a shard.
TOLERANCE = 0.001
#: And by this share if that saves a group of equal texts from being cut.
GROUP_TOLERANCE = 0.05
#: Rows that one task numbers.
PIECE_ROWS = 250_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (unsigned order, shifted so that signed comparison agrees)."""
    text = F.coalesce("text", F.lit(""))
    low = (1 << ID_BITS) - 1
    key = F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).bitwiseAND(F.lit(low)))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> tuple[list[int], int]:
    """The least key of each shard from 1 on, for bytes as equal as the keys allow; and the number of rows."""
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    found: dict[int, int] = {}
    # open bins: (first key, bits left below its prefix) -> bytes before the bin; one for each unsettled splitter at most
    bins, waiting = {-(1 << 63): 0}, {-(1 << 63): list(range(1, shards))}
    bits = 64
    while waiting and total:
        step = min(STEP, bits - ID_BITS if bits > ID_BITS else bits)
        prefix = F.shiftright("key", bits) if bits < 64 else F.lit(0).cast("long")
        inside = rows if bits == 64 else rows.filter(prefix.isin([k >> bits for k in waiting]))
        bits -= step
        counted = inside.groupBy(F.shiftright("key", bits).alias("bin")).agg(F.sum("size").alias("bytes")).collect()  # 4096 rows for each splitter at most
        by_bin: dict[int, list[tuple[int, int]]] = {}
        for r in counted:
            by_bin.setdefault((r["bin"] << bits) >> (bits + step) << (bits + step) if bits + step < 64 else -(1 << 63), []).append((r["bin"] << bits, r["bytes"]))
        within = max(tolerance, group_tolerance) if bits == ID_BITS else tolerance
        next_bins, next_waiting = {}, {}
        for first, targets in waiting.items():
            below, parts, at = bins[first], sorted(by_bin[first]), 0
            for j in targets:
                goal = total * j / shards
                while at < len(parts) - 1 and below + parts[at][1] < goal:
                    below += parts[at][1]
                    at += 1
                start, size = parts[at]
                after = parts[at + 1][0] if at + 1 < len(parts) else start + (1 << bits)
                near, miss = (start, goal - below) if goal - below <= below + size - goal else (after, below + size - goal)
                if abs(miss) <= within * total / shards or bits == 0:
                    found[j] = near
                else:
                    next_bins[start] = below
                    next_waiting.setdefault(start, []).append(j)
        bins, waiting = next_bins, next_waiting
    return [found.get(j, (1 << 63) - 1) for j in range(1, shards)], count


def shard_documents(docs: DataFrame, shards: int = SHARDS, *, tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row, bytes per shard near equal."""
    rows = cut(sized(docs), "sized")
    borders, count = splitters(rows, shards, tolerance)
    # a splitter past the last key does not fit a long: it lets no row through
    passed = [F.when(F.col("key") >= F.lit(b), 1).otherwise(0) for b in borders if b < 1 << 63]
    pieces = max(1, -(-count // (shards * piece_rows)))
    shard = sum(passed[1:], passed[0]) if passed else F.lit(0)
    dealt = rows.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(pieces)).cast("int").alias("piece"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n")).select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("key", "doc_id", "text_crc32"))
    return dealt.withColumn("nth", within).join(starts, ["shard", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
