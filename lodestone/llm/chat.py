"""Chat formatting with cumulative-snapshot collapse (operator 4), in DataFrame operations only.

A logged conversation is a list of turns; services often log a conversation anew after each turn, so that one log
prefixes the next. The prefix of k turns has a rolling hash of 128 bits: the hash of the prefix before it, XOR the hash
of (k, role, text). A conversation whose whole hash and length are also those of a proper prefix of another one is
dropped by an anti-join, and of equal conversations the one with the least id stays. Those left are rendered.

No task holds a whole conversation. Distinct turns are sorted over all partitions by range; a turn's rank follows from its
place in its partition and from the counts of the partitions before, one row for each conversation and partition. Hashes
are rolled in segments of `chunk` ranks and put on top of the totals of the segments before, and a conversation is
rendered in the same segments. Texts take part in no shuffle until the conversations to keep are known; until then 16-byte
content hashes stand for them. Repeated rows, whole hashes and prefixes are reduced to distinct ones, partially before their
shuffle, so that a conversation logged very often meets the anti-join once.

Defined cases: turns follow (turn, role, text), nulls first; a row that repeats another one in all four columns counts
once; a null role or text differs from the empty one when conversations are compared, and is rendered as empty; rows
with a null conv_id form one conversation of their own that takes no part in the collapse, in segments like any other; turns
may be null or equal in any number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

CHUNK = 1024
START, END = "<|im_start|>", "<|im_end|>"


def _content(salt: int) -> Column:
    """Hash of a turn's content; null and empty differ."""
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def ranked(turns: DataFrame, chunk: int) -> DataFrame:
    """The distinct rows of turns, by conv_id and then all columns in their order, with rank k, segment, and their conversation's number of turns n."""
    names = turns.columns
    spread = turns.distinct().repartitionByRange(*names).sortWithinPartitions(*names)
    placed = cut(spread.withColumn("at", F.monotonically_increasing_id()), "sorted")  # the upper 31 bits number the partition
    pieces = placed.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("size"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(F.col("conv_id").alias("of"), "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("low") + 1).alias("shift"), F.sum("size").over(whole).alias("n"))
    met = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.shiftright("at", 33) == F.col("part")))
    k = F.col("at") + F.col("shift")
    return met.select(*names, "n", k.alias("k"), F.floor((k - 1) / F.lit(chunk)).alias("segment"))


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, k, h1, h2: the hash of each prefix of k turns, and n, the conversation's number of turns."""
    # ties of (turn, role, text) are told apart by content; their order only has to be the same everywhere
    slim = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", _content(1).alias("c1"), _content(2).alias("c2"))
    placed = ranked(slim, chunk)
    placed = cut(placed.select("conv_id", "segment", "k", "n", *(F.xxhash64(F.lit(i), "k", "c1", "c2").alias(f"h{i}") for i in (1, 2))), "placed")
    sums = placed.groupBy("conv_id", "segment").agg(*(F.bit_xor(f"h{i}").alias(f"s{i}") for i in (1, 2)))
    ahead = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "segment", *(F.coalesce(F.bit_xor(f"s{i}").over(ahead), F.lit(0)).alias(f"p{i}") for i in (1, 2)))
    rolling = Window.partitionBy("conv_id", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv_id", "segment", "k", "n", *(F.bit_xor(f"h{i}").over(rolling).alias(f"r{i}") for i in (1, 2)))
    return rolled.join(before, ["conv_id", "segment"]).select("conv_id", "k", "n", *(F.col(f"r{i}").bitwiseXOR(F.col(f"p{i}")).alias(f"h{i}") for i in (1, 2)))


def maximal(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id of the conversations that no longer one begins with, one of each set of equals."""
    marks = cut(prefixes(turns, chunk), "prefixes")
    whole = marks.filter("k = n").groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = marks.filter("k < n").select("k", "h1", "h2").distinct()
    return whole.join(inner, ["k", "h1", "h2"], "left_anti").select("conv_id")


def render(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, segment, n_turns, rendered: up to `chunk` turns of a conversation as one text."""
    rows = ranked(turns.select("conv_id", "turn", "role", "text"), chunk)
    gathered = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("k", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n"))
    return gathered.select("conv_id", "segment", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", line), "").alias("rendered"))


def format_conversations(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    kept = cut(maximal(turns, chunk), "kept")
    live = turns.join(kept, "conv_id", "left_semi").unionByName(turns.filter("conv_id IS NULL"))
    return render(live, chunk)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id),
prefix AS (SELECT DISTINCT turns[1:k] AS turns FROM convs, unnest(range(1, len(turns))) AS u(k)),
kept AS (SELECT min(conv_id) AS conv_id FROM convs WHERE turns NOT IN (SELECT turns FROM prefix) GROUP BY turns)
SELECT conv_id, (k - 1) // 1024 AS segment, count(*) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM t WHERE conv_id IN (SELECT conv_id FROM kept) OR conv_id IS NULL) GROUP BY 1, 2
"""
