"""Near-deduplication at a similarity (operator 10, the form that the pipeline uses).

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. SimHash alone
cannot find them: over 3-word shingles only a seventh of the pairs at 0.8 and a third of those at 0.9 differ in three bits
or fewer (README), and covering a radius that holds them all (18 bits) would take 2^19 tables. So the covering tables of
`simhash` are joined by 32 bands of five min-hashes, of which a pair at 0.8 shares one with probability 0.99999. These only
name candidates: every link is decided on the two whole shingle sets (as 64-bit hashes).

Texts with the same words are one node from the start. Nodes that buckets connect form a candidate group. A group's sets
meet in one task, where a breadth-first search over exact similarities links what belongs together: n - 1 links at most, and
no all-pairs output. A group of more than `limit` nodes is first dealt into chunks by hash, each of which also gets the same
`PIVOTS` nodes of the group, through which the chunks of a dense group hang together. Then the buckets that still hold nodes
of more than one part are searched, each whole. The nodes of buckets above the limit meet in blocks, chunk against chunk, so
that no pair of a bucket is left out; only the nodes of a group's largest part, which are linked already, need not meet each
other. A group of m such nodes besides its largest part thus costs m / 1024 copies of its sets.

Defined cases: texts of fewer than five words have one shingle, all their words; texts without words (null texts too) are
copies of one another; a row without doc_id stays only if its group has no other; of rows with equal ids one stays; an empty
table gives an empty result; columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bound_batches, cut, release
from .components import components

SHINGLE, SIMILARITY, BANDS, ROWS, LIMIT, PIVOTS = 5, 0.8, 32, 5, 2048, 32
_RNG = np.random.default_rng(2)
_MULTIPLY = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MASKS = simhash.covering_masks()


def min_hashes(words: list[bytes]) -> np.ndarray:
    """BANDS * ROWS minima over the hashes of the text's shingles."""
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh32_intdigest(b" ".join(words))]
    else:
        joined, digest = b" ".join(words), xxhash.xxh32_intdigest
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        hashes = [digest(joined[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    h = np.unique(np.array(hashes, np.uint32))
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 1024):
        np.minimum(least, (h[k : k + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles."""
    words = (text or "").encode().lower().split()
    runs = (words[i : i + SHINGLE] for i in range(max(1, len(words) - SHINGLE + 1)))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(r)) for r in runs], np.uint64))


def sketch(text: str | None) -> tuple[int, list[int]]:
    """The node of a text, and the keys of its buckets in all tables."""
    words = (text or "").encode().lower().split()
    bands = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(min_hashes(words).reshape(BANDS, ROWS))]
    fp = simhash.fingerprint(text) & (1 << 64) - 1
    tables = [xxhash.xxh64_intdigest((fp & m).to_bytes(8, "big"), 1000 + i) for i, m in enumerate(_MASKS)]
    keys = np.array(bands + tables, np.uint64).view(np.int64).tolist()
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 5)).astype(np.int64)), keys


def sketched(text):
    @F.arrow_udf("struct<node: bigint, keys: array<bigint>>")
    def make(batch: pa.Array) -> pa.Array:
        release()
        node, keys = map(list, zip(*(sketch(t.as_py()) for t in batch))) if len(batch) else ([], [])
        return pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    return make(text.cast("string"))


def shingled(text):
    @F.arrow_udf("binary")
    def make(batch: pa.Array) -> pa.Array:
        release()
        flat, ends = bytearray(), [0]
        for t in batch:
            flat += shingle_set(t.as_py()).tobytes()
            ends.append(len(flat))
        return pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(flat)])

    return make(text.cast("string"))


def spanning_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (row numbers) that connect what the pairs of at least the Jaccard similarity connect. No set is empty."""
    sizes = np.array([len(x) for x in sets])
    every, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    held = np.zeros(len(every), bool)
    left, starts, alive, out = np.arange(len(sets)), ends - sizes, np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not alive[first]:
            continue
        alive[first] = False
        queue = [first]
        while queue and alive.any():
            if 2 * alive.sum() < len(left):
                left = np.flatnonzero(alive)
                flat = np.concatenate([own[i] for i in left.tolist()])
                starts = np.cumsum(sizes[left]) - sizes[left]
            at = queue.pop()
            held[own[at]] = True
            shared = np.add.reduceat(held[flat], starts, dtype=np.int64)
            held[own[at]] = False
            near = left[(shared / (sizes[left] + sizes[at] - shared) >= similarity) & alive[left]]
            alive[near] = False
            queue += near.tolist()
            out += [(at, i) for i in near.tolist()]
    return out


def _linked(similarity: float):
    def run(batches):
        for batch in batches:
            release()
            a, b = [], []
            for members in batch.column(0):
                rows = members.as_py()
                for i, j in spanning_forest([np.frombuffer(r["shingles"], np.uint64) for r in rows], similarity):
                    a.append(rows[i]["node"])
                    b.append(rows[j]["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within each bucket of members (bucket, node, shingles)."""
    gathered = members.groupBy("bucket").agg(F.collect_list(F.struct("node", "shingles")).alias("members")).filter(F.size("members") > 1)
    return gathered.select("members").mapInArrow(_linked(similarity), "a bigint, b bigint")


def _dealt(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """rows (key, node, n and others) with the column bucket: keys of n > limit rows are dealt into chunks that share pivots; n counts only beyond the limit."""
    chunks = F.ceil(F.col("n") / max(1, limit - 2 * PIVOTS))
    own = F.array(F.pmod(F.xxhash64("node", key), chunks))
    pivot = F.pmod(F.xxhash64("node", F.lit(9)), F.ceil(F.col("n") / PIVOTS)) == 0
    chunk = F.when(F.col("n") <= limit, F.array(F.lit(0).cast("bigint"))).when(pivot, F.sequence(F.lit(0).cast("bigint"), chunks - 1)).otherwise(own)
    return rows.withColumn("chunk", F.explode(chunk)).withColumn("bucket", F.xxhash64(key, "chunk"))


def _blocks(hot: DataFrame, limit: int) -> DataFrame:
    """(bucket, node) blocks of hot (group, node, part), a written table, in which all nodes of a group meet that can be in different parts."""
    side = max(1, limit // 2)
    sizes = hot.groupBy("group", "part").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    sizes = sizes.select("group", "main", F.ceil((F.col("n") - F.col("most")) / side).alias("others"), F.ceil(F.col("most") / side).alias("mains"))
    at, zero, one = F.col("at"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    in_main = F.col("part") == F.col("main")
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(11)), n)
    placed = hot.join(sizes, "group").withColumn("at", F.when(in_main, F.col("others") + deal(F.col("mains"))).otherwise(deal(F.col("others"))))
    # the main part's chunks come after the others' and meet those alone
    meets = F.when(in_main, F.sequence(zero, F.col("others") - one)).otherwise(F.sequence(zero, F.col("others") + F.col("mains") - one))
    pairs = placed.filter("others > 0").withColumn("with", F.explode(meets))
    return pairs.select(F.xxhash64("group", F.least(at, "with"), F.greatest(at, "with")).alias("bucket"), "node")


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, group) of the nodes that share a bucket, directly or through others, of nodes (node, keys), a written table of distinct nodes."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").select("key", "least")
    stars = rows.join(cut(shared, "buckets"), "key").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return cut(components(stars).withColumnRenamed("root", "group"), "candidates")


def sized(groups: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, group, n): n is the group's size if that is above the limit, else 0. Large groups are few: as a written table, whose size Spark knows, they go to the nodes, which are not shuffled."""
    large = cut(groups.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > limit), "large-groups")
    return groups.join(large, "group", "left").select("node", "group", F.coalesce("n", F.lit(0)).alias("n"))


def links(nodes: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between near copies among sets (node, group, n, shingles), a written table; nodes (node, keys) are all nodes."""
    out = _verified(_dealt(sets, "group", limit), similarity)
    large = sets.filter(F.col("n") > limit).select("node", "group")
    if large.isEmpty():
        return out
    out = cut(out, "group-links")
    parts = components(out).withColumnRenamed("root", "part")
    # buckets are unfolded behind the joins, which see a node once
    large = cut(large.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")).join(nodes.select("node", "keys"), "node"), "parts")
    met = large.select("group", "node", "part", F.explode("keys").alias("key"))
    open_ = met.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    met = cut(met.join(open_.select("key", "n"), "key"), "open")
    whole = met.filter(F.col("n") <= limit).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    members = whole.select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node"))
    hot = cut(met.filter(F.col("n") > limit).select("group", "node", "part").distinct(), "hot")
    if not hot.isEmpty():
        members = members.unionByName(_blocks(hot, limit))
    buckets = members.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    return out.unionByName(_verified(buckets.join(sets.select("node", "shingles"), "node").select("node", "shingles", F.explode("buckets").alias("bucket")), similarity))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """One row of each group of near copies, with docs' columns: that of the smallest doc_id."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "doc_id", F.monotonically_increasing_id().alias("rid"), sketched(F.col("text")).alias("s"))
    packed = cut(packed, "sketched")  # from here on a row keeps its number
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    nodes = cut(packed.groupBy("s.node").agg(first, F.first("s.keys").alias("keys")), "nodes")
    groups = sized(candidates(nodes), limit)
    texts = packed.select("rid", F.col("row.text").alias("text")).join(nodes.select("node", "first.rid").join(groups, "node"), "rid")
    sets = cut(texts.select("node", "group", "n", shingled(F.col("text")).alias("shingles")), "shingles")
    roots = cut(components(links(nodes, sets, similarity, limit)), "roots")
    grouped = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return packed.join(grouped.select("first.rid"), "rid", "left_semi").select(*(F.col(f"row.`{c}`") for c in names))
