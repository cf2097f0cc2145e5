"""SimHash near-deduplication by covering locality-sensitive hashing (operator 10).

Fingerprints. A-Z become lower case; words are runs without ASCII white space; every run of `shingle` words (all words,
if there are fewer) is hashed with XXH64, seed 42; a bit is set if more than half of the hashes have it. A text
without words, and a null text, has fingerprint zero.

Candidates. Every bit position gets a vector of radius + 1 bits. Each non-zero vector v gives a table, whose mask keeps
the positions with odd inner product with v. The at most `radius` positions in which two fingerprints differ span less
than the whole space, so some v is orthogonal to all of them: in that table the two agree. No pair within the radius
is missed. Equal fingerprints are one node from the start, so groups of copies never meet in a bucket.

Large buckets. A bucket with more fingerprints than `limit` is dealt again by the bits its mask leaves free, in
radius + 1 parts: two fingerprints within the radius agree in one of them. This goes on until the bucket is small; with
log2(limit) free bits left it cannot be larger, since its members differ. No candidate is dropped, and no task gets more
than `limit` fingerprints of a bucket. In a bucket a breadth-first search over exact distances gives a spanning forest,
so a bucket of n emits at most n - 1 links.

Defined cases: a null doc_id takes part with its text but names no component (component_id is null if no other row of
it has an id); repeated rows are repeated in the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, cut, spread_join, table
from .components import components

BITS, RADIUS, SHINGLE, LIMIT = 64, 3, 3, 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, 42)).astype(np.int64))
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, ends)], ">u8", len(starts))
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint) for every row."""

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks: any `radius` positions or fewer are outside some mask."""
    vectors = range(1, 1 << (radius + 1))
    at = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (at[i] & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refine(radius: int):
    """Deals the members (key, free, fp) of large buckets again, by each of radius + 1 parts of their free bits."""

    def run(batches):
        for batch in batches:
            key, free, fp = (np.asarray(batch.column(i)).view(np.uint64) for i in range(3))
            for mask in np.unique(free):
                at = free == mask
                bits = [i for i in range(BITS) if int(mask) >> i & 1]
                for p in range(radius + 1):
                    part = np.uint64(sum(1 << i for i in bits[p :: radius + 1]))
                    mixed = (key[at] ^ np.uint64(p + 1)) * np.uint64(0x9E3779B97F4A7C15) + (fp[at] & part) * np.uint64(0xC2B2AE3D27D4EB4F)
                    mixed ^= mixed >> np.uint64(29)
                    left = np.full(at.sum(), mask & ~part, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (mixed, left, fp[at])], ["key", "free", "fp"])

    return run


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(node, root) links that connect what pairs within the radius connect: the members of a bucket, searched breadth first."""
    fps = np.unique(fps)
    left = np.ones(len(fps), bool)
    out = []
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[queue.pop()]) <= radius))
            left[near] = False
            queue += near.tolist()
            out += [(j, i) for j in near.tolist()]
    signed = fps.view(np.int64)
    return [(int(signed[j]), int(signed[i])) for j, i in out]


def _links(radius: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            lists = batch.column(0)
            values, offsets = np.asarray(lists.values).view(np.uint64), lists.offsets.to_numpy()
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if e - s == 2:
                    if int(values[s] ^ values[s + 1]).bit_count() <= radius:
                        a.append(int(values[s].astype(np.int64)))
                        b.append(int(values[s + 1].astype(np.int64)))
                    continue
                for x, y in forest(values[s:e], radius):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of nodes (fp bigint) that connect every pair within the radius."""
    tables = F.array(*(F.struct(F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key"), F.lit(_signed(~m & (1 << 64) - 1)).alias("free")) for v, m in enumerate(covering_masks(BITS, radius))))
    rows = nodes.select("fp", F.explode(tables).alias("t")).select("t.key", "t.free", "fp")
    out = None
    while True:
        hot = cut(rows.groupBy("key").count().filter(F.col("count") > limit).select("key"), "hot")
        found = not hot.isEmpty()
        cold = rows.join(hot, "key", "left_anti") if found else rows
        part = cold.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps").mapInArrow(_links(radius), "a bigint, b bigint")
        out = part if out is None else out.unionByName(part)
        if not found:
            return out
        rows = cut(rows.join(hot, "key", "left_semi").select("key", "free", "fp").mapInArrow(_refine(radius), "key bigint, free bigint, fp bigint"), "refined")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id for every row; the component is named by its smallest doc_id."""
    marked = cut(fingerprints(docs, shingle), "fingerprints")
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    roots = cut(components(links(groups.select("fp"), radius, limit)), "roots").withColumnRenamed("node", "fp")
    # only linked fingerprints go through the components; all others are their own
    linked = cut(groups.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "linked")
    named = cut(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "named")
    of = cut(spread_join(linked.select("fp", "n", "root"), named, "root", "size", hot).select("fp", "n", "component_id"), "components")
    return spread_join(marked, of, "fp", "n", hot).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
