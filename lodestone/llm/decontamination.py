"""Benchmark decontamination by SimHash windows (operator 1).

Texts are compared as words: lower case, without ASCII punctuation, so that a passage is found in other line breaks or
decoration. For a benchmark item of n words every window of n words of a document is a candidate (the whole document, if it
is shorter). Shingles are five words (all words of an item with fewer), as 64-bit hashes; a shingle weighs one over the number
of items of the whole benchmark that have it. The similarity of a window is the weight of the item's shingles that it holds
(each counted as often as in both) over the weight of all of the item's shingles; from 0.8 on it is a match.

Candidates. The fingerprint of an item or a window is the 64-bit SimHash of its weighted shingles; words that no item has do
not vote. Fingerprints are looked up in a multi-index: both are cut into four blocks of 16 bits, and two fingerprints that
differ in at most `RADIUS` = 15 bits agree in one block up to three bits. An item stands in each block's table under its value
and the 16 values one bit away; a window is looked up under its value and the 136 values up to two bits away. So every
fingerprint within the radius is found, and of 10^5 random ones each block meets about one in a hundred. A window with 0.8 of
equally weighted shingles is 9 bits away on average (deviation 3). Uneven weights spread farther, so items are candidates, too, if
a document holds one of their heaviest shingles, that make up just over 0.2 of their weight: without any of these no window
reaches 0.8, so no match is lost. Candidates are verified exactly, in all of their windows.

Only windows with shingles of an item of their size are fingerprinted; the others' similarity is zero. The index is numpy
arrays, about 8 times its items' texts. Items go to the workers in blocks of `BLOCK_BYTES` of text, each of which meets all
documents (one pass over them for benchmarks up to that size); documents are never shuffled.

Defined cases: null and empty texts and items match nothing; equal items each match; a repeated row is reported for each
repetition; of several windows the one with the highest similarity (to twelve digits), then least distance, then first position
is reported; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import bound_batches, cut, release, table

SHINGLE, SIMILARITY = 5, 0.8
#: Blocks of a fingerprint, and the bits that may differ in one, on the side of the items and on that of the windows.
BLOCKS, ITEM_BITS, WINDOW_BITS = 4, 1, 2
BLOCK = 64 // BLOCKS
RADIUS = BLOCKS * (ITEM_BITS + WINDOW_BITS + 1) - 1
#: Text of an item block; larger benchmarks take more passes.
BLOCK_BYTES = 32 << 20
#: Windows that are fingerprinted at once.
PART = 4096
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(None, PUNCTUATION).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, from the words' hashes."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, size, np.uint64)
    for i in range(size):
        h = (h ^ words[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def item_shingles(text: str | None) -> tuple[int, int, np.ndarray]:
    """Words, shingle size and shingle hashes of an item."""
    words = word_hashes(words_of(text))
    size = min(SHINGLE, len(words))
    return len(words), size, shingle_hashes(words, size) if size else np.zeros(0, np.uint64)


def votes(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of 64 votes for each shingle: its weight, in whole units so that sums are exact, with the sign of the bit."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    return (2 * bits - 1) * np.rint(weights * (1 << 20)).astype(np.int64)[:, None]


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of summed votes."""
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64).ravel()


def near_values(bits: int) -> np.ndarray:
    """All differences of up to `bits` bits in a block."""
    return np.array([sum(1 << i for i in at) for n in range(bits + 1) for at in combinations(range(BLOCK), n)], np.uint32)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, position) of all positions in the ranges."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which]


class MultiIndex:
    """Finds all stored fingerprints within RADIUS bits of others."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        near = near_values(ITEM_BITS)
        for b in range(BLOCKS):
            values = (self._block(prints, b)[:, None] ^ near).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((np.searchsorted(values[order], np.arange((1 << BLOCK) + 1)), (order // len(near)).astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK)) & np.uint64((1 << BLOCK) - 1)).astype(np.uint32)

    def met(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of prints, stored ones) that meet in a block; with repetitions."""
        near = near_values(WINDOW_BITS)
        for b, (starts, items) in enumerate(self.tables):
            values, own = np.unique(self._block(prints, b), return_inverse=True)
            probes = (values[:, None] ^ near).ravel()
            probe, at = ranges(starts[probes], starts[probes + 1])
            of_value, item = probe // len(near), items[at]
            # from values to the rows that have them
            order = np.argsort(own, kind="stable")
            first = np.searchsorted(own[order], np.arange(len(values) + 1))
            pair, at = ranges(first[of_value], first[of_value + 1])
            yield order[at], item[pair]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of prints, stored one) of all pairs within the radius."""
        found = []
        for row, item in self.met(prints):
            ok = np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS
            found.append(row[ok].astype(np.int64) * len(self.prints) + item[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


class Sizes:
    """The items of one shingle size. Equal items are one node."""

    def __init__(self, size: int, items: list[tuple[int, int, np.ndarray, np.ndarray]], similarity: float):
        """items: place, words, shingles, and how many items have each of the distinct shingles in the order of their first places."""
        self.size, self.similarity = size, similarity
        nodes: dict[bytes, int] = {}
        of = np.array([nodes.setdefault(s.tobytes(), len(nodes)) for _, _, s, _ in items])
        order = np.argsort(of, kind="stable")
        #: the places of a node's items: places[first[node] : first[node + 1]]
        self.first, self.places = np.searchsorted(of[order], np.arange(len(nodes) + 1)), np.array([i for i, *_ in items])[order]
        kept = [items[i] for i in order[self.first[:-1]].tolist()]
        self.words = np.array([n for _, n, _, _ in kept])
        self.known, at = np.unique(np.concatenate([s for _, _, s, _ in kept]), return_inverse=True)
        self.weight = np.zeros(len(self.known))
        ends, start = np.cumsum([len(s) for _, _, s, _ in kept]), 0
        shingles, counts, heaviest = [], [], []
        self.total = np.zeros(len(kept))
        sums = np.zeros((len(kept), 64), np.int64)
        for node, (end, (_, _, s, having)) in enumerate(zip(ends.tolist(), kept)):
            own, place, n = np.unique(at[start:end], return_index=True, return_counts=True)
            weights = 1 / having[np.argsort(np.argsort(place))]  # having follows the first places
            self.weight[own] = weights
            self.total[node] = (weights * n).sum()
            sums[node] = (votes(self.known[own], weights) * n[:, None]).sum(axis=0)
            by_weight = np.argsort(-weights, kind="stable")
            enough = np.searchsorted(np.cumsum((weights * n)[by_weight]), (1 - similarity + 1e-6) * self.total[node], side="right") + 1
            heaviest.append(own[by_weight[:enough]])
            shingles.append(own.astype(np.int32))
            counts.append(n.astype(np.int32))
            start = end
        self.index = MultiIndex(fingerprints(sums))
        self.starts = np.cumsum([0, *map(len, shingles)])
        self.shingles, self.counts = np.concatenate(shingles), np.concatenate(counts)
        node, heavy = np.repeat(np.arange(len(kept)), list(map(len, heaviest))), np.concatenate(heaviest)
        order = np.argsort(heavy, kind="stable")
        #: the nodes of which a shingle is one of the heaviest: heavy_of[heavy_at[shingle] : heavy_at[shingle + 1]]
        self.heavy_at, self.heavy_of = np.searchsorted(heavy[order], np.arange(len(self.known) + 1)), node[order].astype(np.int32)
        #: which upper bits of a hash a known shingle has
        self.shift = np.uint64(64 - min(26, max(16, len(self.known).bit_length() + 4)))
        self.seen = np.zeros(1 << 64 - int(self.shift), bool)
        self.seen[self.known >> self.shift] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, known shingle) of the document's shingles that items have."""
        h = shingle_hashes(words, self.size)
        at = np.flatnonzero(self.seen[h >> self.shift])
        if not len(at):
            return at, at
        known = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        ok = self.known[known] == h[at]
        return at[ok], known[ok]

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(place of the item, first word, distance, similarity) of every item that the document holds."""
        at, known = self.hits(words)
        if not len(at):
            return
        which, of = ranges(self.heavy_at[known], self.heavy_at[known + 1])
        nodes = self.heavy_of[of]
        candidates = set(np.unique(nodes).tolist())
        for n in np.unique(self.words[nodes]).tolist():
            candidates |= self._within_radius(n, len(words), at, known, at[which[self.words[nodes] == n]])
        for node in sorted(candidates):
            found = self._best(node, len(words), at, known)
            if found:
                for place in self.places[self.first[node] : self.first[node + 1]].tolist():
                    yield place, *found

    def _span(self, n: int, n_words: int) -> tuple[int, int]:
        """Shingles in a window of n words, and its last start."""
        width = min(n, n_words)
        return width - self.size + 1, n_words - width

    def _prints(self, starts: np.ndarray, span: int, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows at starts, which lie near one another."""
        low, high = np.searchsorted(at, (starts[0], starts[-1] + span))
        part = known[low:high]
        sums = np.zeros((len(part) + 1, 64), np.int64)
        np.cumsum(votes(self.known[part], self.weight[part]), axis=0, out=sums[1:])
        return fingerprints(sums[np.searchsorted(at[low:high], starts + span)] - sums[np.searchsorted(at[low:high], starts)])

    def _within_radius(self, n: int, n_words: int, at: np.ndarray, known: np.ndarray, near: np.ndarray) -> set[int]:
        """Nodes of n words whose fingerprint is within the radius of a window that holds one of the positions near."""
        span, last = self._span(n, n_words)
        found: set[int] = set()
        for starts in parts(window_starts(np.unique(near), span, last)):
            _, node = self.index.within(np.unique(self._prints(starts, span, at, known)))
            found.update(node[self.words[node] == n].tolist())
        return found

    def _best(self, node: int, n_words: int, at: np.ndarray, known: np.ndarray) -> tuple[int, int, float] | None:
        """First word, distance and similarity of the document's best window for an item, if it is similar enough."""
        own = self.shingles[self.starts[node] : self.starts[node + 1]]
        most = self.counts[self.starts[node] : self.starts[node + 1]]
        place = np.minimum(np.searchsorted(own, known), len(own) - 1)
        mine = own[place] == known
        at_, place = at[mine], place[mine]
        weights, least = self.weight[own][place], (self.similarity - 1e-9) * self.total[node]
        if weights.sum() < least:
            return None
        span, last = self._span(int(self.words[node]), n_words)
        sums = np.concatenate(([0.0], np.cumsum(weights)))
        often = np.bincount(place, minlength=len(own)) > most  # in the whole document
        best: tuple[float, int, int] | None = None
        for starts in parts(window_starts(np.unique(at_), span, last)):
            low, high = np.searchsorted(at_, starts), np.searchsorted(at_, starts + span)
            held = sums[high] - sums[low]
            ok = held >= least - 1e-9
            starts, low, high, held = starts[ok], low[ok], high[ok], held[ok]
            if often.any():
                held = np.array([self._held(place[a:b], most, self.weight[own]) for a, b in zip(low.tolist(), high.tolist())])
            if not len(held):
                continue
            value = np.round(held / self.total[node], 12)
            top = starts[value == value.max()]
            if value.max() < self.similarity - 1e-9 or (best and value.max() < best[0]):
                continue
            distance = np.bitwise_count(self._prints(top, span, at, known) ^ self.index.prints[node]).astype(int)
            found = (float(value.max()), -int(distance.min()), -int(top[distance.argmin()]))
            best = max(best, found) if best else found
        return (-best[2], -best[1], best[0]) if best else None

    @staticmethod
    def _held(place: np.ndarray, most: np.ndarray, weight: np.ndarray) -> float:
        """Weight of an item's shingles in a window, each as often as in both."""
        own, n = np.unique(place, return_counts=True)
        return float((np.minimum(n, most[own]) * weight[own]).sum())


def window_starts(near: np.ndarray, span: int, last: int) -> np.ndarray:
    """The starts of all windows that hold one of the positions near (sorted, distinct)."""
    starts = np.maximum(near - span + 1, 0)
    ends = np.minimum(near, last) + 1
    starts[1:] = np.maximum(starts[1:], ends[:-1])  # without those of the position before
    ok = ends > starts
    return ranges(starts[ok], ends[ok])[1]


def parts(starts: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of starts without wide gaps and of at most PART windows."""
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 256) + 1):
        for k in range(0, len(run), PART):
            yield run[k : k + PART]


class Index:
    """A block of benchmark items: id, text, and how many items of the whole benchmark have each of its distinct shingles."""

    def __init__(self, items: list[tuple[object, str, list[int]]], id_type: DataType, similarity: float = SIMILARITY):
        self.ids = pa.array([i for i, _, _ in items], to_arrow_type(id_type))
        by_size: dict[int, list] = {}
        for place, (_, text, having) in enumerate(items):
            n, size, shingles = item_shingles(text)
            if n:
                by_size.setdefault(size, []).append((place, n, shingles, np.array(having)))
        self.sizes = [Sizes(size, of, similarity) for size, of in sorted(by_size.items())]

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(place of the item in ids, first word, distance, similarity) of every item that the text holds."""
        words = word_hashes(words_of(text)) if text else ()
        return list(chain.from_iterable(s.matches(words) for s in self.sizes)) if len(words) else []


def distinct_shingles(text: Column) -> Column:
    """An item's distinct shingles in the order of their first places."""

    @F.arrow_udf("array<bigint>")
    def make(batch: pa.Array) -> pa.Array:
        return pa.array([list(dict.fromkeys(item_shingles(t.as_py())[2].view(np.int64).tolist())) for t in batch], pa.list_(pa.int64()))

    return make(text.cast("string"))


def counted(benchmark: DataFrame) -> DataFrame:
    """item_id, text, and in how many items of the whole benchmark each of the item's distinct shingles is (null without words)."""
    items = cut(benchmark.select("item_id", "text", F.monotonically_increasing_id().alias("rid")).filter("text IS NOT NULL"), "items")
    shingles = cut(items.select("rid", F.posexplode(distinct_shingles(F.col("text"))).alias("at", "g")), "item-shingles")
    counts = shingles.join(shingles.groupBy("g").agg(F.count("*").alias("n")), "g")
    having = counts.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("having"))
    return items.join(having, "rid", "left").select("item_id", "text", F.col("having.n").alias("having"))


def item_blocks(benchmark: DataFrame, max_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes over item_id and text; the driver holds one block's texts at a time."""
    block, size = [], 0
    rows = counted(benchmark)
    id_type = rows.schema["item_id"].dataType
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"], r["having"]))
        size += len(r["text"].encode())
        if size >= max_bytes:
            yield Index(block, id_type)
            block, size = [], 0
    if block:
        yield Index(block, id_type)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, distance, similarity for every document row and item that it holds."""
    spark = docs.sparkSession
    doc_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, first_word bigint, distance int, similarity double"
    out = None
    for index in item_blocks(benchmark):
        spec = spark.sparkContext.broadcast(index)

        def run(batches, spec=spec):
            for batch in batches:
                rows = [(i, *m) for i, t in enumerate(batch.column(1)) for m in spec.value.matches(t.as_py())]
                at, item, first, distance, similarity = map(list, zip(*rows)) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), spec.value.ids.take(pa.array(item, pa.int64())), pa.array(first, pa.int64()), pa.array(distance, pa.int32()), pa.array(similarity, pa.float64())], ["doc_id", "item_id", "first_word", "distance", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def contaminated(text: Column, index) -> Column:
    """Whether a text holds an item of the broadcast index."""

    @F.arrow_udf("boolean")
    def holds(batch: pa.Array) -> pa.Array:
        release()
        return pa.array([bool(index.value.matches(t.as_py())) for t in batch], pa.bool_())

    return holds(text.cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with docs' columns."""
    bound_batches(docs.sparkSession)
    for index in item_blocks(benchmark):
        docs = docs.filter(~contaminated(F.col("text"), docs.sparkSession.sparkContext.broadcast(index)))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
