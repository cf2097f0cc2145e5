"""Token search: over texts in one pass, over a derived index, and over a kept one (`TokenIndex`) that is updated in place."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DIACRITICS, MIN_LENGTH, SEPARATORS, TATWEEL, normalise_query, query_tokens, tokens


def postings(records: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(token, key), one row for each token of each record."""
    return records.select(F.explode(tokens(F.col(text), **options)).alias("token"), F.col(key).alias("key"))


def matches_all(found: Column, query: str) -> Column:
    """Whether an array of tokens holds every token of the search. A search without tokens finds nothing."""
    wanted = query_tokens(query)
    # one use of `found`, so that the tokens are made once
    return F.size(F.array_intersect(found, F.array(*map(F.lit, wanted)))) == len(wanted) if wanted else F.lit(False)


def matches_any(found: Column, query: str) -> Column:
    wanted = query_tokens(query)
    return F.arrays_overlap(found, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def matches_prefix(found: Column, prefix: str) -> Column:
    """Whether a token begins with the whole normalised search, which finds nothing if it is too short or holds a separator."""
    wanted = normalise_query(prefix)
    return F.exists(found, lambda t: t.startswith(wanted)) if len(wanted) >= MIN_LENGTH else F.lit(False)


_TESTS = {"all": matches_all, "any": matches_any, "prefix": matches_prefix}


def may_match(text: Column, query: str, how: str) -> Column:
    """False only for texts that cannot match: those without the search's tokens between separators. Marks that
    normalisation drops could hide one, so texts with such marks pass.
    """
    wanted = [normalise_query(query)] if how == "prefix" else query_tokens(query)
    if not any(wanted):
        return F.lit(False)
    # a token stands between separators; a prefix only behind one
    inside = SEPARATORS.replace("[^", "[").removesuffix("+")
    held = [F.lower(text).rlike(f"(?<!{inside}){re.escape(t)}" + ("" if how == "prefix" else f"(?!{inside})")) for t in wanted if t]
    return reduce(and_ if how == "all" else or_, held) | text.rlike(f"{DIACRITICS}|{TATWEEL}")


def search(records: DataFrame, text: str, query: str, how: str = "all") -> DataFrame:
    """Records found by one pass over their texts, without a shuffle; only texts that may match are cut into tokens."""
    return records.filter(may_match(F.col(text), query, how) & _TESTS[how](tokens(F.col(text)), query))


def search_keys(index: DataFrame, query: str, how: str = "all") -> DataFrame:
    """Keys found in a postings table: division for all tokens, union for any, a range of tokens for a prefix."""
    if how == "prefix":
        wanted = normalise_query(query)
        hits = index.filter(F.col("token").startswith(wanted) if len(wanted) >= MIN_LENGTH else F.lit(False))
        return hits.select("key").distinct()
    wanted = query_tokens(query)
    hits = index.filter(F.col("token").isin(wanted) if wanted else F.lit(False))
    if how == "any":
        return hits.select("key").distinct()
    return hits.groupBy("key").agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(wanted)).select("key")


def records_of(records: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return records.join(keys.withColumnRenamed("key", key), key, "left_semi")


def _statistics(keywords: Column, pairs: Column, entries: Column, key_chars: Column, token_bytes: Column) -> list[Column]:
    per_entry = F.when(entries > 0, pairs / entries).otherwise(0.0)
    return [entries.alias("entries"), keywords.alias("keywords"), per_entry.alias("keywords_per_entry"), F.coalesce(token_bytes + pairs * 32 + key_chars * 2 + pairs * 20, F.lit(0)).alias("memory_bytes")]


def index_statistics(index: DataFrame) -> DataFrame:
    """One row: entries, keywords, keywords per entry, and the estimated bytes of an in-memory index of the same content."""
    words = index.groupBy("token").agg(F.count("*").alias("n")).agg(F.count("*").alias("keywords"), F.sum(F.char_length("token") * 2).alias("b"))
    keys = index.groupBy("key").agg(F.count("*").alias("n")).agg(F.count("*").alias("entries"), F.sum("n").alias("pairs"), F.sum(F.char_length("key")).alias("c"))
    # two one-row tables meet on a constant
    both = words.withColumn("one", F.lit(1)).join(keys.withColumn("one", F.lit(1)), "one")
    return both.select(*_statistics(*map(F.col, ("keywords", "pairs", "entries", "c", "b"))))


def record_statistics(records: DataFrame, key: str, text: str, **options) -> DataFrame:
    """index_statistics of the records' index, for distinct keys: one pass over the texts and one shuffle, by token. A record is counted with its first token."""
    found = records.select(F.char_length(F.col(key).cast("string")).alias("chars"), F.posexplode(tokens(F.col(text), **options)).alias("at", "token"))
    first = F.col("at") == 0
    words = found.groupBy("token").agg(F.count("*").alias("n"), F.count_if(first).alias("records"), F.sum(F.when(first, F.col("chars")).otherwise(0)).alias("chars"))
    total = words.agg(F.count("*").alias("keywords"), F.sum("n").alias("pairs"), F.coalesce(F.sum("records"), F.lit(0)).alias("entries"), F.sum("chars").alias("c"), F.sum(F.char_length("token") * 2).alias("b"))
    return total.select(*_statistics(*map(F.col, ("keywords", "pairs", "entries", "c", "b"))))


def dump(index: DataFrame, most: int = 20) -> DataFrame:
    """The first tokens in order, with the number of keys of each."""
    return index.groupBy("token").agg(F.count_distinct("key").alias("n_keys")).orderBy("token").limit(most)


def search_modules(modules: dict[str, tuple[DataFrame, str, str]], query: str, how: str = "all") -> DataFrame:
    """(module, key) found in several boxes, each given as (records, key column, text column)."""
    out = None
    for name, (records, key, text) in modules.items():
        part = search(records, text, query, how).select(F.lit(name).alias("module"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


class TokenIndex:
    """A kept index of a keyed table, with records inserted, replaced and removed.

    Postings lie in `buckets` folders by hash of the token, sorted by it, so that a search reads the folders of its tokens and
    in them the row groups that can hold them. A change appends a generation: the postings of its records, and a row for each key that says
    that older postings of the key no longer count. `rebuild` rewrites what counts as one generation. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, **options):
        self.spark, self.root, self.buckets, self.options = spark, root.rstrip("/"), buckets, options

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def _postings(self) -> DataFrame:
        return self._read("postings", "token string, key string, generation bigint, bucket int")

    def _latest(self) -> DataFrame:
        """(key, generation) of what counts."""
        changes = self._read("changes", "key string, generation bigint, live boolean")
        last = changes.groupBy("key").agg(F.max_by(F.struct("generation", "live"), "generation").alias("last"))
        return last.filter("last.live").select("key", "last.generation")

    def _generation(self) -> int:
        return (self._read("changes", "key string, generation bigint, live boolean").agg(F.max("generation")).first()[0] or 0) + 1

    def _append(self, found: DataFrame, changes: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")
        placed = found.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token")
        placed.write.mode("append").partitionBy("bucket").parquet(f"{self.root}/postings")
        changes.write.mode("append").parquet(f"{self.root}/changes")  # the generation counts from here on

    def insert(self, records: DataFrame, key: str, text: str) -> None:
        """Adds records, or replaces those with the same keys; distinct keys are taken for granted."""
        generation = F.lit(self._generation()).cast("bigint").alias("generation")
        found = postings(records.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")), "key", "text", **self.options)
        self._append(found.select("token", "key", generation), records.select(F.col(key).cast("string").alias("key"), generation, F.lit(True).alias("live")))

    def remove(self, keys: DataFrame, key: str = "key") -> None:
        generation = F.lit(self._generation()).cast("bigint").alias("generation")
        keys.select(F.col(key).cast("string").alias("key"), generation, F.lit(False).alias("live")).write.mode("append").parquet(f"{self.root}/changes")

    def live(self) -> DataFrame:
        """(token, key) of all postings that count."""
        return self._postings().join(self._latest(), ["key", "generation"], "left_semi").select("token", "key")

    def search(self, query: str, how: str = "all") -> DataFrame:
        """(key) found; the buckets of the search's tokens are partition filters."""
        hits = self._postings()
        wanted = query_tokens(query)
        if how != "prefix" and wanted:
            at = self.spark.createDataFrame([(w,) for w in wanted], "token string").select(F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()
            hits = hits.filter(F.col("bucket").isin([r["b"] for r in at]) & F.col("token").isin(wanted))
        elif how == "prefix":
            hits = hits.filter(F.col("token").startswith(normalise_query(query)))
        return search_keys(hits.join(self._latest(), ["key", "generation"], "left_semi").select("token", "key"), query, how)

    def rebuild(self, to: str) -> TokenIndex:
        """A new index at another place with what counts, as one generation."""
        new = TokenIndex(self.spark, to, self.buckets, **self.options)
        generation = F.lit(1).cast("bigint").alias("generation")
        new._append(self.live().select("token", "key", generation), self._latest().select("key", generation, F.lit(True).alias("live")))
        return new
