"""From raw documents to token ids, in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame.

The stages keep the columns of documents, but for the last one, which puts token ids in place of the text.

A stage's result is lazy and reads the working tables that the stage wrote; calls do not know of each other, so that a
stage can be applied to several inputs at once. Its tables go when the application ends. `run` writes each result before the
next stage begins and deletes what the result was made from right then: the disk never holds more than one stage's copies.

Defined cases: documents with a null or empty text, or without words, fail the quality rules; rows that repeat and copies
under other ids leave one row, that of the smallest doc_id; a row without a doc_id stays only if no row with an id is its near
copy; null lang and source are values like others; an empty documents or benchmark table is no error; further columns of
documents are kept, whatever their names, but for `text`, `n_tokens`, `ids` and `decodes`, which the last stage replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontamination, near_copies, pii, quality_rules
from lodestone.llm.common import cut, delete_tables, table, working_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("bpe", tokenize),
]

#: Fingerprints, the random field and token merges have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, apply in STAGES:
        with working_tables() as written:
            docs = cut(apply(spark, docs, sf_dir), f"stage-{name}")
        delete_tables(spark, [*written[:-1], *before])
        before = [written[-1]]
    return docs
