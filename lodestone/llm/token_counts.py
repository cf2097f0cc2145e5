"""Token counts of documents in flat token files, by a separator scan (operator 5).

A flat token file is a stream of little-endian ids, 16 bits wide or 32 if the vocabulary needs it, in which every document is
followed by an end-of-document id; it has no index. It is stored as numbered blocks of fixed size that do not respect documents. The scan reads each block
once, as one numpy comparison, and needs no block but its own: it gives the lengths of the documents that end in the
block, the first of them without what lies in blocks before, and a summary (separators, ids before the first one, ids after
the last one). A prefix scan over the summaries, about 40 bytes for each block, then gives every block the number of its
first document and the ids that its first document brings along. The scan has two levels, over runs of `RUN` blocks and
then over the runs' summaries, so that no task holds all blocks of a large file.

Defined cases: a null or empty document is a separator alone (0 ids); what follows the last separator is a document that
was cut off, reported with `closed` false if it has ids; a separator's id inside a text counts as a separator, so the
writer encodes special strings as ordinary text; an empty table or file gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, table

END_OF_DOCUMENT = "<|endoftext|>"
#: Ids in a block, and blocks in a run of the prefix scan.
BLOCK, RUN = 1 << 16, 1024


def layout(path: str | None = None, end: str = END_OF_DOCUMENT) -> tuple[int, str]:
    """The separator's id and the numpy type of an id, from the vocabulary; an error if it has no such special token."""
    size, special = bpe.id_range(path or bpe.default_path())
    if end not in special:
        raise ValueError(f"the vocabulary has no special token {end}")
    return special[end], "<u2" if size <= 1 << 16 else "<u4"


def write_flat(docs: DataFrame, path: str | None = None, *, end: str = END_OF_DOCUMENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Encodes documents into flat files, one for each partition; returns (blocks, names).

    blocks: file, block, ids (binary); names: file, doc, doc_id, the order in which the documents went in. Both are written
    tables; file numbers are given by Spark's partitions, the same for a repeated task. `layout` tells how to read the ids.
    """
    spec = bpe.broadcast_vocabulary(docs.sparkSession, path or bpe.default_path())
    separator, width = layout(path, end)

    def run(batches):
        vocab = bpe.worker_vocabulary(spec)
        names = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("docs", pa.list_(docs_type)), ("first_doc", pa.int64())])
        waiting, size, blocks, first_doc, file = [], 0, 0, 0, 0

        def flush(keep: int):
            nonlocal waiting, size, blocks
            flat = np.concatenate(waiting or [np.zeros(0, width)])
            cutoff = len(flat) - keep
            for a in range(0, cutoff, block):
                yield {"file": file, "block": blocks, "ids": flat[a : min(a + block, cutoff)].tobytes()}
                blocks += 1
            waiting, size = ([flat[cutoff:]] if keep else []), keep

        for batch in batches:
            file = batch.column(2)[0].as_py() if len(batch) else file
            yield pa.RecordBatch.from_pylist([{"file": file, "docs": batch.column(0).to_pylist(), "first_doc": first_doc}], names)
            first_doc += len(batch)
            for t in batch.column(1):
                waiting += [vocab.encode_ordinary(t.as_py()).astype(width), np.array([separator], width)]
                size += len(waiting[-2]) + 1
                if size >= 16 * block:
                    yield pa.RecordBatch.from_pylist(list(flush(size % block)), names)
        if rest := list(flush(0)):
            yield pa.RecordBatch.from_pylist(rest, names)
        vocab.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    rows = docs.select(F.col("doc_id").cast("bigint" if docs_type == pa.int64() else "string").alias("doc_id"), "text", F.spark_partition_id().alias("file"))
    written = cut(rows.mapInArrow(run, f"file int, block bigint, ids binary, docs array<{'bigint' if docs_type == pa.int64() else 'string'}>, first_doc bigint"), "flat")
    names = written.filter("docs IS NOT NULL").select("file", "first_doc", F.posexplode("docs").alias("at", "doc_id")).select("file", (F.col("first_doc") + F.col("at")).alias("doc"), "doc_id")
    return written.filter("ids IS NOT NULL").select("file", "block", "ids"), names


def scan(blocks: DataFrame, end: int, width: str) -> DataFrame:
    """file, block, ends (lengths of the documents ending in the block, without what earlier blocks hold), n, head, tail for each block."""

    def run(batches):
        for batch in batches:
            ends, n, head, tail = [], [], [], []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_py(), width)
                at = np.flatnonzero(ids == end)
                ends.append(np.diff(at, prepend=-1) - 1)
                n.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(int(len(ids) - 1 - at[-1]) if len(at) else len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ends)]), pa.int32()), pa.array(np.concatenate(ends or [np.zeros(0, int)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, *(pa.array(x, pa.int64()) for x in (n, head, tail))], ["file", "block", "ends", "n", "head", "tail"])

    kinds = dict(blocks.dtypes)
    return blocks.select("file", "block", "ids").mapInArrow(run, f"file {kinds['file']}, block bigint, ends array<bigint>, n bigint, head bigint, tail bigint")


def _carried(order: Window, n: str, tail: str) -> Column:
    """Ids since the last separator before a row: the tails after the last row with a separator, that row's included."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # tails added up, less what was added up before the last row with a separator
    upto = F.coalesce(F.sum(tail).over(before), F.lit(0))
    dropped = F.coalesce(F.last(F.when(F.col(n) > 0, F.col("__sum") - F.col(tail)), ignorenulls=True).over(before), F.lit(0))
    return upto - dropped


def _prefix(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds docs_before and ids_before (since the last separator) to summaries n, tail, in order of `at` within keys."""
    order = Window.partitionBy(*keys).orderBy(at)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__sum", F.sum("tail").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.withColumns({"docs_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "ids_before": _carried(order, "n", "tail")}).drop("__sum")


def documents_in(blocks: DataFrame, end: int | None = None, run: int = RUN, width: str | None = None) -> DataFrame:
    """file, doc, n_tokens, closed for every document of every flat file; end and width are those of the default vocabulary, unless given."""
    if end is None or width is None:
        usual = layout()
        end, width = usual[0] if end is None else end, width or usual[1]
    found = cut(scan(blocks, end, width), "separators")
    small = found.select("file", "block", "n", "head", "tail", F.floor(F.col("block") / run).alias("run"))
    inside = _prefix(small, ["file", "run"], "block")
    # a run's tail: ids after its last separator, or all its ids
    ends = inside.withColumn("__nth", F.row_number().over(Window.partitionBy("file", "run").orderBy(F.desc("block")))).filter("__nth = 1")
    runs = ends.select("file", "run", (F.col("docs_before") + F.col("n")).alias("n"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("ids_before") + F.col("tail")).alias("tail"))
    placed = _prefix(runs, ["file"], "run").select("file", "run", F.col("docs_before").alias("run_docs"), F.col("ids_before").alias("run_ids"))
    starts = inside.join(placed, ["file", "run"]).select("file", "block", (F.col("docs_before") + F.col("run_docs")).alias("first"), (F.col("ids_before") + F.when(F.col("docs_before") == 0, F.col("run_ids")).otherwise(0)).alias("carried"))
    whole = found.select("file", "block", "ends").filter(F.size("ends") > 0).join(starts, ["file", "block"])
    closed = whole.select("file", "first", "carried", F.posexplode("ends").alias("at", "len")).select("file", (F.col("first") + F.col("at")).alias("doc"), (F.col("len") + F.when(F.col("at") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = _prefix(runs, ["file"], "run").withColumn("__nth", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("run")))).filter("__nth = 1")
    open_ = rest.select("file", (F.col("docs_before") + F.col("n")).alias("doc"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("ids_before") + F.col("tail")).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return closed.unionByName(open_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens for every document, from flat files of all documents."""
    blocks, names = write_flat(table(spark, sf_dir, "documents"))
    return documents_in(blocks).filter("closed").join(names, ["file", "doc"]).select("doc_id", "file", "doc", "n_tokens")
