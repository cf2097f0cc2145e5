"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


#: Bytes of a batch that goes to a Python worker, and of a row group of a working table, which a writing task holds in memory.
BATCH, ROW_GROUP = 8 << 20, 32 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Lets Python workers get texts in batches of BATCH bytes, since a worker and its executor hold several copies of a batch.

    It is a setting of the session, which is left alone where it is not Spark's default of 64 MB.
    """
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH))


def release() -> None:
    """Gives the memory of earlier batches back: Arrow's pool keeps it otherwise, in idle workers too."""
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It comes from ``spark.checkpoint.dir``. Only a single-process local session without that setting gets a
    temporary folder of its own; a cluster session without it is an error, because a machine-local folder would
    lose rows with an executor.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/lodestone-{app}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return f"file://{_LOCAL_DIRS[app]}"


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later stages survive lost executors without recomputing it.

    The folder is deleted when the application ends; `working_tables` tells who may delete tables before.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, folder)
    files.mkdirs(at)
    files.deleteOnExit(at)
    _WRITTEN.get([]).append(path)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: ContextVar[list[str]] = ContextVar("written")


@contextmanager
def working_tables() -> Iterator[list[str]]:
    """The paths of the tables that cut() writes inside the block; they belong to the caller, who knows when no lazy result needs them."""
    token = _WRITTEN.set([])
    try:
        yield _WRITTEN.get()
    finally:
        _WRITTEN.reset(token)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables; call it only when no lazy result needs one."""
    for p in paths:
        files, at = _file_system(spark, p)
        files.delete(at, True)


#: Rows of one key that a shuffle join may bring together.
HOT = 100_000


def spread_join(rows: DataFrame, named: DataFrame, key: str, n: str, hot: int = HOT) -> DataFrame:
    """rows joined with named, a written table of distinct keys, whose column n tells how many rows each key has.

    Keys of more than `hot` rows are few, one for each `hot` rows at most. They are joined first, from a written table that Spark
    broadcasts by its size, and their rows take no part in the shuffle of the others.
    """
    few = cut(named.filter(F.col(n) > hot), "hot-keys")
    named = named.drop(n)
    if few.isEmpty():
        return rows.join(named, key)
    return rows.join(few.drop(n), key).unionByName(rows.join(few.select(key), key, "left_anti").join(named, key))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fold_of(doc_id, folds: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds
