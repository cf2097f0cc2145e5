"""Keyed tables: reads, upserts, deletes, transactions."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keys(df: DataFrame, key: str = "key") -> DataFrame:
    return df.select(key)


def get(df: DataFrame, value: object, key: str = "key") -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def exists(df: DataFrame, value: object, key: str = "key") -> DataFrame:
    """One row: found."""
    return get(df, value, key).limit(1).agg((F.count("*") > 0).alias("found"))


def get_many(df: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """Records of the wanted keys; missing ones are left out. The join's strategy is left to the optimizer, which knows sizes."""
    return df.join(wanted.select(key), key, "left_semi")


def upsert(df: DataFrame, changes: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """Base with the last change of each key: by `order` among the changes, any change over the base."""
    if order is not None:
        last = Window.partitionBy(key).orderBy(F.col(order).desc())
        changes = changes.withColumn("__nth", F.row_number().over(last)).filter("__nth = 1").drop("__nth")
        changes = changes.drop(order) if order not in df.columns else changes
    return df.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(df: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def compact(df: DataFrame, path: str, files: int) -> None:
    """Rewrites a table into fewer files."""
    df.coalesce(files).write.mode("overwrite").parquet(path)


# --- write-ahead log: seq, key, op ("write" or "delete"), value ---


def last_operations(wal: DataFrame, upto: int | None = None) -> DataFrame:
    """The effective operation of each key, up to a savepoint. Pre-aggregated before its shuffle."""
    ops = wal if upto is None else wal.filter(F.col("seq") <= upto)
    return ops.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last")).select("key", "last.op", "last.value")


def read_through(base: DataFrame, wal: DataFrame, upto: int | None = None) -> DataFrame:
    """(key, value) as a transaction sees them: staged writes over the base, staged deletes gone."""
    last = last_operations(wal, upto).select("key", "op", F.col("value").alias("staged"))
    both = base.select("key", "value").join(last, "key", "full_outer")
    return both.filter("op IS NULL OR op = 'write'").select("key", F.when(F.col("op").isNull(), F.col("value")).otherwise(F.col("staged")).alias("value"))


def pending_keys(wal: DataFrame) -> DataFrame:
    """(key, op) that a commit would apply."""
    return last_operations(wal).select("key", "op")


def receipt(wal: DataFrame) -> DataFrame:
    """Every operation counts, overwritten ones included."""
    return wal.agg(F.count_if(F.col("op") == "write").alias("writes"), F.count_if(F.col("op") == "delete").alias("deletes"), F.count("*").alias("operations"))


class Transaction:
    """Stages operations against a table of (key, value) and commits them as one new version.

    A commit writes a whole new version folder and then creates the next numbered pointer to it, so a reader sees the old
    version or the new one. A number is created once only: of two commits at once one finds it taken, waits for the other's
    version and applies its operations to that. A failed commit leaves the old version, and may be tried again. A pointer still
    without content after WAIT seconds is one whose commit died.
    """

    ATTEMPTS, WAIT = 10, 60.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.operations: list[tuple[int, str, str, str | None]] = []
        self.savepoints: dict[str, int] = {}
        self.state = "open"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def version(self) -> str | None:
        """The current version's folder, from the greatest pointer with content."""
        folder = next(filter(None, map(self._folder, reversed(self._pointers()))), None)
        return None if folder is None else f"{self.root}/{folder}"

    def _folder(self, n: int) -> str:
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current/{n:012d}"))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _next(self) -> int:
        """The number after the greatest pointer, once that has content."""
        until = time.monotonic() + self.WAIT
        while True:
            last = max(self._pointers(), default=-1)
            if last < 0 or self._folder(last) or time.monotonic() > until:
                return last + 1
            time.sleep(0.1)

    def base(self) -> DataFrame:
        at = self.version()
        return self.spark.createDataFrame([], "key string, value string") if at is None else self.spark.read.parquet(at)

    def _point(self, n: int, folder: str) -> bool:
        """Creates pointer n; False if it exists. Hadoop's local file system looks before it creates, so local files are made by an exclusive link."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current/{n:012d}")
        if fs.getScheme() == "file":
            fs.mkdirs(at.getParent())
            local = fs.makeQualified(at).toUri().getPath()
            part = f"{local.rsplit('/', 2)[0]}/{uuid.uuid4().hex}.pointer"
            with open(part, "w", encoding="utf-8") as f:
                f.write(folder)
            try:
                os.link(part, local)
            except FileExistsError:
                return False
            finally:
                os.remove(part)
            return True
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(folder.encode()))
        out.close()
        return True

    def _stage(self, key: str, op: str, value: str | None) -> None:
        if self.state != "open":
            raise RuntimeError(f"the transaction is {self.state}")
        self.operations.append((len(self.operations) + 1, key, op, value))

    def write(self, key: str, value: str) -> None:
        self._stage(key, "write", value)

    def delete(self, key: str) -> None:
        self._stage(key, "delete", None)

    def wal(self) -> DataFrame:
        return self.spark.createDataFrame(self.operations, "seq long, key string, op string, value string")

    def read(self) -> DataFrame:
        return read_through(self.base(), self.wal())

    def savepoint(self, name: str) -> None:
        self.savepoints[name] = len(self.operations)

    def rollback_to(self, name: str) -> None:
        """Drops the operations after the savepoint, and later savepoints."""
        if name not in self.savepoints:
            raise KeyError(name)
        n = self.savepoints[name]
        self.operations = self.operations[:n]
        self.savepoints = {k: v for k, v in self.savepoints.items() if v <= n}

    def commit(self) -> dict[str, int]:
        if self.state != "open":
            raise RuntimeError(f"the transaction is {self.state}")
        for _ in range(self.ATTEMPTS):
            n = self._next()  # before the base is read: a version that comes in between takes this number
            folder = f"v-{uuid.uuid4().hex}"
            self.read().write.parquet(f"{self.root}/{folder}")
            if self._point(n, folder):
                break
            jvm, fs = self._fs()
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}"), True)
        else:
            raise RuntimeError("other commits kept coming in between")
        self.state = "committed"
        ops = [op for _, _, op, _ in self.operations]
        return {"writes": ops.count("write"), "deletes": ops.count("delete"), "operations": len(ops)}

    def rollback(self) -> None:
        if self.state == "committed":
            raise RuntimeError("the transaction is committed")
        self.operations, self.savepoints, self.state = [], {}, "rolled back"


@contextmanager
def transaction(spark: SparkSession, root: str) -> Iterator[Transaction]:
    """Commits at the end of the block, rolls back on an error."""
    tx = Transaction(spark, root)
    try:
        yield tx
    except BaseException:
        tx.rollback()
        raise
    if tx.state == "open":
        tx.commit()


class Repository:
    """Create, read, update and delete over one keyed DataFrame; each change gives a new repository."""

    def __init__(self, df: DataFrame, key: str = "key"):
        self.df, self.key = df, key

    def get(self, value: object) -> DataFrame:
        return get(self.df, value, self.key)

    def get_all(self) -> DataFrame:
        return self.df

    def save_all(self, changes: DataFrame) -> Repository:
        return Repository(upsert(self.df, changes, self.key), self.key)

    def delete_all(self, values: Iterable[object]) -> Repository:
        return Repository(self.df.filter(~F.col(self.key).isin(list(values))), self.key)


class Boxes:
    """Named tables of a session, opened once."""

    def __init__(self, spark: SparkSession):
        self.spark, self._open = spark, {}

    def open(self, name: str, path: str) -> DataFrame:
        if name in self._open:
            raise ValueError(f"{name} is open")
        return self.get_or_open(name, path)

    def get_or_open(self, name: str, path: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(path)
            self._open[name].createOrReplaceTempView(name)
        return self._open[name]

    def close(self, name: str) -> None:
        if self._open.pop(name, None) is not None:
            self.spark.catalog.dropTempView(name)

    def close_all(self) -> None:
        for name in list(self._open):
            self.close(name)

    def names(self) -> list[str]:
        return sorted(self._open)
