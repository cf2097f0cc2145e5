"""A contract for remote sources with a cursor, a Python data source over one, and the sync job between them."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "key string, value string, ts bigint"


class Remote(Protocol):
    """What a connector offers. Rows are (key, value, ts); the cursor is the greatest ts already seen."""

    def fetch_since(self, cursor: int) -> DataFrame: ...

    def push(self, rows: DataFrame) -> None: ...

    def delete_keys(self, keys: DataFrame) -> None: ...


class FolderRemote:
    """A remote kept in parquet folders: changes are appended, deletions are rows without a value."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def fetch_since(self, cursor: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).filter(f"ts > {int(cursor)}")

    def push(self, rows: DataFrame) -> None:
        rows.select("key", "value", "ts").write.mode("append").parquet(self.path)

    def delete_keys(self, keys: DataFrame) -> None:
        self.push(keys.selectExpr("key", "cast(null as string) AS value", "ts"))


class LogRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class LogReader(DataSourceReader):
    """Reads (key, value, ts) of a numbered log through a function `fetch(first, last)`, in even ranges."""

    def __init__(self, options: dict[str, str]):
        self.first, self.last = int(options.get("cursor", 0)), int(options["last"])
        self.parts, self.name = int(options.get("partitions", 4)), options["fetch"]

    def partitions(self) -> list[LogRange]:
        step = max(1, -(-(self.last - self.first) // self.parts))
        return [LogRange(a, min(a + step, self.last)) for a in range(self.first, self.last, step)]

    def read(self, partition: LogRange) -> Iterator[tuple[Any, ...]]:
        import importlib

        module, function = self.name.rsplit(".", 1)
        yield from getattr(importlib.import_module(module), function)(partition.first, partition.last)


@dataclass
class LogPart(WriterCommitMessage):
    """What one task wrote."""

    name: str
    rows: int


class LogWriter(DataSourceWriter):
    """Writes rows as JSON lines, a file for each task.

    Files become visible when the whole job commits, by an index file that names
    them. Those of a failed job are deleted; what a killed task leaves stays unseen until the next overwriting.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        os.makedirs(path, exist_ok=True)

    def write(self, iterator: Iterator[Any]) -> LogPart:
        name, rows = f"part-{self.job}-{uuid.uuid4().hex}.json", 0
        try:
            with open(f"{self.path}/{name}", "w", encoding="utf-8") as f:
                for row in iterator:
                    f.write(json.dumps(row.asDict(), ensure_ascii=False) + "\n")
                    rows += 1
        except BaseException:
            os.remove(f"{self.path}/{name}")
            raise
        return LogPart(name, rows)

    def commit(self, messages: list[LogPart | None]) -> None:
        old = [] if self.overwrite else committed_parts(self.path)
        names = old + [m.name for m in messages if m]
        with open(f"{self.path}/_index.{self.job}", "w", encoding="utf-8") as f:
            json.dump(names, f)
        os.replace(f"{self.path}/_index.{self.job}", f"{self.path}/_index")
        self._clean(names)

    def abort(self, messages: list[LogPart | None]) -> None:
        self._clean(committed_parts(self.path))

    def _clean(self, keep: list[str]) -> None:
        """Deletes this job's other files, and those that it replaced."""
        for name in os.listdir(self.path):
            if name.startswith("part-" if self.overwrite else f"part-{self.job}-") and name not in keep:
                os.remove(f"{self.path}/{name}")


def committed_parts(path: str) -> list[str]:
    try:
        with open(f"{path}/_index", encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return []


class LogSource(DataSource):
    """spark.read.format("keyed_log").option("fetch", "package.function").option("last", n), and df.write.format("keyed_log").option("path", shared folder)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> LogReader:
        return LogReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)


def sample_log(first: int, last: int) -> Iterator[tuple[str, str, int]]:
    """A log for tests: entry i has key i modulo 10."""
    for i in range(first, last):
        yield (f"key:{i % 10}", f"value {i}", i)
