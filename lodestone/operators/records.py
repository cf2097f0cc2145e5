"""Hooks on records: masking, validation, key rules, cancellation, and versioned migrations, as DataFrame transforms."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("lodestone")
Transform = Callable[[DataFrame], DataFrame]


def mask(df: DataFrame, fields: Iterable[str], with_: str = "***") -> DataFrame:
    """Replaces the fields that exist, nulls included."""
    return df.withColumns({f: F.lit(with_) for f in fields if f in df.columns})


def schema_violation(required: dict[str, str], types_of: dict[str, Column] | None = None) -> Column:
    """The first failing field of a record, or null. required: field -> "string", "bigint", "double", "boolean".

    types_of gives the runtime type of each field's value (null if it is missing); typed columns need it not.
    """
    out = None
    for name, kind in required.items():
        actual = F.col(name) if types_of is None else types_of[name]
        bad = actual.isNull() if types_of is None else (actual.isNull() | (actual != kind))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return F.lit(None).cast("string") if out is None else out


def variant_types(value: str, fields: Iterable[str]) -> dict[str, Column]:
    """The runtime types of top-level fields of a variant column, in lower case."""
    return {f: F.lower(F.schema_of_variant(F.try_variant_get(F.col(value), f"$.{f}", "variant"))) for f in fields}


def key_allowed(key: Column, pattern: str) -> Column:
    """The pattern is searched, not matched in full."""
    return key.rlike(pattern)


@dataclass(order=True)
class Hook:
    """A step of a chain, in order of priority. `allow` cancels records, `change` transforms those allowed."""

    priority: int
    name: str = field(compare=False)
    change: Transform | None = field(default=None, compare=False)
    allow: Callable[[DataFrame], Column] | None = field(default=None, compare=False)


def run_chain(df: DataFrame, hooks: Iterable[Hook]) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected with the name of the hook in `rejected_by`); a cancelled record meets no later hook.

    One projection per hook and no action: rejection is a column, so both results share one scan.
    """
    marked = df.withColumn("rejected_by", F.lit(None).cast("string"))
    for h in sorted(hooks):
        if h.allow is not None:
            cancelled = F.col("rejected_by").isNull() & ~F.coalesce(h.allow(marked), F.lit(False))
            marked = marked.withColumn("rejected_by", F.when(cancelled, h.name).otherwise(F.col("rejected_by")))
        if h.change is not None:
            columns = [c for c in marked.columns if c != "rejected_by"]
            changed = h.change(marked.withColumns({f"__{c}": F.col(c) for c in columns}))
            live = F.col("rejected_by").isNull()
            marked = changed.select(*(F.when(live, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in columns), "rejected_by")
    return marked.filter("rejected_by IS NULL").drop("rejected_by"), marked.filter("rejected_by IS NOT NULL")


class Cancelled(Exception):
    """A save that a hook cancelled; `by` counts the cancelled records of each hook."""

    def __init__(self, by: dict[str, int]):
        super().__init__("cancelled by " + ", ".join(f"{name} ({n})" for name, n in sorted(by.items())))
        self.by = by


def save_through(df: DataFrame, hooks: Iterable[Hook]) -> DataFrame:
    """The records as the hooks leave them. A cancelled record is an error: nothing of the table is saved then."""
    passed, rejected = run_chain(df, hooks)
    by = {r["rejected_by"]: r["n"] for r in rejected.groupBy("rejected_by").agg(F.count("*").alias("n")).collect()}  # a row for each hook
    if by:
        raise Cancelled(by)
    return passed


def get_through(df: DataFrame, hooks: Iterable[Hook], key: str = "key") -> DataFrame:
    """Every record; those whose reading a hook cancels have nulls beside their key."""
    hidden = run_chain(df, hooks)
    return hidden[0].unionByName(hidden[1].select(*(F.col(x) if x == key else F.lit(None).cast(df.schema[x].dataType).alias(x) for x in hidden[0].columns)))


def delete_through(df: DataFrame, gone: DataFrame, hooks: Iterable[Hook], key: str = "key") -> DataFrame:
    """The records left after a deletion; keys whose deletion a hook cancels stay, without an error."""
    return df.join(run_chain(gone, hooks)[0].select(key), key, "left_anti")


def observed(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """Row counts and other aggregates of a plan, taken while it runs."""
    log.debug("observing %s", name)
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *metrics)


@dataclass(frozen=True)
class Migration:
    from_version: int
    to_version: int
    change: Transform


def migrate(df: DataFrame, migrations: Iterable[Migration], current: int, target: int) -> DataFrame:
    """Applies the migrations from `current` up to `target` in order of version."""
    for m in sorted(migrations, key=lambda m: m.from_version):
        if m.from_version >= current and m.to_version <= target:
            df = df.transform(m.change)
    return df
