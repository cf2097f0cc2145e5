"""A fluent query over keyed records. Building is eager and checked; the result is one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Field

Test = Callable[[Field], Column]


def field_of(df: DataFrame, path: str) -> Field:
    """The field at a dot path through structs, maps and variants; a path that leads nowhere is null."""
    name, *rest = path.split(".")
    if name not in df.columns:
        return Field(F.lit(None), T.NullType())
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    for i, part in enumerate(rest):
        if isinstance(kind, T.StructType) and part in kind.names:
            column, kind = column[part], kind[part].dataType
        elif isinstance(kind, T.MapType):
            column, kind = column[part], kind.valueType
        elif isinstance(kind, T.VariantType):
            return Field(F.try_variant_get(column, "$." + ".".join(rest[i:]), "string"), T.StringType())
        else:
            return Field(F.lit(None), T.NullType())
    return Field(column, kind)


class FieldTests:
    """The second half of `where("field").equals(...)`: adds a predicate and returns the query."""

    def __init__(self, query: Query, path: str, joined: str):
        self._add = lambda test: query._with_predicate(path, joined, test)

    def equals(self, v: Any) -> Query:
        return self._add(lambda f: f.equals(v))

    def not_equals(self, v: Any) -> Query:
        return self._add(lambda f: f.not_equals(v))

    def greater_than(self, v: Any) -> Query:
        return self._add(lambda f: f.greater_than(v))

    def greater_than_or_equal(self, v: Any) -> Query:
        return self._add(lambda f: f.greater_than_or_equal(v))

    def less_than(self, v: Any) -> Query:
        return self._add(lambda f: f.less_than(v))

    def less_than_or_equal(self, v: Any) -> Query:
        return self._add(lambda f: f.less_than_or_equal(v))

    def contains(self, v: Any) -> Query:
        return self._add(lambda f: f.contains(v))

    def starts_with(self, v: Any) -> Query:
        return self._add(lambda f: f.starts_with(v))

    def ends_with(self, v: Any) -> Query:
        return self._add(lambda f: f.ends_with(v))

    def is_in(self, values: list[Any]) -> Query:
        return self._add(lambda f: f.is_in(values))

    def is_not_in(self, values: list[Any]) -> Query:
        return self._add(lambda f: f.is_not_in(values))

    def is_null(self) -> Query:
        return self._add(lambda f: f.is_null())

    def is_not_null(self) -> Query:
        return self._add(lambda f: f.is_not_null())

    def between(self, low: Any, high: Any) -> Query:
        return self._add(lambda f: f.between(low, high))

    def matches(self, pattern: str) -> Query:
        return self._add(lambda f: f.matches(pattern))


@dataclass(frozen=True)
class Result:
    """records is lazy; the totals run a count over the filtered rows when first asked for."""

    records: DataFrame
    filtered: DataFrame
    limit: int | None
    offset: int

    def total_count(self) -> int:
        return self.filtered.count()

    def has_more(self) -> bool:
        return self.limit is not None and self.offset + self.limit < self.total_count()

    def next_offset(self) -> int:
        return self.offset + (self.limit if self.limit is not None else self.total_count())


class Query:
    """Immutable: each call returns a new query. Predicates fold from left to right, without precedence."""

    def __init__(self) -> None:
        self._predicates: tuple[tuple[str, str, Test], ...] = ()
        self._sorts: tuple[tuple[str | Column, bool], ...] = ()
        self._include: tuple[str, ...] | None = None
        self._exclude: tuple[str, ...] | None = None
        self._limit: int | None = None
        self._offset = 0
        self._prefix: str | None = None

    def _copy(self, **changes: Any) -> Query:
        new = Query.__new__(Query)
        new.__dict__ = self.__dict__ | {f"_{k}": v for k, v in changes.items()}
        return new

    def _with_predicate(self, path: str, joined: str, test: Test) -> Query:
        return self._copy(predicates=(*self._predicates, (joined, path, test)))

    def where(self, path: str) -> FieldTests:
        return FieldTests(self, path, "and")

    def and_(self, path: str) -> FieldTests:
        return FieldTests(self, path, "and")

    def or_(self, path: str) -> FieldTests:
        return FieldTests(self, path, "or")

    def order_by(self, field: str | Column) -> Query:
        return self._copy(sorts=(*self._sorts, (field, False)))

    def order_by_desc(self, field: str | Column) -> Query:
        return self._copy(sorts=(*self._sorts, (field, True)))

    then_by, then_by_desc = order_by, order_by_desc

    def limit(self, n: int) -> Query:
        if n <= 0:
            raise ValueError("limit must be positive")
        return self._copy(limit=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise ValueError("offset must not be negative")
        return self._copy(offset=n)

    def select(self, *fields: str) -> Query:
        return self._copy(include=fields)

    def exclude(self, *fields: str) -> Query:
        return self._copy(exclude=fields)

    def key_prefix(self, prefix: str) -> Query:
        return self._copy(prefix=prefix)

    def condition(self, df: DataFrame) -> Column | None:
        out = None
        for joined, path, test in self._predicates:
            column = test(field_of(df, path))
            out = column if out is None else (out & column if joined == "and" else out | column)
        return out

    def filtered(self, df: DataFrame, key: str = "key") -> DataFrame:
        if self._prefix is not None:
            df = df.filter(F.col(key).startswith(self._prefix))
        condition = self.condition(df)
        return df if condition is None else df.filter(condition)

    def apply(self, df: DataFrame, key: str = "key") -> DataFrame:
        """Filter, sort by unprojected fields (ties by key), page, project."""
        out = self.filtered(df, key)
        if self._sorts or self._limit is not None or self._offset:
            columns = [(field_of(df, f).column if isinstance(f, str) else f, desc) for f, desc in self._sorts]
            order = [c.desc_nulls_last() if desc else c.asc_nulls_first() for c, desc in columns]
            out = out.orderBy(*order, F.col(key).asc())
        if self._offset:
            out = out.offset(self._offset)
        if self._limit is not None:
            out = out.limit(self._limit)
        if self._include is not None:
            return out.select(*(c for c in df.columns if c == key or c in self._include))
        if self._exclude is not None:
            return out.drop(*(c for c in self._exclude if c != key))
        return out

    def execute(self, df: DataFrame, key: str = "key") -> Result:
        return Result(self.apply(df, key), self.filtered(df, key), self._limit, self._offset)


def scalar_records(df: DataFrame, value: str) -> DataFrame:
    """Records whose value is a scalar are queried through the field `__value`; null values are no records."""
    return df.filter(F.col(value).isNotNull()).withColumnRenamed(value, "__value")


def search_fields(df: DataFrame, fields: list[str], needle: str) -> DataFrame:
    """Rows in which some field contains the text, ignoring case; an empty text matches all."""
    if not needle:
        return df
    test = F.lit(False)
    for f in fields:
        test = test | F.coalesce(F.lower(F.col(f).cast("string")).contains(needle.lower()), F.lit(False))
    return df.filter(test)


def first_match(df: DataFrame, field: str, value: Any, key: str = "key") -> DataFrame:
    """The first record, by key, whose field equals the value."""
    return Query().where(field).equals(value).limit(1).apply(df, key)


def open_range(df: DataFrame, field: str, after: Any, before: Any) -> DataFrame:
    """Both ends excluded."""
    return df.filter((F.col(field) > F.lit(after)) & (F.col(field) < F.lit(before)))
