"""Predicates with document semantics: a missing field is null, null sorts below everything, text tests ignore case.

Filters keep rows whose predicate is true, so SQL null and false are the same to them; only the predicates that are true for
null fields say so. They are written as `IS NULL OR ...`, a form that scans can push down.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def _value_family(v: Any) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "text"
    return "time" if hasattr(v, "isoformat") else "other"


class Field:
    """A field of a record and the predicates on it. `kind` is its Spark type; a missing field is a null of type void."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind

    def _mixed(self, v: Any) -> bool:
        return not isinstance(self.kind, T.NullType) and _family(self.kind) != _value_family(v)

    def _pair(self, v: Any) -> tuple[Column, Column]:
        """Both sides of an ordering; values of different families are ordered by their text."""
        if self._mixed(v):
            return self.text(), F.lit(str(v).lower() if isinstance(v, bool) else str(v))
        return self.column, F.lit(v)

    def text(self) -> Column:
        return self.column.cast("string")

    def equals(self, v: Any) -> Column:
        if v is None:
            return self.column.isNull()
        return F.lit(False) if self._mixed(v) else self.column.eqNullSafe(F.lit(v))

    def not_equals(self, v: Any) -> Column:
        if v is None:
            return self.column.isNotNull()
        return F.lit(True) if self._mixed(v) else ~self.column.eqNullSafe(F.lit(v))

    def greater_than(self, v: Any) -> Column:
        if v is None:
            return self.column.isNotNull()
        a, b = self._pair(v)
        return a > b

    def greater_than_or_equal(self, v: Any) -> Column:
        if v is None:
            return F.lit(True)
        a, b = self._pair(v)
        return a >= b

    def less_than(self, v: Any) -> Column:
        if v is None:
            return F.lit(False)
        a, b = self._pair(v)
        return self.column.isNull() | (a < b)

    def less_than_or_equal(self, v: Any) -> Column:
        if v is None:
            return self.column.isNull()
        a, b = self._pair(v)
        return self.column.isNull() | (a <= b)

    def _needle(self, v: Any) -> Column:
        return F.lit("null" if v is None else str(v).lower())

    def contains(self, v: Any) -> Column:
        return F.lower(self.text()).contains(self._needle(v))

    def starts_with(self, v: Any) -> Column:
        return F.lower(self.text()).startswith(self._needle(v))

    def ends_with(self, v: Any) -> Column:
        return F.lower(self.text()).endswith(self._needle(v))

    def is_in(self, values: Iterable[Any]) -> Column:
        values = list(values)
        known = [v for v in values if v is not None and not self._mixed(v)]
        test = self.column.isin(known) if known else F.lit(False)
        return test | self.column.isNull() if None in values else test

    def is_not_in(self, values: Iterable[Any]) -> Column:
        values = list(values)
        known = [v for v in values if v is not None and not self._mixed(v)]
        test = ~self.column.isin(known) if known else F.lit(True)
        return self.column.isNotNull() & test if None in values else self.column.isNull() | test

    def is_null(self) -> Column:
        return self.column.isNull()

    def is_not_null(self) -> Column:
        return self.column.isNotNull()

    def between(self, low: Any, high: Any) -> Column:
        """Inclusive; without a lower bound everything but null is above it, and nothing is below a null upper bound."""
        if high is None:
            return F.lit(False)
        return self.column.isNotNull() & self.greater_than_or_equal(low) & self.less_than_or_equal(high)

    def matches(self, pattern: str | None) -> Column:
        """Finds the pattern anywhere, ignoring case; a null field is the empty text."""
        return F.coalesce(self.text(), F.lit("")).rlike("(?i)" + ("null" if pattern is None else pattern))
