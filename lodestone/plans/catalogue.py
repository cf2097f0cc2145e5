"""Registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import business, documents, state  # noqa: F401  registering
from .data import ORACLE_SQL, QUERIES, Data

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.flagship(Data(spark, sf_dir))
