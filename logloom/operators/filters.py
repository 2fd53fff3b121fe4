"""Row filters and heads."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def filter_level(records: DataFrame, level: str) -> DataFrame:
    return records.where(F.upper("level") == level.upper())


def filter_critical(records: DataFrame) -> DataFrame:
    return records.where(F.col("level").isin(*S.CRITICAL_LEVELS))


def last_critical(records: DataFrame, n: int = 20) -> DataFrame:
    """The last critical rows by arrival; each task keeps ``n`` candidates."""
    return filter_critical(records).orderBy(F.col("seq").desc()).limit(n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_templates(condensed: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent condensed rows, the first seen first on ties."""
    return condensed.orderBy(F.col("count").desc(), "seq").limit(n)


def sort_by_count(condensed: DataFrame) -> DataFrame:
    return condensed.orderBy(F.col("count").desc(), "seq")
