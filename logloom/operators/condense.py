"""Collapsing repeated records."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import mask_message
from .order import top_in_group


def first_of_each(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` (``first_seq``, other columns) with the record of that unique
    ``seq``. Columns that both have come from the groups."""
    rest = [c for c in records.columns if c not in groups.columns]
    firsts = records.select(*rest)
    return groups.join(firsts, groups["first_seq"] == firsts["seq"]).drop("first_seq")


def group_numbers(records: DataFrame, keys: list[str]) -> DataFrame:
    """Count and first ``seq`` of every group: numbers only, which a hash
    aggregate updates in place, inside the tasks first."""
    return records.groupBy(*keys).agg(F.count("*").alias("count"), F.min("seq").alias("first_seq"))


def condense_exact(records: DataFrame) -> DataFrame:
    """One row per (source, level, message): the first, with its ``count``.
    ``seq`` numbers the records uniquely."""
    groups = group_numbers(records, ["source", "level", "message"])
    return first_of_each(records, groups).select(*records.columns, "count")


def condense_template(records: DataFrame, extra_keys: tuple[str, ...] = (),
                      max_per_pair: int | None = None) -> DataFrame:
    """One row per (source, level, message template), template as message.

    ``extra_keys`` keeps datasets apart. ``max_per_pair`` keeps only the most
    frequent templates of every source and level; by default all are kept.
    """
    masked = records.withColumn("message", mask_message("message"))
    keys = [*extra_keys, "source", "level", "message"]
    out = (first_of_each(records, group_numbers(masked, keys)).select(*records.columns, "count")
           .withColumn("condensed", F.lit(True)))
    if max_per_pair is not None:
        out = top_in_group(out, [*extra_keys, "source", "level"],
                           [F.col("count").desc(), F.col("seq")], max_per_pair, "__rank").drop("__rank")
    return out
