"""Counts by level, source, dataset and split."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.records import split_key
from .condense import condense_template
from .filters import filter_critical


def count_by(records: DataFrame, field: str, default: str) -> DataFrame:
    """Rows per value, most first and the first seen first on ties."""
    value = F.coalesce(F.col(field), F.lit(default)).alias(field)
    return (records.groupBy(value)
            .agg(F.count("*").alias("count"), F.min("seq").alias("first"))
            .orderBy(F.col("count").desc(), "first").drop("first"))


def summary_by_level(records: DataFrame) -> DataFrame:
    return count_by(records, "level", "UNKNOWN")


def summary_by_os_source(records: DataFrame) -> DataFrame:
    return count_by(records, "os_source", "?")


def level_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy("dataset", "level").agg(F.count("*").alias("count"))


def with_level_split(records: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Rows of the listed levels with the name of their sub-dataset."""
    levels = S.SPLIT_LEVELS if levels is None else levels
    return (records.where(F.upper("level").isin(*levels))
            .withColumn("sub_dataset", F.concat("dataset", F.lit("__"), F.lower("level"))))


def with_field_split(records: DataFrame, field: str = "os_source") -> DataFrame:
    return records.withColumn("sub_dataset", F.concat("dataset", F.lit("__"), split_key(field)))


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("dataset", "sub_dataset").agg(F.count("*").alias("count"))


def consultation_overview(records: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """One row: datasets, records, operating systems, errors, patterns."""
    row = records.agg(
        F.count_distinct("dataset").alias("total_datasets"),
        F.count("*").alias("total_records"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("os_type", F.lit("?")))), ", ").alias("os_types"),
        F.count_if(F.col("level").isin(*S.CRITICAL_LEVELS)).alias("total_errors"))
    if patterns is None:
        return row.withColumn("patterns", F.lit(0).cast("long"))
    return row.withColumn("patterns", patterns.agg(F.count("*")).scalar())


def error_template_ratio(records: DataFrame, condensed: DataFrame | None = None) -> DataFrame:
    """Critical rows against their distinct templates, per dataset. Give the
    critical rows ``condensed`` per dataset where they are at hand."""
    if condensed is None:
        narrow = filter_critical(records).select("dataset", "source", "level", "message", "seq")
        condensed = condense_template(narrow, ("dataset",))
    return (condensed.groupBy("dataset")
            .agg(F.sum("count").alias("error_records"), F.count("*").alias("unique_templates")))


def dataset_inventory(original: DataFrame, pattern: DataFrame, sample: DataFrame) -> DataFrame:
    """Row counts of the variants per dataset, and whether vectors exist."""
    def sized(df, variant):
        vectors = F.max(F.col("embedding").isNotNull()) if "embedding" in df.columns else F.lit(False)
        return df.groupBy("dataset").agg(F.count("*").alias("n"), vectors.alias("v")).withColumn(
            "variant", F.lit(variant))

    every = sized(original, "original").unionByName(sized(pattern, "pattern")).unionByName(
        sized(sample, "sample"))

    def total(variant):
        return F.coalesce(F.sum(F.when(F.col("variant") == variant, F.col("n"))), F.lit(0))

    return every.groupBy("dataset").agg(
        total("original").alias("original"), total("pattern").alias("pattern"),
        total("sample").alias("sample"), F.coalesce(F.max("v"), F.lit(False)).alias("has_vectors"))
