"""Helpers that several training-data operators share."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stage

# A word is a run of anything but these white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"

# Records per Arrow batch that operators on whole texts ask for.
TEXT_BATCH = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str = "doc_id") -> Column:
    """CRC-32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) per node
    that a link names, the component being its smallest node.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours to the
    smallest of them. Minima are combined before the shuffle and rows move by
    join, which adaptive execution splits at hot nodes. The links of each
    round are a table in the shared folder; those of earlier rounds are deleted.
    """
    links = stage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "links")
    before = _signature(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = stage(large, "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        after = stage(small, "links")
        discard(links, large)
        links, now = after, _signature(after)
        if now == before:
            break
        before = now
    return (links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")))
            .distinct())


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def _settle(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; a label is the smallest place of its set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        label = _settle(label)
