"""Saving and re-reading records and dataset variants."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.records import split_key
from ..session import remove_path

# Partitions that a task writes side by side; it sorts its rows only if it meets more.
OPEN_FILES = 32
# Rows that the files of a split have on average, at least, where each task writes its own.
FILE_ROWS = 20_000


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _write(df: DataFrame, path: str, form: str, partitions: tuple[str, ...], mode: str,
           compression: str | None = None) -> None:
    writer = df.write.mode(mode).partitionBy(*partitions)
    if form == "json":
        writer = writer.option("ignoreNullFields", "false")
    if form == "parquet":
        compression = compression or "zstd"
    if compression:
        writer = writer.option("compression", compression)
    with _open_files(df.sparkSession, OPEN_FILES):
        writer.format(form).save(path)


def save_records(records: DataFrame, path: str, with_text: bool, mode: str = "errorifexists",
                 compression: str | None = None) -> None:
    """Records as JSON lines, nulls written out; with or without ``text``.
    ``compression`` is the codec of the files, none by default."""
    _write(records if with_text else records.drop("text"), path, "json", (), mode, compression)


def load_jsonl(spark: SparkSession, path, schema: T.StructType = S.LOG_RECORD,
               mode: str = "FAILFAST") -> DataFrame:
    """Saved records again. One bad line fails the load unless ``mode`` is
    PERMISSIVE or DROPMALFORMED."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def save_variants(variants: dict[str, DataFrame], path: str, form: str = "parquet",
                  mode: str = "errorifexists") -> list[str]:
    """Each variant under ``<path>/<variant>``, partitioned by dataset.

    The embedding goes only with the variants that keep one. Each is computed
    once: rows are counted as they are written, and the folder of an empty
    variant is removed again. Returns the names written.
    """
    written = []
    for name, df in variants.items():
        if df is None:
            continue
        if name not in S.VARIANTS_WITH_EMBEDDING:
            df = df.drop("embedding")
        rows = Observation()
        _write(df.observe(rows, F.count(F.lit(1)).alias("n")), f"{path}/{name}", form, ("dataset",), mode)
        if rows.get["n"]:
            written.append(name)
        elif mode != "append":
            remove_path(df.sparkSession, f"{path}/{name}")
    return written


def load_variant(spark: SparkSession, path: str, variant: str = "vectorized",
                 form: str = "parquet") -> DataFrame:
    """One saved variant; vectors stay on their rows. Accepts the folder of
    the whole save or of one variant."""
    base = path.rstrip("/")
    folder = base if base.rsplit("/", 1)[-1] in S.VARIANTS else f"{base}/{variant}"
    kind = folder.rsplit("/", 1)[-1]
    reader = spark.read.schema(S.VARIANTS[kind])
    if form == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.format(form).load(folder)


def write_split(records: DataFrame, path: str, field: str = "level", form: str = "parquet",
                mode: str = "errorifexists", rebalance: bool = True) -> None:
    """All sub-datasets of a field in one partitioned write.

    Every task writes a file for every value it meets. Where these files would
    have under FILE_ROWS rows on average, rows are rebalanced first: small
    values are gathered into few files, and a value with most of the rows is
    cut into many evenly sized ones. ``rebalance=False`` never does that.
    """
    df = records
    if field == "level":
        df = df.where(F.upper("level").isin(*S.SPLIT_LEVELS))
    df = df.withColumn("split", split_key(field))
    if rebalance and _small_files(df):
        df = df.hint("rebalance", "split")
    _write(df, path, form, ("split",), mode)


def _small_files(df: DataFrame) -> bool:
    """Whether the files of tasks that write their rows as they are would be small."""
    files = df.groupBy(F.spark_partition_id(), "split").agg(F.count("*").alias("n"))
    n, rows = files.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows < n * FILE_ROWS
