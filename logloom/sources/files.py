"""Text files to numbered lines."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import top_in_group
from ..session import broadcast_if_small, stage

LINE_SCHEMA = "value string, path string, line_no long, seq long"


def existing_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, str, str]]:
    """(uri, plain path, full name) of each readable file, in the order given.

    Missing paths are skipped; folders and patterns yield their files by name.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for given in paths:
        target = jvm.org.apache.hadoop.fs.Path(given)
        fs = target.getFileSystem(conf)
        for status in fs.globStatus(target) or []:
            inner = [status] if status.isFile() else [
                s for s in fs.listStatus(status.getPath())
                if s.isFile() and not s.getPath().getName().startswith((".", "_"))]
            uris = sorted((re.sub("^file:/+", "file:/", s.getPath().toUri().toString()),
                           s.getPath().toUri().getPath(), s.getPath().toString()) for s in inner)
            found.update(dict.fromkeys(uris))
    return list(found)


def read_lines(spark: SparkSession, paths: list[str], max_lines: int | None = None) -> DataFrame:
    """Lines of many files with a dense arrival number ``seq``.

    Files count in the order given and lines in file order. The lines are
    landed once with their task row number; a table with one row per file
    block then turns that number into a line number, so the lines themselves
    are never shuffled or sorted. ``max_lines`` keeps the head of every file,
    blank lines included.
    """
    files = existing_files(spark, paths)
    if not files:
        return spark.createDataFrame([], LINE_SCHEMA)
    names = spark.createDataFrame(
        [(uri, i, path) for i, (uri, path, _) in enumerate(files)],
        "uri string, file_no long, path string")
    landed = stage(
        spark.read.text([name for _, _, name in files]).select(
            F.make_valid_utf8("value").alias("value"),
            F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("uri"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")), "lines")

    # one row per file block: small enough for a single ordered pass
    earlier = (Window.unboundedPreceding, -1)
    blocks = (landed.groupBy("uri", "block")
              .agg(F.min("row").alias("first_row"), F.count("*").alias("n"))
              .join(names, "uri")
              .withColumn("line_base", F.coalesce(F.sum("n").over(
                  Window.partitionBy("file_no").orderBy("block").rowsBetween(*earlier)), F.lit(0)))
              .withColumn("seq_base", F.coalesce(F.sum("n").over(
                  Window.orderBy("file_no", "block").rowsBetween(*earlier)), F.lit(0))))
    if max_lines is not None:
        blocks = blocks.where(F.col("line_base") < max_lines)
    blocks = broadcast_if_small(stage(blocks.drop("n"), "blocks"))

    place = F.col("row") - F.col("first_row")
    lines = landed.join(blocks, ["uri", "block"]).select(
        "value", "path", (F.col("line_base") + place).alias("line_no"),
        (F.col("seq_base") + place).alias("seq"))
    return lines if max_lines is None else lines.where(F.col("line_no") < max_lines)


def first_lines_per_file(lines: DataFrame, max_lines: int) -> DataFrame:
    """The same head for lines that are in a table already (``path``, ``seq``)."""
    return top_in_group(lines, ["path"], [F.col("seq")], max_lines, "line_no").withColumn(
        "line_no", (F.col("line_no") - 1).cast("long"))
