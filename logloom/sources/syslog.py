"""Syslog lines to log records."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.base import filled, lookup, strip
from ..functions.records import (build_text, infer_facility, infer_level, os_source_label,
                                 parse_event_time, record_id)
from .files import read_lines

# The two line layouts and the month names.
ISO_HEAD = r"(?<ts>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.\d]*[+-]\d{2}:\d{2})"
RFC3164_HEAD = r"(?<month>\w{3})\s+(?<day>\d+)\s+(?<time>\d{2}:\d{2}:\d{2})"
LINE_TAIL = r"\s+(?<host>\S+)\s+(?<proc>[^\[:]+?)(?:\[(?<pid>\d+)\])?:\s*(?<msg>.*)"
MONTHS = {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
          "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}

_LINE = f"(?Ud)^(?:{ISO_HEAD}|{RFC3164_HEAD}){LINE_TAIL}$"
_GROUPS = ("ts", "month", "day", "time", "host", "proc", "pid", "msg")


def parse_syslog(lines: DataFrame, year: int, default_host: str = "localhost",
                 dataset: str = "linux", compat_time: bool = False) -> DataFrame:
    """Lines (``value``, ``path``, ``seq``) to records; blank lines drop out.

    Both layouts are one expression evaluated once per line: it rewrites a
    matching line to its fields with line breaks between them, a character no
    line holds, and leaves any other line as it is.
    """
    raw = strip("value")
    cut = F.regexp_replace("raw", _LINE, "\n".join("${%s}" % g for g in _GROUPS))
    fields = F.split(F.col("cut"), "\n", len(_GROUPS))
    split = (lines.select(raw.alias("raw"), "path", "seq")
             .where(F.col("raw") != "")
             .withColumn("cut", cut)
             .withColumn("matched", F.col("cut") != F.col("raw"))
             .withColumn("f", F.when(F.col("matched"), fields)))
    field = {g: F.col("f")[i] for i, g in enumerate(_GROUPS)}

    day = field["day"]
    spelled = F.concat_ws(" ", F.lit(str(year)), field["month"], day, field["time"])
    iso = F.concat(F.lit(f"{year:04d}-"), lookup(F.lower(field["month"]), MONTHS), F.lit("-"),
                   F.lpad(day, 2, "0"), F.lit("T"), field["time"])
    dated = F.when((F.length(day) <= 2) & iso.try_cast("timestamp_ntz").isNotNull(), iso)
    timestamp = F.coalesce(filled(field["ts"]), dated, spelled)

    def either(parsed, other):
        return F.when(F.col("matched"), parsed).otherwise(other)

    parsed = split.select(
        "raw", "path", "seq", "matched",
        either(timestamp, F.lit("")).alias("timestamp"),
        either(strip(field["proc"]), F.lit("unknown")).alias("source"),
        either(field["pid"].try_cast("long"), F.lit(None).cast("long")).alias("pid"),
        either(field["host"], F.lit(default_host)).alias("hostname"),
        either(field["msg"], F.col("raw")).alias("message"))
    return as_records(
        parsed.select(
            "path", "seq", "timestamp", "source", "pid", "hostname", "message", "raw",
            os_source_label("path").alias("os_source"),
            either(infer_level("source", "message"), F.lit("UNKNOWN")).alias("level"),
            either(infer_facility("source"), F.lit(None).cast("string")).alias("facility"),
            F.lit("Linux").alias("os_type"), F.lit(None).cast("long").alias("event_id")),
        dataset, compat_time)


def as_records(df: DataFrame, dataset: str, compat_time: bool = False) -> DataFrame:
    """Complete parsed columns to the record schema: id, text, parsed time."""
    path = F.col("path") if "path" in df.columns else F.col("os_source")
    full = (df.withColumn("id", record_id(path, "seq", "raw"))
              .withColumn("text", build_text())
              .withColumn("ts_us", parse_event_time("timestamp", compat_time))
              .withColumn("dataset", F.lit(dataset)))
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                         for f in S.LOG_RECORD.fields])


def ingest_syslog_files(spark: SparkSession, log_files: list[str] | None = None, *,
                        year: int, max_lines: int | None = None,
                        default_host: str = "localhost", dataset: str = "linux") -> DataFrame:
    """Read and parse many log files whole, or the first ``max_lines`` lines of each."""
    paths = S.DEFAULT_SYSLOG_FILES if log_files is None else log_files
    return parse_syslog(read_lines(spark, paths, max_lines), year, default_host, dataset)


def dedup_raw(records: DataFrame) -> DataFrame:
    """First record of every identical raw line.

    The rank filter is planned as a group limit, so copies collapse before
    the shuffle.
    """
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("raw").orderBy("seq"))
    return records.withColumn("__place", place).where("__place = 1").drop("__place")


def union_sources(*collections: DataFrame) -> DataFrame:
    """Collections in order, first copy of every raw line kept.

    The place of a collection goes into the upper bits of ``seq``, which holds
    127 collections and numbers below 2**56.
    """
    if len(collections) > 127:
        raise ValueError("no more than 127 collections")
    out = None
    for rank, records in enumerate(collections):
        moved = records.withColumn("seq", F.col("seq") + F.lit(rank << 56))
        out = moved if out is None else out.unionByName(moved)
    return dedup_raw(out)
