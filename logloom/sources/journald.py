"""Exported journald JSON lines to log records."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import compute_once, filled, strip
from ..functions.records import (decode_byte_message, facility_name, micros_to_iso,
                                 priority_level)
from .files import read_lines
from .syslog import as_records, ingest_syslog_files, union_sources


def _get(path: str, kind: str = "string"):
    return F.try_variant_get("v", "$." + path, kind)


def journald_entries(lines: DataFrame) -> DataFrame:
    """Lines (``value``, ``seq``) to a parsed variant; malformed lines drop out."""
    objects = lines.select(strip("value").alias("raw"), "seq").where(F.col("raw").startswith("{"))
    return compute_once(objects, "v", F.try_parse_json("raw")).where(F.col("v").isNotNull())


def filter_journald(entries: DataFrame, since_us: int | None = None,
                    units: list[str] | None = None) -> DataFrame:
    """Keep entries since a time and of the listed units."""
    if since_us is not None:
        entries = entries.where(_get("__REALTIME_TIMESTAMP").try_cast("long") >= since_us)
    if units:
        entries = entries.where(_get("_SYSTEMD_UNIT").isin(*units))
    return entries


def parse_journald(entries: DataFrame, default_host: str = "localhost",
                   dataset: str = "linux") -> DataFrame:
    """Journald entries to records.

    A message given as an array of byte values is decoded; an absent or null
    message is empty. Text that merely starts with a bracket stays text.
    """
    stamp = _get("__REALTIME_TIMESTAMP")
    micros = F.when(stamp.isNull(), F.lit(0).cast("long")).otherwise(stamp.try_cast("long"))
    pid = F.coalesce(filled(_get("_PID")), filled(_get("SYSLOG_PID")))
    read = entries.select(
        "raw", "seq", micros.alias("micros"),
        _get("PRIORITY").alias("priority"),
        _get("MESSAGE", "array<int>").alias("bytes"), _get("MESSAGE").alias("said"),
        F.coalesce(filled(_get("SYSLOG_IDENTIFIER")), _get("_COMM"), F.lit("unknown")).alias("source"),
        F.when(pid.rlike(r"^\d+$"), pid.try_cast("long")).alias("pid"),
        F.coalesce(_get("_HOSTNAME"), F.lit(default_host)).alias("hostname"),
        _get("SYSLOG_FACILITY").alias("facility_number"))
    message = F.when(F.col("bytes").isNotNull(), decode_byte_message("bytes")).otherwise(
        F.coalesce("said", F.lit("")))
    return as_records(
        read.select(
            "raw", "seq", "source", "pid", "hostname",
            F.lit("Linux").alias("os_type"), F.lit("journald").alias("os_source"),
            micros_to_iso("micros").alias("timestamp"),
            priority_level("priority").alias("level"),
            F.lit(None).cast("long").alias("event_id"),
            facility_name("facility_number").alias("facility"),
            strip(message).alias("message")),
        dataset)


def ingest_journald(lines: DataFrame, since_us: int | None = None,
                    units: list[str] | None = None, default_host: str = "localhost",
                    dataset: str = "linux") -> DataFrame:
    """Filter first, then parse: only kept entries pay for the full record."""
    return parse_journald(filter_journald(journald_entries(lines), since_us, units),
                          default_host, dataset)


def ingest_journald_files(spark: SparkSession, paths: list[str], since_us: int | None = None,
                          units: list[str] | None = None, default_host: str = "localhost",
                          dataset: str = "linux") -> DataFrame:
    """Exported journal files, in the order given."""
    return ingest_journald(read_lines(spark, paths), since_us, units, default_host, dataset)


def collect_linux(spark: SparkSession, log_files: list[str] | None, journal_files: list[str], *,
                  year: int, max_lines: int | None = None, since_us: int | None = None,
                  units: list[str] | None = None, default_host: str = "localhost",
                  dataset: str = "linux") -> DataFrame:
    """Log files, then the journal, and the first of every identical line."""
    files = ingest_syslog_files(spark, log_files, year=year, max_lines=max_lines,
                                default_host=default_host, dataset=dataset)
    journal = ingest_journald_files(spark, journal_files, since_us, units, default_host, dataset)
    return union_sources(files, journal)
