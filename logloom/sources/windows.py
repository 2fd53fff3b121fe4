"""Exported Windows event rows to log records."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import (insert_list_text, windows_event_id, windows_level,
                                 windows_message)
from ..operators.order import ranked_in_group, top_in_group
from .syslog import as_records


def newest_per_channel(events: DataFrame, max_events: int | None = None) -> DataFrame:
    """Events of every channel numbered by ``newest``, newest first; all, or
    the newest ``max_events`` of each.

    A cap acts before the rows of a channel are gathered; without one, a
    channel's rows stay spread over ranges of time.
    """
    order = [F.col("time_generated").desc(), F.col("seq").desc()]
    if max_events is not None:
        return top_in_group(events, ["channel"], order, max_events, "newest")
    return ranked_in_group(events, ["channel"], order, "newest")


def parse_windows(events: DataFrame, dataset: str = "windows") -> DataFrame:
    """Event rows (channel, time_generated, event_type, event_id, source_name,
    computer_name, string_inserts, message, seq) to records."""
    number = windows_event_id("event_id")
    return as_records(
        events.select(
            "seq", F.lit("Windows").alias("os_type"), F.col("channel").alias("os_source"),
            F.date_format("time_generated", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.col("source_name").alias("source"), windows_level("event_type").alias("level"),
            number.alias("event_id"), F.lit(None).cast("long").alias("pid"),
            F.col("computer_name").alias("hostname"),
            F.lit(None).cast("string").alias("facility"),
            windows_message("message", "string_inserts").alias("message"),
            F.concat(F.lit("EventID="), number.cast("string"), F.lit(" Src="), "source_name",
                     F.lit(" Inserts="), insert_list_text("string_inserts")).alias("raw")),
        dataset)


def ingest_windows_events(events: DataFrame, channels: list[str] | None = None,
                          max_events: int | None = None,
                          dataset: str = "windows") -> DataFrame:
    """Events as records: of all channels or those listed, all of them or the
    newest ``max_events`` of each."""
    kept = events if channels is None else events.where(F.col("channel").isin(*channels))
    if max_events is not None:
        kept = newest_per_channel(kept, max_events)
    return parse_windows(kept, dataset)
