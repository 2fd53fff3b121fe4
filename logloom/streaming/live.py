"""Live forms: landing, alerts and running summaries of a record stream.

All functions take a streaming DataFrame of log records unless noted. State
grows with the number of groups; ``delay`` adds a watermark that lets go of old
ones, which stay in the results.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema as S
from ..functions.display import alert_line
from ..functions.records import severity_rank
from ..functions.templates import mask_message
from ..operators import detect as D
from ..operators.condense import first_of_each, group_numbers
from ..operators.filters import filter_critical, last_critical
from ..plans.patterns import detect_patterns
from ..session import path_exists, scratch_path
from ..sources.journald import journald_entries, parse_journald
from ..sources.windows import parse_windows
from .run import keyed_state, land, read_stream, run_groups
from .slices import SLICE_SECS, slice_bursts, slice_summaries

# How long a review period, and a period of counts that a watermark closes, lasts.
PERIOD = f"{S.REVIEW_SECS} seconds"


def journald_stream(lines: DataFrame, default_host: str = "localhost", dataset: str = "live") -> DataFrame:
    """JSON lines (``value``) to records; the journal's own time is the order."""
    stamped = lines.select("value", F.coalesce(F.try_variant_get(
        F.try_parse_json("value"), "$.__REALTIME_TIMESTAMP", "string").try_cast("long"),
        F.lit(0).cast("long")).alias("seq"))
    return parse_journald(journald_entries(stamped), default_host, dataset)


def windows_stream(events: DataFrame, channels: list[str] | None = None, since=None,
                   dataset: str = "live") -> DataFrame:
    """Exported event rows to records, of all channels or those listed, and
    only those after ``since`` if it is given."""
    kept = events if channels is None else events.where(F.col("channel").isin(*channels))
    if since is not None:
        kept = kept.where(F.col("time_generated") > F.lit(since))
    return parse_windows(kept, dataset)


def critical_alerts(records: DataFrame, message_chars: int | None = None) -> DataFrame:
    """Stateless: a line for every critical record at once."""
    return (records.where(F.col("level").isin(*S.CRITICAL_LEVELS))
            .select("id", "level", alert_line(message_chars).alias("line")))


def _timed(records: DataFrame, delay: str | None) -> DataFrame:
    """Records with ``at`` and, if a delay is given, a watermark on it."""
    timed = records.withColumn("at", F.timestamp_micros("ts_us"))
    return timed if delay is None else timed.withWatermark("at", delay)


def running_totals(records: DataFrame, every: int = 50) -> DataFrame:
    """Rows so far, critical rows so far and status lines due."""
    kept = running_counts(records, "level")
    rows = F.coalesce(F.sum("count"), F.lit(0))
    critical = F.sum(F.when(F.col("level").isin(*S.CRITICAL_LEVELS), F.col("count")))
    return kept.agg(rows.alias("total"), F.coalesce(critical, F.lit(0)).alias("critical"),
                    F.floor(rows / every).cast("long").alias("status_lines"))


def running_counts(records: DataFrame, field: str, delay: str | None = None,
                   every: str = PERIOD) -> DataFrame:
    """Rows per value of a field.

    With a ``delay`` the rows are counted per period of ``every`` and field,
    the state lets go of periods past the watermark, and the periods are added
    up from the table of results.
    """
    if delay is None:
        return run_groups(records.groupBy(field).agg(F.count("*").alias("count")), [field])
    counted = _timed(records, delay).groupBy(F.window("at", every), field).agg(F.count("*").alias("count"))
    return run_groups(counted, ["window", field]).groupBy(field).agg(F.sum("count").alias("count"))


def running_condense(records: DataFrame, delay: str | None = None, every: str = PERIOD) -> DataFrame:
    """Condensed templates: count and first record of each.

    The state holds two numbers per template (and period, if a ``delay`` lets
    it go of old ones); the first records come from the landed table.
    """
    landed = land(records)
    keys = ["source", "level", "message"]
    masked = records.withColumn("message", mask_message("message"))
    if delay is None:
        groups = run_groups(group_numbers(masked, keys), keys)
    else:
        numbers = group_numbers(_timed(masked, delay).withColumn("period", F.window("at", every)),
                                ["period", *keys])
        groups = run_groups(numbers, ["period", *keys]).groupBy(*keys).agg(
            F.sum("count").alias("count"), F.min("first_seq").alias("first_seq"))
    return first_of_each(landed, groups)


def running_offenders(records: DataFrame, threshold: int = S.OFFENDER_THRESHOLD,
                      delay: str | None = None, every: str = PERIOD) -> DataFrame:
    """Sources that have reached the offender threshold."""
    critical = records.where(F.col("level").isin(*S.CRITICAL_LEVELS))
    if delay is None:
        groups = run_groups(critical.groupBy("source", "level").agg(F.count("*").alias("n")), ["source", "level"])
    else:
        counted = _timed(critical, delay).groupBy(F.window("at", every), "source", "level").agg(
            F.count("*").alias("n"))
        groups = run_groups(counted, ["window", "source", "level"])
    narrow = F.sum(F.when(F.col("level").isin(*S.OFFENDER_COUNT_LEVELS), F.col("n")))
    return (groups.groupBy("source")
            .agg(F.sum("n").alias("critical_count"), F.coalesce(narrow, F.lit(0)).alias("count"))
            .where(F.col("critical_count") >= threshold))


def running_bursts(records: DataFrame, window_secs: float = S.BURST_WINDOW_SECS,
                   threshold: int = S.BURST_THRESHOLD, delay: str | None = None, slice_secs: int = SLICE_SECS,
                   **places) -> DataFrame:
    """Records in a burst (``source``, ``ts_us``, ``seq``, ``id``), an append table.

    A record is handed out as soon as enough others of its source have come
    within the window; late ones complete bursts too. The state is the rows
    that later ones may still join: with a ``delay``, those of the last delay
    and window; without one, a row for each time. History is not read again.
    ``places`` are those of ``land``.
    """
    with keyed_state(records.sparkSession):
        return land(slice_bursts(records, window_secs, threshold, slice_secs, delay), **places)


def running_escalations(records: DataFrame, min_step: int = S.ESCALATION_STEP, delay: str | None = None,
                        slice_secs: int = SLICE_SECS, **places) -> DataFrame:
    """Escalating sources of everything that has come so far.

    The state holds the rows that the watermark has not passed (all, without a
    ``delay``), because a late row may fall between two older ones, and one
    summary per source of the open slices of time. What stays is one summary per source and slice: a batch
    renews those that it touches, and they are compared in order of time.
    ``places`` are those of ``keep_updates``.
    """
    summaries = slice_summaries(records, slice_secs, delay)
    with keyed_state(records.sparkSession):
        kept = run_groups(summaries, ["source", "slice"], **places)
    return D.escalations_of_segments(kept.withColumn("order", F.struct("first_at", "first_seq")), min_step)


def review_digest(records: DataFrame, every: str = PERIOD, delay: str | None = None) -> DataFrame:
    """Per review period: rows, critical rows, the worst rank, first and last time.

    A ``delay`` bounds the state; periods that it closes stay in the result,
    and only rows later than it are left out.
    """
    by_level = _timed(records, delay).groupBy(F.window("at", every), "level").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return digest_of_levels(run_groups(by_level, ["window", "level"]))


def digest_of_levels(groups: DataFrame) -> DataFrame:
    critical = F.sum(F.when(F.col("level").isin(*S.CRITICAL_LEVELS), F.col("n")))
    return groups.groupBy(F.unix_micros("window.start").alias("start_us")).agg(
        F.sum("n").alias("total"), F.coalesce(critical, F.lit(0)).alias("critical"),
        F.max(severity_rank("level")).alias("worst_rank"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


REVIEWED = ("patterns", "sample", "critical")


def review_stream(records: DataFrame, every: str = PERIOD, delay: str = "0 seconds", last: int | None = None,
                  landed: str | None = None, path: str | None = None, checkpoint: str | None = None,
                  trigger: dict | None = None) -> dict[str, DataFrame]:
    """Patterns, samples and critical rows of every review period, once it is over.

    Records land in a table, and a second stream over that table waits for its
    watermark to pass a period. Only then is the period analysed, from its own
    rows, and written under its start; a repeated batch writes the same again.
    Returned are the tables of ``REVIEWED`` with ``start_us``; a period that
    the watermark has not passed is not in them yet. ``last`` bounds the
    critical rows of a period. ``path`` and ``checkpoint`` hold the reviews
    and where the streams are, for a later run to go on from there.
    """
    spark = records.sparkSession
    path = path or scratch_path(spark, "reviews")
    checkpoint = checkpoint or scratch_path(spark, "checkpoint")
    landed = landed or scratch_path(spark, "landed")
    land(records, landed, f"{checkpoint}/landed", trigger)
    closing = (_timed(read_stream(spark, landed, records.schema), delay).groupBy(F.window("at", every).alias("period"))
               .agg(F.count("*").alias("n")))

    def review(batch: DataFrame, number: int) -> None:
        table = spark.read.schema(records.schema).parquet(landed)
        over = batch.select(F.unix_micros("period.start").alias("a"), F.unix_micros("period.end").alias("b")).orderBy("a")
        for start, end in over.toLocalIterator():   # the periods that closed since the last batch
            for name, content in review_content(table, start, end, last).items():
                content.write.mode("overwrite").parquet(f"{path}/{name}/start_us={start}")

    query = (closing.writeStream.outputMode("append").foreachBatch(review)
             .option("checkpointLocation", f"{checkpoint}/reviews").trigger(**(trigger or {"availableNow": True})).start())
    if trigger is None:
        query.awaitTermination()
    return reviews(spark, path, records.schema)


def reviews(spark: SparkSession, path: str, schema: StructType) -> dict[str, DataFrame]:
    """The reviews written so far."""
    none = review_content(spark.createDataFrame([], schema), 0, 0) if not path_exists(spark, path) else None
    if none is not None:
        return {name: none[name].withColumn("start_us", F.lit(0).cast("long")) for name in REVIEWED}
    return {name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").withColumn("start_us", F.col("start_us").cast("long"))
            for name in REVIEWED}


def review_content(landed: DataFrame, start_us: int, end_us: int, last: int | None = None) -> dict[str, DataFrame]:
    """What a periodic review shows of the landed records of one period:
    ``patterns`` and ``sample`` of their analysis, and the ``critical`` rows,
    all or the ``last`` ones."""
    period = landed.where((F.col("ts_us") >= start_us) & (F.col("ts_us") < end_us))
    found = detect_patterns(period, "group")
    critical = filter_critical(period) if last is None else last_critical(period, last)
    return {"patterns": found.summary, "sample": found.sample, "critical": critical}
