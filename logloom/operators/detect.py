"""Bursts, severity escalations and repeat offenders per source."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.records import severity_rank
from ..session import join_flag
from .order import in_order

# Rows that one task looks at together when bursts are found.
CHUNK_ROWS = 200_000
# Below any step from one rank to another.
NO_STEP = -(1 << 30)


def burst_ticks(records: DataFrame, window_secs: float = S.BURST_WINDOW_SECS,
                threshold: int = S.BURST_THRESHOLD, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every (source, ts_us) that lies in a window of ``window_secs`` holding
    at least ``threshold`` rows of the source, with its row count ``n``."""
    return burst_ticks_of_counts(tick_counts(records), window_secs, threshold, chunk_rows)


def tick_counts(records: DataFrame) -> DataFrame:
    return (records.where(F.col("ts_us").isNotNull())
            .groupBy("source", "ts_us").agg(F.count("*").alias("n")))


def burst_ticks_of_counts(ticks: DataFrame, window_secs: float = S.BURST_WINDOW_SECS,
                          threshold: int = S.BURST_THRESHOLD, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Burst times from rows already counted per (source, ts_us).

    Whether a row is in a burst depends on its source and time alone, and more
    than ``threshold`` rows at one time add nothing. So rows are first counted
    per (source, time), which combines on the map side, and only up to
    ``threshold`` of each go on. These are numbered in the order of source and
    time and cut into chunks of equally many rows, each with a margin of
    ``threshold - 1`` rows on both sides, so a task holds a chunk whatever the
    source or the second its rows are from. A row opens a burst when the row
    ``threshold - 1`` places later has its source and is still inside the
    window, and belongs to one if an opener is at most that many places back:
    constant work per row.
    """
    width, margin = int(window_secs * 1_000_000), threshold - 1
    chunk_rows = max(chunk_rows, threshold)
    copies = ticks.withColumn("copy", F.explode(F.sequence(
        F.lit(1), F.least(F.col("n"), F.lit(threshold)).cast("int"))))
    placed = in_order(copies, [F.col("source"), F.col("ts_us"), F.col("copy")], "place", chunk_rows)

    def chunk_of(place):
        return F.floor(place / F.lit(float(chunk_rows))).cast("long")

    place = F.col("place")
    spread = placed.withColumn("chunk", F.explode(F.sequence(
        chunk_of(F.greatest(place - margin, F.lit(0))), chunk_of(place + margin))))
    by_place = Window.partitionBy("chunk").orderBy("place")
    ahead = F.lead(F.struct("source", "ts_us"), margin).over(by_place)
    opens = (F.col("ahead.source").eqNullSafe(F.col("source")) & F.col("ahead").isNotNull()
             & (F.col("ahead.ts_us") - F.col("ts_us") <= width))
    opened = F.max(F.when(opens, place)).over(
        by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (spread.withColumn("ahead", ahead).withColumn("opened", opened)
            .where((place - F.col("opened") < threshold) & (F.col("chunk") == chunk_of(place)))
            .select("source", "ts_us", "n").distinct())


def detect_bursts(records: DataFrame, window_secs: float = S.BURST_WINDOW_SECS,
                  threshold: int = S.BURST_THRESHOLD, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Records with ``is_burst``."""
    ticks = burst_ticks(records, window_secs, threshold, chunk_rows)
    return join_flag(records, ticks, ["source", "ts_us"], "is_burst")


def escalation_sources(records: DataFrame, min_step: int = S.ESCALATION_STEP) -> DataFrame:
    """Sources whose severity rank rises by ``min_step`` or more from one row
    to the next in time order.

    Rows are cut into ranges of (source, time, seq) at sampled quantiles, so a
    source with a third of the rows fills a third of the ranges, and sorted
    inside them: the only shuffle of rows. One pass over each range gives one
    segment per source in it: first and last rank and the largest step
    between. The few segments of a source are then compared in range order.
    """
    ranked = (records.where(F.col("ts_us").isNotNull())
              .select(F.col("source").cast("string").alias("source"), "ts_us", "seq", severity_rank("level").cast("int").alias("rank")))
    cut = ranked.repartitionByRange("source", "ts_us", "seq").sortWithinPartitions("source", "ts_us", "seq")
    segments = cut.select("source", "rank").mapInArrow(_segments, "source string, order long, first int, last int, step int")
    return escalations_of_segments(segments, min_step)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one source in sorted rows; ``order`` is the place of the range."""
    order, names = TaskContext.get().partitionId(), ["source", "order", "first", "last", "step"]
    held = None   # the source that the last batch ended in, as a segment that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("source").dictionary_encode("encode")
        code, rank = coded.indices.to_numpy(), batch.column("rank").to_numpy()
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[starts[1:], len(code)]
        inside = np.r_[0, np.diff(rank)].astype(np.int64)
        inside[starts] = NO_STEP
        rows = list(zip([coded.dictionary[int(c)].as_py() for c in code[starts]], rank[starts].tolist(), rank[ends - 1].tolist(),
                        np.maximum.reduceat(inside, starts).tolist()))
        if held is not None:
            source, first, last, step = rows[0]
            if source == held[0]:
                rows[0] = (source, held[1], last, max(held[3], step, first - held[2]))
            else:
                rows.insert(0, held)
        held = rows.pop()
        if rows:
            yield _segment_rows(rows, order, names)
    if held is not None:
        yield _segment_rows([held], order, names)


def _segment_rows(rows: list[tuple], order: int, names: list[str]) -> pa.RecordBatch:
    source, first, last, step = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(source, pa.string()), pa.array([order] * len(rows), pa.int64()), pa.array(first, pa.int32()),
         pa.array(last, pa.int32()), pa.array([None if s == NO_STEP else s for s in step], pa.int32())], names=names)


def escalations_of_segments(segments: DataFrame, min_step: int = S.ESCALATION_STEP) -> DataFrame:
    """Sources with a step of ``min_step`` inside a segment (source, order,
    first, last, step) or from one to the next in ``order``."""
    across = F.col("first") - F.lag("last").over(Window.partitionBy("source").orderBy("order"))
    return (segments.withColumn("across", across)
            .groupBy("source").agg(F.max(F.greatest("step", "across")).alias("step"))
            .where(F.col("step") >= min_step).select("source"))


def repeat_offenders(records: DataFrame, threshold: int = S.OFFENDER_THRESHOLD) -> DataFrame:
    """Sources with at least ``threshold`` critical rows.

    ``critical_count`` decides; ``count`` is the narrower number that the
    summary reports.
    """
    return (records.where(F.col("level").isin(*S.CRITICAL_LEVELS))
            .groupBy("source")
            .agg(F.count("*").alias("critical_count"),
                 F.count_if(F.col("level").isin(*S.OFFENDER_COUNT_LEVELS)).alias("count"))
            .where(F.col("critical_count") >= threshold))


def source_totals(records: DataFrame) -> DataFrame:
    """Per source: rows, first row, critical rows, and the narrower count that
    offender summaries report."""
    return records.groupBy("source").agg(
        F.count("*").alias("count"), F.min("seq").alias("first_seq"),
        F.count_if(F.col("level").isin(*S.CRITICAL_LEVELS)).alias("critical_count"),
        F.count_if(F.col("level").isin(*S.OFFENDER_COUNT_LEVELS)).alias("offender_count"))


def listed(totals: DataFrame, sources: DataFrame) -> DataFrame:
    """The totals of the listed sources."""
    names = sources.select(F.col("source").alias("__source"))
    return totals.join(names, totals["source"].eqNullSafe(names["__source"]), "left_semi")


def rows_per_source(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Row count and first row of each listed source.

    Counting first leaves one row per source for the join.
    """
    return listed(source_totals(records), sources).select("source", "count", "first_seq")
