"""When to rebuild: decisions from the statistics of landed batches."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def batch_stats(records: DataFrame, batch) -> DataFrame:
    """One row per landed batch: rows, critical rows, latest time."""
    return records.groupBy(batch.alias("batch")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("level").isin(*S.CRITICAL_LEVELS)).alias("critical"),
        F.max("ts_us").alias("at_us"))


def rebuild_decisions(batches: DataFrame, rows: int = S.REBUILD_ROWS,
                      secs: float = S.REBUILD_SECS) -> DataFrame:
    """Each batch with ``new_rows`` since the last rebuild and the ``reason``
    for a rebuild after it, null if none: a critical row, else enough rows,
    else enough time. Time counts from the latest time of the first batch.

    A critical batch always resets the count, so the runs between critical
    batches are decided independently of each other.
    """
    width = int(secs * 1_000_000)
    # one row per batch, never the records themselves
    order = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    resets = F.coalesce(F.sum((F.col("critical") > 0).cast("long")).over(order), F.lit(0))
    start = F.coalesce(F.max(F.when(F.col("critical") > 0, F.col("at_us"))).over(order),
                       F.min("at_us").over(Window.orderBy("batch").rowsBetween(
                           Window.unboundedPreceding, Window.currentRow)))
    runs = batches.withColumn("run", resets).withColumn("start_us", start)

    def decide(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("batch")
        new, last, out = 0, run["start_us"].iloc[0], []
        for n, critical, at in zip(run["rows"], run["critical"], run["at_us"]):
            new += n
            reason = ("critical event" if critical else "count threshold" if new >= rows
                      else "time interval" if new and at - last >= width else None)
            out.append((new, reason))
            if reason:
                new, last = 0, at
        run["new_rows"], run["reason"] = [n for n, _ in out], [r for _, r in out]
        return run[["batch", "rows", "critical", "at_us", "new_rows", "reason"]]

    return runs.groupBy("run").applyInPandas(
        decide, "batch long, rows long, critical long, at_us long, new_rows long, reason string")
