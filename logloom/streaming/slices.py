"""Keyed state of the detectors: rows of some sources, cut in slices of time.

State is kept per (bucket, slice): sources are dealt to buckets by a hash, so
a key serves many quiet ones at once, and time is cut in slices, so a source
with most of the rows is many keys when history is read. What no further row
can meet, the watermark says, is let go or folded into a summary.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.records import severity_rank
from ..session import configure

# Sources share so many keys of a slice, which lasts so long.
BUCKETS = 16
SLICE_SECS = 86_400
SUMMARY = ["source", "slice", "first_at", "first_seq", "first", "last_at", "last_seq", "last", "step"]
SUMMARY_KINDS = "source string, slice long, first_at long, first_seq long, first int, last_at long, last_seq long, last int, step int"
# Below any step from one rank to another.
NO_STEP = -(1 << 30)


def summaries(rows: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
    """Per source: first and last row in the order of time, and the largest
    step from one row to the next. ``before`` are summaries of earlier rows,
    which come first."""
    rows = rows.sort_values(["source", "ts_us", "seq"], na_position="first", kind="stable")
    code, names = pd.factorize(rows["source"], use_na_sentinel=False)
    rank = rows["rank"].to_numpy(np.int64)
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(rows) else np.empty(0, np.int64)
    step = np.r_[NO_STEP, np.diff(rank)] if len(rows) else np.empty(0, np.int64)
    step[start] = NO_STEP
    end = np.r_[start[1:], len(rows)] - 1 if len(rows) else start
    at, seq = rows["ts_us"].to_numpy(np.int64), rows["seq"].to_numpy(np.int64)
    found = pd.DataFrame({"source": names[code[start]] if len(rows) else pd.Series([], dtype=object),
                          "first_at": at[start], "first_seq": seq[start], "first": rank[start],
                          "last_at": at[end], "last_seq": seq[end], "last": rank[end],
                          "step": np.maximum.reduceat(step, start) if len(start) else step})
    if before is None or not len(before):
        return found
    return _folded(before, found)


def _folded(before: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
    """Summaries of rows that come before, and of those that come after, as one."""
    both = before.merge(after, on="source", how="outer", suffixes=("_b", "_a"), indicator="side")
    out = {"source": both["source"]}
    old, new = both["side"].ne("right_only").to_numpy(), both["side"].ne("left_only").to_numpy()
    value = {c: both[c].fillna(0).to_numpy(np.int64) for c in both.columns if c not in ("source", "side")}
    for c in ("first_at", "first_seq", "first"):
        out[c] = np.where(old, value[f"{c}_b"], value[f"{c}_a"])
    for c in ("last_at", "last_seq", "last"):
        out[c] = np.where(new, value[f"{c}_a"], value[f"{c}_b"])
    across = np.where(old & new, value["first_a"] - value["last_b"], NO_STEP)
    inside = np.maximum(np.where(old, value["step_b"], NO_STEP), np.where(new, value["step_a"], NO_STEP))
    out["step"] = np.maximum(across, inside)
    return pd.DataFrame(out)


def burst_rows(at: np.ndarray, width: int, threshold: int, source: np.ndarray | None = None) -> np.ndarray:
    """Which rows lie in a window of ``width`` that holds ``threshold`` rows of
    their source. Rows are ordered by source and time."""
    n = len(at)
    place = np.arange(n)
    ahead = np.minimum(place + threshold - 1, max(n - 1, 0))
    opens = (place + threshold - 1 < n) & (at[ahead] - at <= width)
    if source is not None:
        opens &= source[ahead] == source
    opened = np.maximum.accumulate(np.where(opens, place, -threshold))
    return place - opened < threshold


def _pack(frame: pd.DataFrame) -> tuple[bytes]:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpack(state) -> pd.DataFrame | None:
    held = state.get() if state.exists() else None
    return None if held is None else pa.ipc.open_stream(held[0]).read_pandas()


class Slices(StatefulProcessor):
    """State of a key as tables, written whole; timers that shrink it."""

    def __init__(self, slice_us: int, width: int, closes: bool):
        self.slice_us, self.width, self.closes = slice_us, width, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "packed binary")
        self.closed = handle.getValueState("closed", "packed binary")

    def _put(self, state, frame: pd.DataFrame) -> None:
        if len(frame):
            state.update(_pack(frame))
        else:
            state.clear()

    def _wake(self, newest: int, piece: int) -> None:
        """When the rows at hand can no longer meet others, and when none of the slice can."""
        if self.closes:
            for at in {newest, (piece + 1) * self.slice_us}:
                self.handle.registerTimer((at + self.width) // 1000 + 1)

    def _passed(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() * 1000 if self.closes else -(1 << 62)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self._passed(timerValues)
        if passed >= (key[1] + 1) * self.slice_us + self.width:
            self.rows.clear()
            self.closed.clear()
        else:
            held = _unpack(self.rows)
            if held is not None:
                self._settle(held, passed)
        return iter(())

    def close(self) -> None:
        pass


class SliceSummaries(Slices):
    """Summaries of the sources of a slice, anew whenever rows reach them.

    Rows that the watermark has passed are folded into one summary per source;
    only later ones are state, because others may still fall between them.
    """

    def _settle(self, rows: pd.DataFrame, passed: int) -> None:
        old = rows["ts_us"] <= passed
        if old.any():
            self._put(self.closed, summaries(rows[old], _unpack(self.closed)))
        self._put(self.rows, rows[~old])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))[["source", "ts_us", "seq", "rank"]]
        held, closed = _unpack(self.rows), _unpack(self.closed)
        every = fresh if held is None else pd.concat([held, fresh])
        touched = fresh["source"].unique()
        found = summaries(every[every["source"].isin(touched)], None if closed is None else closed[closed["source"].isin(touched)])
        found["step"] = found["step"].astype("Int32").mask(found["step"] == NO_STEP)
        yield found.assign(slice=key[1])[SUMMARY]
        self._settle(every, self._passed(timerValues))
        self._wake(int(fresh["ts_us"].max()), key[1])


class SliceBursts(Slices):
    """Rows of a slice, each handed out once, as soon as they lie in a burst.

    A further row never ends a burst, so nothing is taken back. The state
    holds rows that later ones may still join: those not handed out, and of
    each time up to ``threshold`` others, which only count. Rows of the
    neighbouring slices that are near enough are here too, but not handed out.
    """

    def __init__(self, slice_us: int, width: int, threshold: int, closes: bool):
        super().__init__(slice_us, width, closes)
        self.threshold = threshold

    def _settle(self, rows: pd.DataFrame, passed: int) -> None:
        self._put(self.rows, rows[rows["ts_us"] >= passed - self.width])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end = key[1] * self.slice_us, (key[1] + 1) * self.slice_us
        every = pd.concat(list(rows))[["source", "ts_us", "seq", "id"]].assign(done=False)
        newest = int(every["ts_us"].max())
        held = _unpack(self.rows)
        if held is not None:
            every = pd.concat([held, every])
        every = every.sort_values(["source", "ts_us"], kind="stable").reset_index(drop=True)
        at, code = every["ts_us"].to_numpy(np.int64), pd.factorize(every["source"], use_na_sentinel=False)[0]
        own, done = (at >= start) & (at < end), every["done"].to_numpy(bool)
        now = burst_rows(at, self.width, self.threshold, code) & ~done & own
        if now.any():
            yield every.loc[now, ["source", "ts_us", "seq", "id"]]
        every["done"] = done | now
        counts = every["done"].to_numpy(bool) | ~own
        keep = ~counts | (every.groupby([code, at, counts]).cumcount().to_numpy() < self.threshold)
        self._settle(every[keep], self._passed(timerValues))
        self._wake(newest, key[1])


def _at(records: DataFrame, delay: str | None) -> DataFrame:
    timed = records.where(F.col("ts_us").isNotNull()).withColumn("at", F.timestamp_micros("ts_us"))
    return timed if delay is None else timed.withWatermark("at", delay)


def _mode(delay: str | None) -> str:
    return "None" if delay is None else "EventTime"


def _bucket():
    return F.pmod(F.hash("source"), F.lit(BUCKETS)).alias("bucket")


def slice_summaries(records: DataFrame, slice_secs: int = SLICE_SECS, delay: str | None = None) -> DataFrame:
    """Stream of (source, slice) summaries; the last one of a slice counts."""
    configure(records.sparkSession)
    span = slice_secs * 1_000_000
    cut = _at(records, delay).select(*(["at"] if delay else []), F.col("source").cast("string").alias("source"), "ts_us", "seq",
                                     severity_rank("level").cast("int").alias("rank"))
    cut = cut.select("*", _bucket(), F.floor(F.col("ts_us") / span).alias("slice"))
    return cut.groupBy("bucket", "slice").transformWithStateInPandas(
        SliceSummaries(span, 0, delay is not None), SUMMARY_KINDS, "Update", _mode(delay))


def slice_bursts(records: DataFrame, window_secs: float, threshold: int, slice_secs: int = SLICE_SECS, delay: str | None = None) -> DataFrame:
    """Append-only stream of burst rows: source, ts_us, seq, id. A row goes to
    its slice and to the neighbours that it may be in a window with."""
    configure(records.sparkSession)
    width = int(window_secs * 1_000_000)
    span = max(slice_secs * 1_000_000, width, 1)   # so that a window meets at most two slices

    def slice_of(t):
        return F.floor(t / span)
    ends = F.array_distinct(F.array(slice_of(F.col("ts_us") - width), slice_of(F.col("ts_us")), slice_of(F.col("ts_us") + width)))
    cut = _at(records, delay).select(*(["at"] if delay else []), F.col("source").cast("string").alias("source"), "ts_us", "seq",
                                     F.col("id").cast("string").alias("id"))
    cut = cut.select("*", _bucket(), F.explode(ends).alias("slice"))
    return cut.groupBy("bucket", "slice").transformWithStateInPandas(
        SliceBursts(span, width, threshold, delay is not None), "source string, ts_us long, seq long, id string", "Append", _mode(delay))
