"""The most frequent terms of every split, without shuffling the terms of the texts."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, stage
from .order import top_in_group

# Counters of one split that a task carries on.
COUNTERS = 1 << 18
# Counters of all splits that a task holds before it hands them on.
HELD = 1 << 20
# Terms of the texts that a task counts or weighs in one go.
TERMS_PER_STEP = 1 << 17
SUMMARY = "split string, term string, total long, df long"


def list_ends(lists: pa.ListArray) -> np.ndarray:
    """Where each list ends in the flattened values; a null list is empty."""
    return np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))]


def in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of at most TERMS_PER_STEP terms, or of
    one row: what a task holds beside its counters does not follow the texts' lengths."""
    for batch in batches:
        ends, first = list_ends(batch.column("terms")), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + TERMS_PER_STEP, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def batch_counts(split: pa.Array, terms: pa.ListArray) -> Iterator[tuple[str | None, list[str], np.ndarray, np.ndarray]]:
    """Per split of a batch: its distinct terms, their occurrences and the texts they are in."""
    sizes = np.diff(list_ends(terms))
    coded = terms.flatten().dictionary_encode()
    if not len(coded):
        return
    named = split.dictionary_encode("encode")
    width = len(coded.dictionary)
    code = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(split)), sizes)
    in_row, tf = np.unique(row * width + code, return_counts=True)
    group = named.indices.to_numpy().astype(np.int64)[in_row // width]
    key, back = np.unique(group * width + in_row % width, return_inverse=True)
    total, df = np.bincount(back, tf, len(key)).astype(np.int64), np.bincount(back, minlength=len(key))
    for g in np.unique(key // width):
        own = key // width == g
        yield named.dictionary[int(g)].as_py(), coded.dictionary.take(pa.array(key[own] % width)).to_pylist(), total[own], df[own]


class Summary:
    """Misra-Gries counters of one split: a kept term was met at least ``total``
    times and at most ``error`` more; a term not kept at most ``error`` times."""

    def __init__(self):
        self.total, self.df, self.error = Counter(), Counter(), 0

    def add(self, terms: list[str], total: np.ndarray, df: np.ndarray, counters: int | None) -> None:
        self.total.update(dict(zip(terms, total.tolist())))
        self.df.update(dict(zip(terms, df.tolist())))
        if counters is not None and len(self.total) > 2 * counters:
            self.cut(counters)

    def cut(self, counters: int) -> None:
        """Take the largest count that does not fit from every counter."""
        if len(self.total) <= counters:
            return
        values = np.fromiter(self.total.values(), np.int64, len(self.total))
        least = int(np.partition(values, -counters - 1)[-counters - 1])
        self.error += least
        self.total = Counter({t: n - least for t, n in self.total.items() if n > least})
        self.df = Counter({t: self.df[t] for t in self.total})


def _summaries(counters: int | None):
    """Counters of every split in a task's rows, as (split, term, total, df); a
    row without term has the split's error. Without a bound, counts are exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Summary] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for split, own in held.items():
                terms = [*own.total, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split] * len(terms), pa.string()), pa.array(terms, pa.string()),
                     pa.array([*own.total.values(), own.error], pa.int64()), pa.array([*own.df.values(), 0], pa.int64())],
                    names=["split", "term", "total", "df"])
            held.clear()

        for batch in in_steps(batches):
            for split, *counts in batch_counts(batch.column("split"), batch.column("terms")):
                held.setdefault(split, Summary()).add(*counts, counters)
            if sum(len(s.total) for s in held.values()) > HELD:
                yield from rows()
        yield from rows()
    return count


def _recount(candidates):
    """Exact occurrences of listed terms: (split, terms) per split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {split: set(terms) for split, terms in candidates.value.items()}
        held = {split: Summary() for split in wanted}
        for batch in in_steps(batches):
            for split, terms, total, df in batch_counts(batch.column("split"), batch.column("terms")):
                listed = np.fromiter((t in wanted.get(split, ()) for t in terms), bool, len(terms))
                if listed.any():
                    held[split].add([t for t, ok in zip(terms, listed) if ok], total[listed], df[listed], None)
        for split, own in held.items():
            if own.total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split] * len(own.total), pa.string()), pa.array(list(own.total), pa.string()),
                     pa.array(list(own.total.values()), pa.int64()), pa.array(list(own.df.values()), pa.int64())],
                    names=["split", "term", "total", "df"])
    return count


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def top_terms(rows: DataFrame, most: int, counters: int = COUNTERS, summaries=_summaries, recount=_recount) -> DataFrame:
    """(split, term, total, df, rank): the ``most`` most frequent terms of each split, ties in alphabetical order.

    ``rows`` holds (split string, terms array<string>), or what ``summaries``
    and ``recount`` find terms in. Every task keeps a
    bounded summary of each split, and the summaries are added. A split whose
    summaries lost nothing is settled. Elsewhere a term that could be among
    the first has, with the possible error added, at least the count that the
    last of them is sure of; if that exceeds the error no unseen term can, and
    only these candidates are counted again. Splits where it does not, and
    candidates too many to send, are counted in full.
    """
    seen = stage(_sums(rows.mapInArrow(summaries(counters), SUMMARY)), "summaries")
    kept = seen.where("term IS NOT NULL")
    sure = top_in_group(kept.select("split", "total"), ["split"], [F.desc("total")], most)
    last = sure.groupBy("split").agg(F.max(F.when(F.col("rank") == most, F.col("total"))).alias("last"))
    errors = seen.where("term IS NULL").select(F.col("split").alias("__split"), F.col("total").alias("error"))
    cut = errors.join(last, F.col("split").eqNullSafe(F.col("__split")), "left").select("__split", "error", F.coalesce("last", F.lit(0)).alias("last"))
    cut = stage(cut, "cuts")   # one row per split
    lossy, unsure = cut.agg(F.expr("count_if(error > 0)"), F.expr("count_if(error > 0 AND error >= last)")).first()
    if not lossy:
        return _ranked(kept, most)
    open_ = cut.where("error > 0 AND error < last")
    asked = kept.join(broadcast_if_small(open_), F.col("split").eqNullSafe(F.col("__split"))).where(F.col("total") + F.col("error") >= F.col("last"))
    asked = stage(asked.select("split", "term"), "candidates")
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    exact = [kept.join(broadcast_if_small(cut.where("error = 0")), F.col("split").eqNullSafe(F.col("__split"))).select(kept.columns)]
    full = cut.where("error > 0" if _too_large(size) else "error > 0 AND error >= last")
    if not _too_large(size):
        listed: dict[str | None, list[str]] = {}
        for r in asked.toLocalIterator():
            listed.setdefault(r[0], []).append(r[1])
        sent = rows.sparkSession.sparkContext.broadcast(listed)
        exact.append(_sums(rows.mapInArrow(recount(sent), SUMMARY)))
    if _too_large(size) or unsure:
        wide = rows.join(broadcast_if_small(full), F.col("split").eqNullSafe(F.col("__split")), "left_semi")
        exact.append(_sums(wide.mapInArrow(summaries(None), SUMMARY)).where("term IS NOT NULL"))
    out = exact[0]
    for more in exact[1:]:
        out = out.unionByName(more)
    return _ranked(out, most)


def _too_large(size) -> bool:
    return size[0] > BROADCAST_ROWS or size[1] > BROADCAST_BYTES


def _ranked(counts: DataFrame, most: int) -> DataFrame:
    return top_in_group(counts.select("split", "term", "total", "df"), ["split"], [F.desc("total"), F.col("term")], most)
