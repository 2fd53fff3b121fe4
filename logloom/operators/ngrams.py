"""One and two word terms of texts, found, counted and looked up inside the tasks.

A term is never a string before it is handed on: words are numbered, and a
pair is the two numbers of its words.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import WORD
from .heavy import SUMMARY

# Texts whose characters are all below this one are cut into words by bytes.
LATIN = 0x250
# Words that a task counts or looks up in one go.
WORDS_PER_STEP = 1 << 18
# Counters of all splits, and words, that a task holds before it hands them on.
HELD = 1 << 21
NUMBERED = 1 << 19
# A summary that is handed on may be wrong by one in so many of the terms it met.
SURE = 1 << 20

_ASCII_WORD = np.array([b < 0x80 and (chr(b).isalnum() or b == 0x5F) for b in range(256)])
_LATIN_WORD = np.array([chr(c).isalpha() for c in range(0x80, LATIN)])


def spelled(split: Column, doc: Column, text: Column, records: DataFrame) -> DataFrame:
    """(split, doc, text, wide) of every record: its text in lower case; or, if
    some characters are not Latin, its words with blanks between, and ``wide``."""
    return cut_wide(records.select(split.cast("string").alias("split"), doc.alias("doc"), F.lower(F.coalesce(text, F.lit(""))).alias("text")), "text", "wide")


def cut_wide(records: DataFrame, text: str, wide: str) -> DataFrame:
    """A lower-cased text cut into words here if it cannot be cut by bytes."""
    beyond = (F.length(text) < F.octet_length(text)) & F.col(text).rlike(f"[^\\x00-\\x{{{LATIN - 1:x}}}]")
    words = F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), " ")
    return records.withColumn(wide, beyond).withColumn(text, F.when(F.col(wide), words).otherwise(F.col(text)))


def cut_words(texts: pa.StringArray, wide: bool) -> tuple[np.ndarray, pa.StringArray]:
    """Where the words of each text end, and all words of two or more characters.
    A ``wide`` text is its words with blanks between."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[at[0]:at[-1]] if whole is not None else np.empty(0, np.uint8)
    at -= at[0]
    inside, lead = (data != 0x20, []) if wide else (_ASCII_WORD[data], np.flatnonzero(data >= 0xC0))
    if len(lead):   # a Latin character beyond ASCII has two bytes
        letter = _LATIN_WORD[(data[lead] & 0x1F).astype(np.int64) * 64 + (data[lead + 1] & 0x3F) - 0x80]
        inside[lead] = inside[lead + 1] = letter
    filled = at[1:] > at[:-1]
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    before[at[:-1][filled]] = False
    after[at[1:][filled] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = last - first
    if len(lead):
        beyond = np.zeros(len(data) + 1, np.int64)
        beyond[lead + 2] = 1
        beyond = np.cumsum(beyond)
        size = size - (beyond[last] - beyond[first])
    kept = size > 1
    inside[first[~kept]] = inside[last[~kept] - 1] = False
    first, last = first[kept], last[kept]
    ends = np.r_[0, np.cumsum(last - first)].astype(np.int32)
    found = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return np.searchsorted(first, at), found


@dataclass
class Step:
    """Some texts of a batch: which rows, where the words of each end, numbers
    of all words, and the distinct words that these number."""
    rows: np.ndarray
    ends: np.ndarray
    code: np.ndarray
    names: pa.Array

    @classmethod
    def of(cls, rows: np.ndarray, ends: np.ndarray, words: pa.Array) -> Step:
        coded = words.dictionary_encode()
        return cls(rows, ends, coded.indices.to_numpy().astype(np.int64), coded.dictionary)

    def groups(self, split: pa.Array) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
        """Per split: the place of each word's text in this step, and its number."""
        row = np.repeat(np.arange(len(self.rows)), np.diff(self.ends))
        named = split.take(pa.array(self.rows)).dictionary_encode("encode")
        group = named.indices.to_numpy()[row] if len(named.dictionary) > 1 else None
        for g, own in enumerate(named.dictionary.to_pylist()):
            if group is None:
                yield own, row, self.code
            else:
                mine = group == g
                yield own, row[mine], self.code[mine]


def steps(text: pa.Array, wide: pa.Array) -> Iterator[Step]:
    """Texts of a batch in pieces of at most WORDS_PER_STEP words, or of one text."""
    apart = wide.to_numpy(zero_copy_only=False).astype(bool)
    for kind in np.unique(apart):
        own = np.flatnonzero(apart == kind)
        some = (text if len(own) == len(text) else text.take(pa.array(own))).cast(pa.string())
        # a word takes two bytes and one between it and the next
        ends, first = np.r_[0, np.cumsum(1 + np.asarray(pc.binary_length(some), np.int64) // 3)], 0
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS_PER_STEP, "right")) - 1)
            yield Step.of(own[first:last], *cut_words(some.slice(first, last - first), bool(kind)))
            first = last


def plain(names: pa.Array) -> list[str]:
    return names.to_numpy(zero_copy_only=False).tolist()


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][:len(values)])
    return first, np.diff(np.r_[first, len(values)])


def term_counts(row: np.ndarray, code: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts: their first word, their second (-1 for a
    single word), their occurrences, and the texts they are in."""
    bits = int(distinct).bit_length()
    pair = row[1:] == row[:-1]
    term = np.r_[code << bits, (code[:-1] << bits | code[1:] + 1)[pair]]
    term |= np.r_[row, row[:-1][pair]] << 2 * bits
    term.sort()
    first, tf = runs(term)
    term, shift = term[first] & (1 << 2 * bits) - 1, int(tf.max(initial=0)).bit_length()
    if 2 * bits + shift < 64:
        term = term << shift | tf
        term.sort()
        term, tf = term >> shift, term & (1 << shift) - 1
    else:   # a text of millions of words
        order = np.argsort(term)
        term, tf = term[order], tf[order]
    first, df = runs(term)
    total, key = np.add.reduceat(tf, first) if len(first) else df, term[first]
    return key >> bits, (key & (1 << bits) - 1) - 1, total, df


class Tally:
    """Misra-Gries counters of one split, as arrays in the order of their keys:
    a kept term was met at least ``total`` times and at most ``error`` more, a
    term not kept at most ``error`` times."""

    def __init__(self):
        self.key, self.total, self.df = (np.empty(0, np.int64) for _ in range(3))
        self.error = self.met = self.waiting = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return len(self.key) + self.waiting

    def add(self, key: np.ndarray, total: np.ndarray, df: np.ndarray, counters: int | None) -> None:
        self.parts.append((key, total, df))
        self.waiting += len(key)
        self.met += int(total.sum())
        if self.waiting > max(len(self.key), counters or WORDS_PER_STEP):
            self.fold(counters)

    def fold(self, counters: int | None) -> None:
        key, total, df = (np.concatenate(a) for a in zip((self.key, self.total, self.df), *self.parts))
        self.parts, self.waiting = [], 0
        order = np.argsort(key)
        key = key[order]
        first, _ = runs(key)
        self.key = key[first]
        if len(first):
            self.total, self.df = np.add.reduceat(total[order], first), np.add.reduceat(df[order], first)
        if counters is not None and len(self.key) > 2 * counters:
            self.less(int(np.partition(self.total, -counters - 1)[-counters - 1]))

    def less(self, by: int) -> None:
        """Take ``by`` from every counter; the smallest end."""
        kept = self.total > by
        self.error += by
        self.key, self.total, self.df = self.key[kept], self.total[kept] - by, self.df[kept]

    def close(self, counters: int | None) -> None:
        self.fold(counters)
        if counters is not None and self.met // SURE > self.error:
            self.less(self.met // SURE - self.error)


def summaries(counters: int | None):
    """Counters of every split in a task's texts, as (split, term, total, df); a
    row without term has the split's error. Without a bound, counts are exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__   # a new word gets the next number
        held: dict[str | None, Tally] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(numbers), pa.string())
            for split in list(held):
                own = held.pop(split)
                own.close(counters)
                term = names.take(pa.array(own.key >> 31))
                second = pa.array((own.key & (1 << 31) - 1) - 1, mask=own.key & (1 << 31) - 1 == 0)
                term = pc.coalesce(pc.binary_join_element_wise(term, names.take(second), " "), term)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split] * (len(term) + 1), pa.string()), pa.concat_arrays([term, pa.array([None], pa.string())]),
                     pa.array(np.r_[own.total, own.error], pa.int64()), pa.array(np.r_[own.df, 0], pa.int64())],
                    names=["split", "term", "total", "df"])
            numbers.clear()

        for batch in batches:
            for step in steps(batch.column("text"), batch.column("wide")):
                number = np.fromiter(map(numbers.__getitem__, plain(step.names)), np.int64, len(step.names))
                for split, row, code in step.groups(batch.column("split")):
                    one, two, total, df = term_counts(row, code, len(number))
                    key = number[one] << 31
                    key[two >= 0] |= number[two[two >= 0]] + 1
                    held.setdefault(split, Tally()).add(key, total, df, counters)
                if sum(map(len, held.values())) > HELD or len(numbers) > NUMBERED:
                    yield from rows()
        yield from rows()
    return count


class Listed:
    """Places of listed terms, found by the numbers of their words."""

    def __init__(self, terms: list[str]):
        parts = [t.split(" ") for t in terms]
        self.size, self.word = len(terms), {}
        for w in (w for words in parts for w in words):
            self.word.setdefault(w, len(self.word))
        self.single = np.full(len(self.word), -1)
        pairs = []
        for place, words in enumerate(parts):
            if len(words) == 1:
                self.single[self.word[words[0]]] = place
            else:
                pairs.append((self.word[words[0]] * len(self.word) + self.word[words[1]], place))
        keys = np.array(sorted(pairs) + [(np.iinfo(np.int64).max, -1)], np.int64)   # the last one is never met
        self.pair, self.place = np.ascontiguousarray(keys[:, 0]), keys[:, 1]

    def find(self, row: np.ndarray, code: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Listed terms of some texts: the text, the place, and how often; in this order."""
        word = np.fromiter((-1 if n is None else n for n in map(self.word.get, names)), np.int64, len(names))[code]
        known = np.flatnonzero(word >= 0)
        single = self.single[word[known]]
        two = np.flatnonzero((word[1:] >= 0) & (word[:-1] >= 0) & (row[1:] == row[:-1]))
        key = word[two] * len(self.word) + word[two + 1]
        near = np.searchsorted(self.pair, key)
        hit = self.pair[near] == key
        met = np.r_[(row[known] * self.size + single)[single >= 0], row[two[hit]] * self.size + self.place[near[hit]]]
        met.sort()
        first, tf = runs(met)
        return met[first] // self.size, met[first] % self.size, tf


def recount(candidates):
    """Exact occurrences of listed terms: (split, terms) per split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = {split: Listed(terms) for split, terms in candidates.value.items()}
        sums = {split: np.zeros((2, own.size), np.int64) for split, own in listed.items()}
        for batch in batches:
            for step in steps(batch.column("text"), batch.column("wide")):
                names = plain(step.names)
                for split, row, code in step.groups(batch.column("split")):
                    if split in listed:
                        _, place, tf = listed[split].find(row, code, names)
                        sums[split][0] += np.bincount(place, tf, listed[split].size).astype(np.int64)
                        sums[split][1] += np.bincount(place, minlength=listed[split].size)
        for split, terms in candidates.value.items():
            met = np.flatnonzero(sums[split][0])
            if len(met):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split] * len(met), pa.string()), pa.array(terms, pa.string()).take(pa.array(met)),
                     *(pa.array(s[met], pa.int64()) for s in sums[split])], names=SUMMARY_NAMES)
    return count


SUMMARY_NAMES = [part.split()[0] for part in SUMMARY.split(", ")]
