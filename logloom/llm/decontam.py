"""Benchmark decontamination: q-gram lemma filter in diagonal bands, then banded alignment."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a shared gram.
Q = 8
# Edits allowed per character of a passage.
RATE = 0.1
# A longer benchmark text is searched as passages of this many characters that overlap by half.
PASSAGE = 400
# Characters of benchmark text indexed at once; more of it is searched block by block.
BLOCK_CHARS = 2 << 20
# Characters of documents scanned at once; a longer document is scanned in overlapping pieces.
CHUNK = 2 << 20
# Grams are looked up in a table of this many bits first.
TABLE_BITS = 21

GAP = np.uint32(0x110000)  # stands between texts; no character has this code
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3

MATCH = "struct<item_id:long,start:int,end:int,edits:int,passage_start:int,passage_chars:int>"


def normalise(text: str | None) -> str:
    """Lower case, any run of white space one space."""
    return " ".join((text or "").lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every run of ``q`` codes."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    if q == 1:
        return codes.astype(np.uint64) + np.uint64(1)
    half = q // 2
    part = gram_hashes(codes, half)
    out = part[:len(part) - half] * np.uint64(pow(BASE, half, 1 << 64)) + part[half:]
    if q % 2:
        out = out[:-1] * np.uint64(BASE) + (codes[q - 1:].astype(np.uint64) + np.uint64(1))
    return out


def edit_budget(m: int, q: int = Q, rate: float = RATE) -> tuple[int, int]:
    """(k, t): edits allowed in ``m`` characters, and the grams that a region
    within k edits must share, at least one: m + 1 - q - k q."""
    k = min(int(rate * m), max((m - q) // q, 0))
    return k, m + 1 - q - k * q


class Index:
    """Grams of a bounded block of passages."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE, passage: int = PASSAGE):
        self.q = q
        self.item, self.at, self.text, self.codes = [], [], [], []
        for item, text in items:
            text = normalise(text)
            for at in range(0, max(len(text) - passage // 2, 1), passage // 2):
                part = text[at:at + passage]
                if len(part) >= q:
                    self.item.append(item)
                    self.at.append(at)
                    self.text.append(part)
                    self.codes.append(codes_of(part))
        self.m = np.array([len(c) for c in self.codes], dtype=np.int64)
        limits = [edit_budget(int(m), q, rate) for m in self.m]
        self.k = np.array([k for k, _ in limits], dtype=np.int64)
        self.t = np.array([t for _, t in limits], dtype=np.int64)
        # bands of two strides hold every run of 2 k + 1 diagonals
        self.stride = 2 * self.k + 1
        grams = [gram_hashes(c, q) for c in self.codes]
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.gram, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self._slot(self.gram)] = True
        self.reach = int((self.m + 4 * self.k + 4).max()) if len(self.m) else 0

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * MIX) >> np.uint64(64 - TABLE_BITS)

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, first diagonal) of bands that share enough grams.

        A gram at text place p and passage place i lies on diagonal p - i.
        Counts of neighbouring strides add up to those of the band over both.
        """
        hashes = gram_hashes(codes, self.q)
        if not len(hashes) or not len(self.gram):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.flatnonzero(self.table[self._slot(hashes)])
        k = np.minimum(np.searchsorted(self.gram, hashes[place]), len(self.gram) - 1)
        same = self.gram[k] == hashes[place]
        place, k = place[same], k[same]
        n = self.count[k]
        entry = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who = self.owner[entry]
        # diagonals begin at minus the longest passage
        diagonal = np.repeat(place, n) - self.place[entry] + self.reach
        key, count = np.unique(who * (1 << 40) + diagonal // self.stride[who], return_counts=True)
        following = np.zeros(len(key), dtype=np.int64)
        if len(key) > 1:
            following[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        who, stripe = key >> 40, key & ((1 << 40) - 1)
        preceding = np.r_[True, key[1:] != key[:-1] + 1] if len(key) else np.empty(0, bool)
        # a band may also begin one stride before the first that has grams
        ok = count + following >= self.t[who]
        lone = preceding & (count >= self.t[who]) & ~ok
        ok |= lone
        return who[ok], stripe[ok] * self.stride[who[ok]] - self.reach

    def align(self, who: int, region: np.ndarray, lowest: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the passage in the region, by the cheapest
        alignment on diagonals from ``lowest`` over a band of two strides and k
        on both sides; None beyond the budget.

        A cell holds edits and, below them, the text place where its path
        began. A place outside the region fits no character, so reading it
        costs what leaving out the character does.
        """
        passage, k = self.codes[who], int(self.k[who])
        n, m, exact = len(region), len(passage), region.tobytes().find(passage.tobytes())
        if exact >= 0 and exact % 4 == 0:
            return 0, exact // 4, exact // 4 + m
        width = 2 * int(self.stride[who]) + 2 * k + 1
        left = lowest - k
        padded = np.full(width + m, GAP)
        lo, hi = max(left, 0), min(left + width + m, n)
        if hi > lo:
            padded[lo - left:hi - left] = region[lo:hi]
        read = np.lib.stride_tricks.sliding_window_view(padded, width)[:m]
        edits = (read != passage[:, None]).astype(np.int64) << 32
        cost = np.clip(left + np.arange(width, dtype=np.int64), 0, n)
        step = np.arange(width, dtype=np.int64) << 32
        one, limit = 1 << 32, (k + 1) << 32
        for i in range(m):
            new = cost + edits[i]
            np.minimum(new[:-1], cost[1:] + one, out=new[:-1])
            new -= step
            np.minimum.accumulate(new, out=new)
            new += step
            cost = new
            if i % 16 == 15 and cost.min() >= limit:
                return None
        best = int(np.argmin(cost))
        found, start = divmod(int(cost[best]), one)
        return (found, start, min(max(left + m + best, start), n)) if found <= k else None

    def matches(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """(text, passage, edits, start, end) of verified bands over texts laid
        out in ``codes``; of a passage that a text holds exactly, only that."""
        who, first = self.bands(codes)
        done, exact = set(), set()
        for a, d in zip(who.tolist(), first.tolist()):
            k, m, stride = int(self.k[a]), int(self.m[a]), int(self.stride[a])
            lo, hi = d - k, d + 2 * stride + m + k
            for t in range(max(int(np.searchsorted(ends, lo, "right")), 0), len(starts)):
                if starts[t] >= hi:
                    break
                s, e = max(lo, int(starts[t])), min(hi, int(ends[t]))
                if e - s < m - k or (t, a) in exact:
                    continue
                found = self.align(a, codes[s:e], d - s)
                if found is None:
                    continue
                hit = (t, a, found[0], found[1] + s - int(starts[t]), found[2] + s - int(starts[t]))
                if not hit[2]:
                    exact.add((t, a))
                if hit not in done:
                    done.add(hit)
                    yield hit


def search_texts(texts: list[str], index: Index, chunk: int = CHUNK) -> list[list[tuple]]:
    """Per text, the best (item, start, end, edits, passage start, passage chars)
    of every passage found; places are in the normalised text."""
    best: list[dict] = [{} for _ in texts]
    laid, owner, size = [], [], 0

    def scan():
        nonlocal laid, owner, size
        if not laid:
            return
        parts, starts, ends, at = [], [], [], 0
        for codes, _, _ in laid:
            starts.append(at)
            ends.append(at + len(codes))
            parts += [codes, np.full(1, GAP)]
            at += len(codes) + 1
        for t, a, edits, s, e in index.matches(np.concatenate(parts), np.array(starts), np.array(ends)):
            _, text, shift = laid[t]
            old = best[text].get(a)
            new = (edits, s + shift, e + shift)
            if old is None or new < old:
                best[text][a] = new
        laid, size = [], 0

    for i, text in enumerate(texts):
        codes = codes_of(normalise(text))
        at = 0
        while True:
            part = codes[at:at + chunk]
            if len(part):
                laid.append((part, i, at))
                size += len(part)
            if size >= chunk:
                scan()
            if at + chunk >= len(codes):
                break
            at += chunk - 2 * index.reach
    scan()
    return [[(index.item[a], s, e, edits, index.at[a], int(index.m[a])) for a, (edits, s, e) in sorted(b.items())]
            for b in best]


def _finder(sent) -> Column:
    @F.pandas_udf(f"array<{MATCH}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "start", "end", "edits", "passage_start", "passage_chars")
        for texts in batches:
            yield pd.Series([[dict(zip(names, m)) for m in found] for found in search_texts(list(texts), sent.value)],
                            dtype="object")
    return find


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = BLOCK_CHARS):
    """Lists of (item, text), each of no more than ``most`` characters or one item."""
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).where(f"`{text_col}` IS NOT NULL").toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", q: int = Q, rate: float = RATE, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with ``matches``: benchmark passages in each whole text.

    A passage of m characters is found where some part of the text is within
    ``rate`` * m edits of it, both in lower case with single spaces. By the
    q-gram lemma such a part shares m + 1 - q - k q grams with it on 2 k + 1
    neighbouring diagonals; overlapping bands of diagonals with that many are
    aligned, all others are out. The benchmark is indexed in blocks of bounded
    size, each broadcast and met by all documents, which are neither shuffled
    nor joined. Null and empty texts match nothing; benchmark texts that are
    null or shorter than ``q`` characters have no gram and are not searched;
    repeated items are reported each; repeated documents keep their rows. An
    input column named ``matches`` is replaced.
    """
    context = docs.sparkSession.sparkContext
    found = [_finder(context.broadcast(Index(block, q, rate, passage)))(F.col(text_col))
             for block in benchmark_blocks(benchmark, item_col, item_text)]
    if not found:
        return docs.withColumn("matches", F.array().cast(f"array<{MATCH}>"))
    return docs.withColumn("matches", found[0] if len(found) == 1 else F.flatten(F.array(*found)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document and benchmark item found in it, with its best passage."""
    found = find_passages(docs.select(id_col, "text"), benchmark, **options)
    rows = found.select(id_col, F.inline_outer("matches")).where("item_id IS NOT NULL")
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    return find_passages(docs, benchmark, **options).where(F.size("matches") == 0).select(*docs.columns)
