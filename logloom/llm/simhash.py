"""SimHash near-duplicates: fingerprints linked by BK-trees over shards that share bits."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, discard, stage
from .common import components, run_starts, unite

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
# Fingerprints that one tree holds; a larger shard has several trees.
TREE_ROWS = 100_000
# Fingerprints that one task holds, all its trees together.
TASK_ROWS = 500_000
# Pairs (query, node) that a search step handles at once.
STEP = 1 << 18
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# ---- fingerprints ----------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, block):
        part = words[lo:lo + block + shingle - 1]
        runs = zip(*[part[i:] for i in range(shingle)]) if len(part) >= shingle else [part]
        # eight bytes of each digest, the highest first
        hashes = b"".join(map(xxhash.xxh64_digest, map(b" ".join, runs), repeat(SEED)))
        columns = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        votes += np.concatenate([np.bincount(columns[:, j], minlength=256) @ BYTE_BITS for j in range(8)])
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    return prints(text)


# ---- BK-trees --------------------------------------------------------------

class Forest:
    """BK-trees over several groups of distinct fingerprints, one tree each.

    ``key`` holds parent * 128 + distance of every edge in order and ``child``
    the node it leads to: a node has at most one child per distance, and the
    items below that child are all at that distance from the node.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        """Rows are sorted by group. Each group's first row is its root."""
        self.prints = prints
        self.groups = group[run_starts(group)]
        self.roots = run_starts(group)
        at = np.repeat(self.roots, np.diff(np.r_[self.roots, len(group)]))
        item = np.arange(len(group))
        item, at = item[item != at], at[item != at]
        keys, children = [], []
        while len(item):
            key = at * 128 + np.bitwise_count(prints[item] ^ prints[at])
            order = np.argsort(key, kind="stable")
            key, item = key[order], item[order]
            first = run_starts(key)
            keys.append(key[first])
            children.append(item[first])
            at = np.repeat(item[first], np.diff(np.r_[first, len(key)]))
            item, at = item[item != at], at[item != at]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.child = np.concatenate(children)[order] if children else np.empty(0, np.int64)

    def root_of(self, group: np.ndarray) -> np.ndarray:
        """The root of each group's tree, -1 where it has none."""
        if not len(self.groups):
            return np.full(len(group), -1)
        k = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        return np.where(self.groups[k] == group, self.roots[k], -1)

    def search(self, group: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, some at a time. By the
        triangle inequality only edges d - radius to d + radius are followed."""
        root = self.root_of(group)
        query = np.flatnonzero(root >= 0)
        todo = [(query, root[query])]
        while todo:
            query, node = todo.pop()
            if len(query) > STEP:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            if not len(query):
                continue
            d = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            lo = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * 128 + np.minimum(d + radius, 127), side="right")
            n = hi - lo
            edge = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            todo.append((np.repeat(query, n), self.child[edge]))


def tie(group: np.ndarray, prints: np.ndarray, in_tree: np.ndarray, asks: np.ndarray,
        radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect, in each group, what is connected by links
    between its tree and the rows that ask. Rows are sorted by group and fingerprint."""
    forest = Forest(group[in_tree], prints[in_tree])
    rows, asking = np.flatnonzero(in_tree), np.flatnonzero(asks)
    label = np.arange(len(group))
    for query, node in forest.search(group[asking], prints[asking], radius):
        label = unite(label, asking[query], rows[node])
    moved = np.flatnonzero(label != np.arange(len(group)))
    return prints[moved], prints[label[moved]]


# ---- shards ----------------------------------------------------------------

def bit_blocks(n: int) -> list[int]:
    """Masks of ``n`` nearly equal runs of bits."""
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def shard_masks(n_prints: int, radius: int = RADIUS, per_shard: int = 64) -> list[int]:
    """Bits that fingerprints of a shard share, one mask per way of sharing.

    Of radius + e blocks, two fingerprints within the radius agree in at least
    e. More blocks mean longer keys and smaller shards; ``e`` grows with the
    number of fingerprints until evenly spread ones come to ``per_shard`` each.
    Any ``e`` finds the same links.
    """
    for e in range(1, 5):
        if n_prints / 2 ** (BITS * e / (radius + e)) <= per_shard:
            break
    blocks = bit_blocks(radius + e)
    return [sum(c) for c in combinations(blocks, e)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def link_prints(prints: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) whose
    connected components are those of all pairs within the radius.

    Each fingerprint goes to one shard per mask, keyed by its bits there. A
    shard's tree meets all its fingerprints. One with more than ``tree_rows``
    is dealt over several trees, each of which meets the fingerprints of its
    own and all later trees, so a task holds one tree and one block of queries.
    """
    n = prints.count()
    masks = shard_masks(n, radius)
    keyed = prints.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "bits"))
    crowded = stage(keyed.groupBy("mask", "bits").count().where(F.col("count") > tree_rows)
                    .select("mask", "bits", F.ceil(F.col("count") / tree_rows).cast("int").alias("trees")),
                    "crowded")
    if crowded.isEmpty():
        dealt = keyed.withColumns({"tree": F.lit(0), "block": F.lit(0), "in_tree": F.lit(True)})
        n_rows = n * len(masks)
    else:
        own = F.pmod(F.xxhash64("fp"), F.coalesce("trees", F.lit(1))).cast("int")
        dealt = (keyed.join(crowded, ["mask", "bits"], "left").withColumn("own", own)
                 .withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("own"))))
                 .withColumn("in_tree", F.col("tree") == F.col("own")))
        # the tree travels to every block of its queries
        dealt = (dealt.withColumn("block", F.explode(F.when(
            F.col("in_tree"), F.sequence(F.col("own"), F.coalesce("trees", F.lit(1)) - 1)).otherwise(
            F.array("own")))).drop("trees", "own"))
        n_rows = dealt.count()
    parts = max(ceil(n_rows / task_rows), 1)
    parts = max(parts, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        cols = {c: rows.column(c).to_numpy() for c in ("mask", "bits", "tree", "block", "fp", "in_tree")}
        order = np.lexsort((cols["fp"], cols["block"], cols["tree"], cols["bits"], cols["mask"]))
        cols = {c: v[order] for c, v in cols.items()}
        new = np.zeros(len(order), dtype=bool)
        for c in ("mask", "bits", "tree", "block"):
            new[1:] |= cols[c][1:] != cols[c][:-1]
        asks = ~cols["in_tree"] | (cols["tree"] == cols["block"])
        a, b = tie(np.cumsum(new), np.ascontiguousarray(cols["fp"]).view(np.uint64), cols["in_tree"], asks, radius)
        yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (dealt.select("mask", "bits", "tree", "block", "fp", "in_tree")
            .repartition(parts, "mask", "bits", "tree", "block")
            .mapInArrow(grow, "a long, b long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One staged row (id, fp, mark, component, first) per document.

    ``fp``: its fingerprint. ``component``: the smallest id among documents
    that links reach. ``mark``: a hash of the whole row; ``first``: whether
    (id, mark) is the smallest of the component, nulls last. Null, empty and
    blank texts share fingerprint 0. Rows that repeat an id are documents of
    their own and, if all columns agree, equal marks. Null ids never name a
    component unless it has no other.
    """
    rows = stage(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), shingle).alias("fp"),
                             F.xxhash64(*docs.columns).alias("mark")), "prints")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    prints = stage(rows.groupBy("fp").agg(F.min(place).alias("least")), "distinct")
    comps = stage(components(link_prints(prints.select("fp"), radius)), "classes")
    known = prints.join(comps, prints.fp == comps.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("class"))
    lowest = known.groupBy("class").agg(F.min("least").alias("least"))
    named = stage(known.select("fp", "class").join(lowest, "class").select("fp", "least"), "named")
    out = stage(rows.join(named, "fp").select(
        "id", "fp", "mark", F.col("least.id").alias("component"),
        (F.struct(F.col("id").isNull().alias("none"), "id", "mark") == F.col("least")).alias("first")), "simhash")
    discard(rows, prints, comps, named)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id
    (and, if ids repeat, of the smallest hash of the row). Documents that no
    other resembles all stay."""
    found = simhash_components(docs, id_col, text_col, **options)
    marked = docs.withColumn("__mark", F.xxhash64(*docs.columns))
    listed = [F.col("id").alias("__id"), F.col("mark").alias("__same")]
    here = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__same"))
    dropped = broadcast_if_small(stage(found.where("NOT first").select(*listed).distinct(), "dropped"))
    kept = marked.join(dropped, here, "left_anti")
    again = stage(found.where("first").groupBy("id", "mark").count().where("count > 1").select(*listed), "again")
    if again.isEmpty():
        return kept.drop("__mark")
    # rows that repeat in every column: one of them stays
    again = broadcast_if_small(again)
    once = kept.join(again, here, "left_semi").dropDuplicates([id_col, "__mark"])
    return kept.join(again, here, "left_anti").unionByName(once).drop("__mark")


def simhash_digest(docs: DataFrame) -> DataFrame:
    found = simhash_components(docs.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))
