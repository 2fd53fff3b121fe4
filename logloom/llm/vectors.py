"""Embedding near-duplicates: a subspace pigeonhole join under a squared-distance budget."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage
from .common import components, unite

COSINE = 0.93
BLOCKS = 4
# Coordinates of a block that its grid is laid over.
GRID = 1
# Vectors that one task compares with each other; a fuller cell is dealt over pairs of tiles.
TILE = 2048
# Slack for rounding in the grid and the budget; the exact check follows.
SLACK = 1e-9
# Rows of a tile that are compared with the others at once.
STEP = 256


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A seeded random rotation, which spreads a difference evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    n = min(blocks, dim)
    cuts = [round(i * dim / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision and without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linkable(vectors: pa.Array) -> np.ndarray:
    """Places of vectors that can be linked: given, of finite components, not zero."""
    ok = np.zeros(len(vectors), dtype=bool)
    for i, v in enumerate(vectors):
        if v.is_valid and len(v) and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False)
            ok[i] = np.isfinite(x).all() and x.any()
    return np.flatnonzero(ok)


def budget(cosine: float) -> float:
    """Squared distance of unit vectors at that cosine."""
    return 2.0 - 2.0 * cosine


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row (rep, label, vector, copies) per label and vector; the smallest id stands for its copies."""
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    return rows.where(usable).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def _cells(cosine: float, blocks: int):
    """Every vector that can be linked, at home in one cell per block and a
    visitor in the cells next to it; of two neighbouring cells only one is visited."""
    limit = budget(cosine)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for batch in batches:
            batch = batch.take(pa.array(linkable(batch.column("vector"))))
            lengths = batch.column("vector").value_lengths().to_numpy()
            for dim in map(int, np.unique(lengths)):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                n = part.num_rows
                if dim not in turned:
                    turned[dim] = rotation(dim)
                y = units(part.column("vector").flatten().to_numpy().reshape(n, dim)) @ turned[dim]
                for j, (lo, hi) in enumerate(block_edges(dim, blocks)):
                    width = np.sqrt(limit * (hi - lo) / dim) + SLACK
                    g = min(GRID, hi - lo)
                    cell = np.floor(y[:, lo:lo + g] / width).astype(np.int64)
                    for step in np.ndindex(*(3,) * g):
                        move = np.array(step) - 1
                        if tuple(move) < (0,) * g:
                            continue
                        code = np.zeros(n, dtype=np.int64)
                        for c in range(g):
                            code = code * (1 << 20) + (cell[:, c] + move[c] + (1 << 19))
                        yield pa.RecordBatch.from_pydict({
                            "label": part.column("label"), "dim": np.full(n, dim, np.int32),
                            "block": np.full(n, j, np.int32), "cell": code,
                            "home": np.full(n, not move.any()), "rep": part.column("rep"),
                            "copies": part.column("copies"), "vector": part.column("vector")})
    return spread


def _compare(cosine: float, blocks: int):
    """Of each (label, dim, block, cell, tile, other): a row (a, b, n) per
    vector ``a`` with links there, ``n`` the vectors it links to, copies
    counted, and ``b`` the smallest vector it is connected with there. A pair
    counts in the first block whose budget it meets."""
    limit = budget(cosine)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for group in _groups(batches, ["label", "dim", "block", "cell", "tile", "other"]):
            dim, j = group["dim"], group["block"]
            if dim not in turned:
                turned[dim] = rotation(dim)
            edges = block_edges(dim, blocks)
            lo, hi = edges[j]
            x = units(group["vector"])
            y = x @ turned[dim]
            order = np.argsort(y[:, lo], kind="stable")
            x, y = x[order], y[order]
            rep, copies, home, side = (group[c][order] for c in ("rep", "copies", "home", "side"))
            norm = [(y[:, a:b] ** 2).sum(axis=1) for a, b in edges]
            width = np.sqrt(limit * (hi - lo) / dim) + SLACK

            def within(k, s, e, t):
                a, b = edges[k]
                d = norm[k][s:e, None] + norm[k][None, s:t] - 2.0 * (y[s:e, a:b] @ y[s:t, a:b].T)
                return d <= limit * (b - a) / dim + SLACK

            # range join on the block's first coordinate, then the whole block under its budget
            end = np.searchsorted(y[:, lo], y[:, lo] + width, side="right")
            label, n = np.arange(len(y)), np.zeros(len(y), dtype=np.int64)
            for s in range(0, len(y), STEP):
                e = min(s + STEP, len(y))
                t = int(end[e - 1])
                if t - s < 2:
                    continue
                ok = within(j, s, e, t)
                ok &= np.arange(s, e)[:, None] < np.arange(s, t)[None, :]
                # visitors meet residents only; of two tiles, rows of one meet those of the other
                ok &= home[s:e, None] | home[None, s:t]
                if group["tile"] != group["other"]:
                    ok &= side[s:e, None] != side[None, s:t]
                if not ok.any():
                    continue
                for k in range(j):
                    ok &= ~within(k, s, e, t)
                ok &= x[s:e] @ x[s:t].T >= cosine
                n[s:e] += ok @ copies[s:t]
                n[s:t] += copies[s:e] @ ok
                a, b = np.nonzero(ok)
                label = unite(label, a + s, b + s)
            seen = np.flatnonzero(n)
            if len(seen):
                lowest = np.full(len(y), np.iinfo(np.int64).max)
                np.minimum.at(lowest, label, rep)
                yield pa.RecordBatch.from_pydict({"a": rep[seen], "b": lowest[label[seen]], "n": n[seen]})
    return tiles


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict]:
    """Runs of equal keys from sorted rows, over batch borders."""
    held: list[pa.Table] = []
    held_key = None

    def made(parts):
        t = pa.concat_tables(parts)
        out = {k: t.column(k)[0].as_py() for k in keys}
        flat = np.concatenate([c.flatten().to_numpy() for c in t.column("vector").chunks])
        out["vector"] = flat.reshape(len(t), -1)
        for c in ("rep", "copies", "home", "side"):
            out[c] = t.column(c).to_numpy()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.zeros(len(t), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(new), len(t)]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != held_key:
                yield made(held)
                held = []
            held_key = key
            held.append(t.slice(s, e - s))
    if held:
        yield made(held)


def link_vectors(distinct: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links between distinct vectors (rep, label, vector, copies) of one label
    at that cosine or more, as rows (a, b, n): parts of the number ``n`` of
    vectors linked with ``a``, and one vector ``b`` it is connected with.

    Rotated unit vectors are cut into blocks of few coordinates. If two are
    within the squared distance D, some block of w of the n coordinates is
    within D * w / n. Each block is range-joined under that budget: a grid over
    its first coordinate brings vectors together, that coordinate sorts them,
    the distance in the block decides. Every candidate is then checked by its
    cosine and counts in the first block that finds it. A cell of more than
    ``tile`` vectors is dealt over pairs of tiles. Pairs are summed where they
    are found, so a group of many near copies sends a row per vector and tile.
    """
    spark = distinct.sparkSession
    kind = dict(distinct.dtypes)["vector"]
    spread = stage(distinct.select("rep", F.col("label").cast("long").alias("label"), "vector", "copies").mapInArrow(
        _cells(cosine, blocks), "label long, dim int, block int, cell long, home boolean, rep long, "
        f"copies long, vector {kind}"), "cells")
    key = ["label", "dim", "block", "cell"]
    sizes = (spread.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
             .where("homes > 0 AND n > 1").select(*key, F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    sizes = broadcast_if_small(stage(sizes, "cellsizes"))
    met = (spread.join(sizes, key)
           .withColumn("side", F.pmod(F.xxhash64("rep", "home"), F.col("tiles")).cast("int"))
           # tile i meets itself and every other tile once
           .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
           .withColumns({"tile": F.least("side", "with"), "other": F.greatest("side", "with")})
           .drop("with", "tiles"))
    full = [*key, "tile", "other"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (met.repartition(parts, *full).sortWithinPartitions(*full)
            .mapInArrow(_compare(cosine, blocks), "a long, b long, n long"))


def vector_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                      label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS,
                      tile: int = TILE) -> DataFrame:
    """(id, label, n_links, component, kept) per vector.

    Vectors link when their labels (whole numbers) are equal and not null and
    their cosine in double precision is ``cosine`` or more. Null, empty and
    zero vectors, those with a null or non-finite component, and those of
    another dimension link with nothing: no links, a component of their own.
    Equal vectors of a label are compared once and counted by their number, so
    ``n_links`` counts all other vectors; rows repeating an id count each.
    ``kept``: whether the id is its component. Ids are whole numbers; a vector
    with a null id is compared with none.
    """
    src = stage(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"),
                            F.col(label_col).alias("label")), "vectors")
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "vector", lambda x: x != 0)
    distinct = stage(distinct_vectors(src.where("id IS NOT NULL")).where(usable), "distinctvectors")
    links = stage(link_vectors(distinct, cosine, blocks, tile), "vectorlinks")
    degree = links.groupBy("a").agg(F.sum("n").alias("others"))
    comps = components(links.select("a", "b"))
    classes = stage(distinct.join(degree, distinct.rep == degree.a, "left")
                    .join(comps, distinct.rep == comps.node, "left")
                    .select("label", "vector", F.coalesce("component", "rep").alias("component"),
                            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vectorclasses")
    out = src.join(classes, ["label", "vector"], "left").select(
        "id", "label", F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
        .alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def vector_digest(rows: DataFrame) -> DataFrame:
    found = vector_components(rows)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
