"""Clusters: assignment, centroids, labels, confidence, samples."""
from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import vectors as V
from ..functions.templates import message_tokens
from ..session import broadcast_if_small, discard, stage
from .order import explode_once, group_profile, top_in_group, with_ordinal

# Numbers of the centroids that one block holds; more centroids are met block by block.
BLOCK_NUMBERS = 4_000_000
# Differences a task holds at once when it compares with a matrix.
STEP_NUMBERS = 4_000_000
# Rows, one per value of a hash, that the first centers of K-means are chosen from.
SEEDED = 4096
# Up to so many tasks hand their sums straight back; those of more are added on the way.
TASKS_AT_ONCE = 64


def auto_k(n: int) -> int:
    """Cluster count for ``n`` rows: root of half, between 2 and 10."""
    return min(n, max(2, min(10, isqrt(n // 2))))


def auto_k_column(n: Column) -> Column:
    return F.least(n, F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.sqrt(n / 2)))))


def group_clusters(records: DataFrame) -> DataFrame:
    """Clusters without vectors: one per (level, source), numbered as first seen."""
    seen = records.groupBy("level", "source").agg(F.min("seq").alias("first_seq"))
    numbered = with_ordinal(seen, "first_seq", "cluster_id").select(
        F.col("level").alias("__level"), F.col("source").alias("__source"), "cluster_id")
    numbered = broadcast_if_small(numbered)
    same = (records["level"].eqNullSafe(numbered["__level"])
            & records["source"].eqNullSafe(numbered["__source"]))
    return records.join(numbered, same).drop("__level", "__source")


def kmeans_clusters(records: DataFrame, k: int | None = None, starts: int = 10, seed: int = 42,
                    max_iter: int = 300, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """K-means on ``embedding``: the cheapest of several starts.

    Returns the records with ``cluster_id`` and the centroid table. Training
    reads one staged vector column. Rows are assigned in place, the lower
    cluster on ties.
    """
    staged = stage(records.select("embedding"), "vectors")
    n = staged.count()
    k = auto_k(n) if k is None else min(k, n)
    if k < 2:
        mean = staged.select(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("centroid"))
        return (records.withColumn("cluster_id", F.lit(0).cast("long")),
                mean.select(F.lit(0).cast("long").alias("cluster_id"), "centroid"))
    fits = kmeans_starts(staged, k, starts, seed, max_iter, tol)
    centroids = cheapest(staged, fits)
    discard(staged)
    return nearest_centroid(records, centroids).drop("squared_distance"), centroids


def cheapest(vectors: DataFrame, fits: list[np.ndarray]) -> DataFrame:
    """Centroid table of the start with the least cost, the first on ties."""
    return centroid_rows(vectors.sparkSession, fits[int(np.argmin(start_costs(vectors, fits)))])


def centroid_rows(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                 "cluster_id long, centroid array<double>")


def kmeans_starts(vectors: DataFrame, k: int, starts: int, seed: int = 42, max_iter: int = 300,
                  tol: float = 1e-4) -> list[np.ndarray]:
    """Settled centers of every start.

    Each start takes its first centers from up to SEEDED different rows, chosen
    by their hashes, far from each other. Then every pass over the data moves the centers of all starts that
    still move: a task adds up vectors and counts per start and cluster, and
    one small table of sums comes back. A start whose centers move no further
    than ``tol`` leaves, so the slowest start decides on the passes. A cluster
    without rows keeps its center.
    """
    place = F.pmod(F.xxhash64("embedding"), F.lit(SEEDED)).alias("place")
    rows = vectors.groupBy(place).agg(F.min_by("embedding", F.xxhash64(F.lit(seed), "embedding")).alias("embedding"))
    seeds = np.array([r["embedding"] for r in sorted(rows.collect())], dtype=np.float64)  # at most SEEDED rows
    centers = [_far_apart(seeds, k, np.random.default_rng(seed + i)) for i in range(starts)]
    moving = list(range(starts))
    for _ in range(max_iter):
        if not moving:
            break
        still = []
        for i, (sums, counts, _) in zip(moving, _one_pass(vectors, [centers[i] for i in moving])):
            moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers[i])
            if np.sqrt(((moved - centers[i]) ** 2).sum(axis=1).max()) > tol:
                still.append(i)
            centers[i] = moved
        moving = still
    return centers


def start_costs(vectors: DataFrame, fits: list[np.ndarray]) -> list[float]:
    """Sum of squared distances to the nearest center under each start, in one pass."""
    return [cost for _, _, cost in _one_pass(vectors, fits)]


def _far_apart(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows drawn one after another in proportion to their squared distance
    from those before; fewer than ``k`` if there are no more different ones."""
    chosen = [rows[rng.integers(len(rows))]]
    near = ((rows - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and near.sum() > 0:
        chosen.append(rows[rng.choice(len(rows), p=near / near.sum())])
        near = np.minimum(near, ((rows - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _one_pass(vectors: DataFrame, fits: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per start: sums and counts of the rows nearest to each center, and the cost."""
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast(fits)
    kind = "start int, sums binary"

    def tables(totals: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
        have = [i for i, t in enumerate(totals) if t is not None]
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([totals[i].tobytes() for i in have], pa.binary())], names=["start", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per center: the sum of its vectors, their number and their cost
        totals = [np.zeros((len(c), c.shape[1] + 2)) for c in sent.value]
        every = np.concatenate(sent.value)
        length, bounds = (every ** 2).sum(axis=1), np.cumsum([0, *map(len, sent.value)])
        for batch in batches:
            whole = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(1, STEP_NUMBERS // len(every))
            for at in range(0, len(whole), step):
                x = whole[at:at + step]
                far = length - 2 * (x @ every.T)
                own = (x ** 2).sum(axis=1)
                chosen, cost = np.zeros_like(far), np.zeros_like(far)
                row = np.arange(len(x))
                for lo, hi in zip(bounds, bounds[1:]):
                    place = lo + far[:, lo:hi].argmin(axis=1)
                    chosen[row, place] = 1
                    cost[row, place] = np.maximum(far[row, place] + own, 0)
                sums = np.column_stack([chosen.T @ x, chosen.sum(axis=0), cost.sum(axis=0)])
                for total, lo, hi in zip(totals, bounds, bounds[1:]):
                    total += sums[lo:hi]
        yield from tables(totals)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray | None] = [None] * len(sent.value)
        for batch in batches:
            for i, sums in zip(batch.column("start").to_pylist(), batch.column("sums").to_pylist()):
                totals[i] = np.frombuffer(sums) if totals[i] is None else totals[i] + np.frombuffer(sums)
        yield from tables(totals)

    tasks = min(vectors.rdd.getNumPartitions(), context.defaultParallelism)
    parts = vectors.select("embedding").coalesce(tasks).mapInArrow(partial, kind)
    if tasks > TASKS_AT_ONCE:   # else a row per start and task is little to add up here
        parts = parts.repartition(min(len(fits), tasks), "start").mapInArrow(added, kind)
    totals: list[np.ndarray | None] = [None] * len(fits)
    for r in parts.collect():  # at most TASKS_AT_ONCE rows per start
        own = np.frombuffer(r["sums"])
        totals[r["start"]] = own if totals[r["start"]] is None else totals[r["start"]] + own
    sent.unpersist()
    wide = [t.reshape(len(c), -1) for t, c in zip(totals, fits)]
    return [(t[:, :-2], t[:, -2], float(t[:, -1].sum())) for t in wide]


def centroids(clustered: DataFrame) -> DataFrame:
    """Mean vector of every cluster, summed inside the tasks first."""
    mean = Summarizer.mean(array_to_vector("embedding"))
    return clustered.groupBy("cluster_id").agg(vector_to_array(mean).alias("centroid"))


def _bounded(centroid_table: DataFrame) -> DataFrame:
    table = stage(centroid_table.withColumn("centroid_norm", V.norm("centroid")), "centroids")
    return broadcast_if_small(table)


def _nearest(records: DataFrame, ids: list[int], vectors: list[list[float]]) -> Column:
    """(squared distance, id) of the nearest of a block of centroids, the lower id on ties."""
    shared = records.sparkSession.sparkContext.broadcast((np.array(ids), np.array(vectors)))

    @F.pandas_udf("d double, id long")
    def nearest(embedding: pd.Series) -> pd.DataFrame:
        names, matrix = shared.value
        step = max(1, STEP_NUMBERS // matrix.size)
        best, distance = np.empty(len(embedding), dtype=np.int64), np.empty(len(embedding))
        for at in range(0, len(embedding), step):
            part = np.stack(embedding.iloc[at:at + step].to_numpy())
            squared = ((part[:, None, :] - matrix[None]) ** 2).sum(axis=2)
            place = squared.argmin(axis=1)
            best[at:at + step], distance[at:at + step] = names[place], squared.min(axis=1)
        return pd.DataFrame({"d": distance, "id": best})

    return nearest("__vector")


def nearest_centroid(records: DataFrame, centroid_table: DataFrame) -> DataFrame:
    """The cluster whose centroid is closest, the lower id on ties.

    Rows are compared in place and never multiplied by the centroids. Those
    are sorted by id and sent in blocks of BLOCK_NUMBERS numbers; a row keeps
    the nearest of each block and then of all, so one block or many give the
    same result by the same arithmetic.
    """
    # the partition's number never decides, but keeps the vector's expression in a projection of its own:
    # the planner cannot hand a Python function an expression of nested lambdas
    records = records.withColumn("__vector", F.when(F.spark_partition_id() >= 0, F.col("embedding")))
    best, ids, vectors = [], [], []
    for r in centroid_table.select("cluster_id", "centroid").orderBy("cluster_id").toLocalIterator():
        if ids and (len(ids) + 1) * len(vectors[0]) > BLOCK_NUMBERS:
            best.append(_nearest(records, ids, vectors))
            ids, vectors = [], []
        ids.append(r["cluster_id"])
        vectors.append(list(r["centroid"]))
    best.append(_nearest(records, ids, vectors))
    return (records.withColumn("__best", best[0] if len(best) == 1 else F.least(*best))
            .withColumn("cluster_id", F.col("__best.id"))
            .withColumn("squared_distance", F.col("__best.d")).drop("__best", "__vector"))


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("count"))


def with_centroid(clustered: DataFrame, centroid_table: DataFrame) -> DataFrame:
    return clustered.join(_bounded(centroid_table), "cluster_id", "left")


def member_distances(clustered: DataFrame, centroid_table: DataFrame) -> DataFrame:
    """``distance`` of each row to the centroid of its cluster."""
    return with_centroid(clustered, centroid_table).withColumn(
        "distance", V.centroid_distance("embedding", "centroid", "centroid_norm")).drop(
        "centroid", "centroid_norm")


def cluster_confidence(clustered: DataFrame, centroid_table: DataFrame) -> DataFrame:
    """Mean cosine of the members of each cluster to its centroid."""
    cosine = V.member_cosine("embedding", "centroid", "centroid_norm")
    return with_centroid(clustered, centroid_table).groupBy("cluster_id").agg(
        F.avg(F.coalesce(cosine, F.lit(1.0))).alias("confidence"))


def cluster_modes(clustered: DataFrame) -> DataFrame:
    """Size, first row and most common level, source and os_source of each
    cluster."""
    return group_profile(clustered, "cluster_id", ["level", "source", "os_source"])


def cluster_keywords(clustered: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most frequent tokens per cluster, first seen first on ties.

    First-seen order is one decimal (row order, then place in the message), a
    type the hash aggregate can update in place.
    """
    seen = F.col("seq").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("pos")
    tokens = clustered.select("cluster_id", "seq", message_tokens("message").alias("token"))
    counted = (explode_once(tokens, "token", "pos")
               .groupBy("cluster_id", "token")
               .agg(F.count("*").alias("n"), F.min(seen).alias("first")))
    return top_in_group(counted, ["cluster_id"], [F.col("n").desc(), F.col("first")], n).select(
        "cluster_id", "rank", "token", "n")


def cluster_labels(clustered: DataFrame) -> DataFrame:
    """``label`` as ``[level] source (os_source) | k1, k2, k3`` with empty parts
    left out, next to size and first row."""
    ranked = cluster_keywords(clustered).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("k"))
    joined = cluster_modes(clustered).join(ranked, "cluster_id", "left")
    words = F.array_join(F.col("k.token"), ", ")
    label = F.concat_ws(
        " ", F.concat(F.lit("["), F.coalesce("level", F.lit("")), F.lit("]")),
        F.coalesce("source", F.lit("")),
        F.when(F.col("os_source") != "", F.concat(F.lit("("), F.col("os_source"), F.lit(")"))),
        F.when(words != "", F.concat(F.lit("| "), words)))
    return joined.select("cluster_id", label.alias("label"), "count", "first_seq")


def sample_per_cluster(clustered: DataFrame, centroid_table: DataFrame | None = None,
                       n: int = S.SAMPLES_PER_CLUSTER) -> DataFrame:
    """The ``n`` rows nearest to the centroid per cluster, without vectors.

    Without centroids every distance is zero and the first rows are taken.
    """
    if centroid_table is None:
        placed = clustered.withColumn("distance", F.lit(0.0))
    else:
        placed = member_distances(clustered, centroid_table)
    return top_in_group(placed.drop("embedding"), ["cluster_id"],
                        [F.col("distance"), F.col("seq")], n)
