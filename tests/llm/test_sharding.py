import random
import zlib

import pytest
from pyspark.sql import functions as F

from logloom.llm.sharding import plan_cuts, shard, shard_digest

from .helpers import DOCUMENTS, documents


def fewest(sizes, capacity):
    """Shards that greedy filling needs."""
    n, fill = 1, 0
    for s in sizes:
        if s > capacity:
            return len(sizes) + 1
        if fill + s > capacity:
            n, fill = n + 1, 0
        fill += s
    return n


def best_capacity(sizes, shards):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if fewest(sizes, c) <= shards)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_reach_the_smallest_capacity(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 30) for _ in range(60)]
    shards = rng.choice([2, 5, 9])
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "atom long, size long")
    alone, cuts = plan_cuts(table, shards)
    assert alone == [] and len(cuts) <= shards - 1 and cuts == sorted(cuts)
    edges = [0, *cuts, len(sizes)]
    assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) == best_capacity(sizes, shards)


def test_a_place_larger_than_a_share_stands_alone(spark):
    table = spark.createDataFrame([(i, 1000 if i == 7 else 10) for i in range(50)], "atom long, size long")
    alone, cuts = plan_cuts(table, 5)
    assert alone == [7] and len(cuts) == 3


def check(rows, shards):
    by_text = {}
    for r in rows:
        assert by_text.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    for k in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_digest_of_odd_rows(spark):
    rows = [(1, "aä"), (2, None), (3, ""), (3, ""), (None, "b c"), (5, "x" * 100_000), (6, "aä"), (6, "aä")]
    got = shard_digest(documents(spark, rows), 4).collect()
    assert len(got) == len(rows)
    check(got, 4)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["size"] == 3 + 16 and by_id[1]["text_crc32"] == zlib.crc32("aä".encode())
    assert by_id[2]["size"] == 16 and by_id[2]["text_crc32"] is None
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_hot_group_is_numbered_in_pieces(spark):
    rows = [(i, "same") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 6000)]
    got = shard_digest(documents(spark, rows), 8).collect()
    check(got, 8)


def test_sizes_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, f"{i:05}" + "x" * rng.randint(1, 200)) for i in range(8000)]
    got = shard_digest(documents(spark, rows), 10).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in got]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 10


def test_empty_table_and_clashing_columns(spark):
    assert shard_digest(spark.createDataFrame([], DOCUMENTS)).count() == 0
    docs = documents(spark, [(1, "a"), (2, "b")]).withColumn("shard", F.lit("old")).withColumn("slot", F.lit(9)).withColumn("atom", F.lit(3)).withColumn("size", F.lit(4))
    got = shard(docs, 2).collect()
    assert sorted((r["doc_id"], r["slot"]) for r in got) == [(1, 0), (2, 0)] and {r["shard"] for r in got} == {0, 1}
    assert {r["size"] for r in got} == {4} and {r["atom"] for r in got} == {3}


def test_no_python_in_the_plan(spark):
    plan = shard_digest(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
