import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.mixing import WEIGHTS, mix, mix_digest, split_quotas

from .helpers import DOCUMENTS, documents, words


def water(sizes: dict):
    """Targets by raising the level until the caps leave it there."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else weight[s] * rest / w for s in names}
        above = {s for s in names if s not in full and out[s] > 3 * sizes[s]}
        if not above:
            return out
        full |= above


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        source = rng.choice(["a", "a", "a", "a", "b", "é", "z" if i % 40 == 0 else "c", None])
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)), source))
    return rows


def test_targets_and_taken_words(spark, corpus):
    got = mix_digest(documents(spark, corpus)).collect()
    sizes = {}
    for _, text, source in corpus:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = water(sizes)
    source = {r[0]: r[2] for r in corpus}
    taken, largest = {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(words(corpus[r["doc_id"]][1])) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] and len(r["shards"]) == r["copies"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_on_any_partitioning(spark, corpus):
    docs = documents(spark, corpus)
    a = {r["doc_id"]: tuple(r) for r in mix_digest(docs).collect()}
    b = {r["doc_id"]: tuple(r) for r in mix_digest(docs.repartition(7)).collect()}
    assert a == b


def test_quotas_are_exact():
    blocks = np.array([100, 3, 0, 57])
    quota = split_quotas(blocks, 7, np.random.default_rng(0))
    assert (quota.sum(axis=1) == blocks).all() and (quota >= 0).all()
    assert quota.sum(axis=0).max() - quota.sum(axis=0).min() <= 1


def test_mixed_rows_are_the_copies(spark, corpus):
    docs = documents(spark, corpus)
    want = {r["doc_id"]: r["copies"] for r in mix_digest(docs, 8).collect() if r["copies"]}
    mixed = mix(docs, 8)
    assert mixed.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == want
    shards = mix_digest(docs, 8).select(F.explode("shards").alias("s")).groupBy("s").count().collect()
    assert {r["s"] for r in shards} == set(range(8))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "z", None), (7, " \t\n", "b")]
    got = mix_digest(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["size"] for r in got} == {0, 1, 2}
    empty = spark.createDataFrame([], DOCUMENTS)
    assert mix_digest(empty).count() == 0 and mix(empty).count() == 0
    clash = documents(spark, rows).withColumn("size", F.lit("s")).withColumn("u", F.lit("u")).withColumn("rank", F.lit(1))
    assert mix(clash).columns == clash.columns
