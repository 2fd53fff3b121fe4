import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm.common import components
from logloom.llm.simhash import keep_one, link_prints, shard_masks, simhash_components, simhash_digest, tie

from .helpers import DOCUMENTS, classes, documents, words


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_prints(seed, n=300):
    """Clusters of fingerprints with chains of small steps."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = int(rng.integers(0, 2 ** 64, dtype=np.uint64))
        for _ in range(rng.integers(1, 6)):
            for k in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


def brute(prints):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    return classes(len(prints), zip(*np.nonzero(near)))


@pytest.mark.parametrize("size", [10, 10 ** 7, 10 ** 9, 10 ** 11])
def test_shards_and_trees_find_the_components(size):
    prints = near_prints(size % 97)
    links = []
    for mask in shard_masks(size):
        key = prints & np.uint64(mask)
        order = np.lexsort((prints, key))
        group = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        whole = np.ones(len(order), dtype=bool)
        links += zip(*tie(group, prints[order], whole, whole, 4))
    place = {int(p): i for i, p in enumerate(prints)}
    got = classes(len(prints), [(place[int(a)], place[int(b)]) for a, b in links])
    assert got == brute(prints)


@pytest.mark.parametrize("tree_rows", [100_000, 5])
def test_links_of_many_trees(spark, tree_rows):
    prints = near_prints(5)
    # crowd one shard
    crowd = np.unique((prints[:200] & np.uint64((1 << 14) - 1)) | np.uint64(7 << 50))
    prints = np.unique(np.r_[prints, crowd])
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    found = components(link_prints(table, tree_rows=tree_rows)).collect()
    label = {r["node"]: r["component"] for r in found}
    got = [label.get(int(x), int(x)) for x in prints.view(np.int64)]
    want = brute(prints)
    for a in range(len(prints)):
        assert (got[a] == got[want[a]]) and (want[a] == a or got[a] in label.values())
    assert len(set(got)) == len(set(want))


def test_documents_against_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"Word{i}" for i in range(50)]
    rows = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(3, 200))]
        rows.append((3 * i, " ".join(text)))
        if i % 3 == 0:
            text[rng.randrange(len(text))] = "changed"
            rows.append((3 * i + 1, "\n".join(text).upper()))
    rows += [(900, None), (901, ""), (902, " \t "), (903, "one"), (903, "one"), (904, "ONE")]
    got = simhash_digest(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    label = classes(len(rows), pairs)
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(least.get(c, i), i)
    want = sorted((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_keep_one_of_each_group(spark):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (9, "x y z"), (9, "x y z"), (None, None), (None, ""), (11, "")]
    docs = documents(spark, rows).withColumn("fp", F.lit("mine"))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "a b c d e"), (9, "x y z"), (11, "")]
    assert keep_one(documents(spark, [(None, "q"), (None, "q")])).count() == 1


def test_empty_and_very_long(spark):
    assert simhash_components(spark.createDataFrame([], DOCUMENTS)).count() == 0
    assert keep_one(spark.createDataFrame([], DOCUMENTS)).count() == 0
    long = " ".join(str(i % 9973) for i in range(200_000))
    got = simhash_digest(documents(spark, [(1, long), (2, long + " end")])).collect()
    assert {r["component_id"] for r in got} == {1}
    assert {r["fingerprint"] for r in got if r["doc_id"] == 1} == {f"{fingerprint(long):016x}"}


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 400) if i % 50]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = classes(401, chain)
    assert got == {v: want[v] for pair in chain for v in pair}
