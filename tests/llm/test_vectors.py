import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.vectors import vector_components, vector_digest

from .helpers import classes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    n = len(rows)
    link = np.zeros((n, n), dtype=bool)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is None or la != lb or a is None or b is None or len(a) != len(b) or not len(a):
                continue
            if any(c is None or not np.isfinite(c) for c in [*a, *b]):
                continue
            x, y = (np.array(v, dtype=np.float32).astype(np.float64) for v in (a, b))
            if x.any() and y.any() and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                link[i, j] = link[j, i] = True
    label = classes(n, zip(*np.nonzero(link)))
    least = {}
    for (i, _, _), c in zip(rows, label):
        least[c] = min(least.get(c, i), i)
    return sorted((r[0], int(link[k].sum()), least[label[k]], least[label[k]] == r[0]) for k, r in enumerate(rows))


def clustered(seed, n=250, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    out = []
    for i in range(n):
        x = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.3, 1.0])
        out.append((i, [float(c) for c in (x * rng.choice([0.01, 1, 50])).astype(np.float32)], int(rng.integers(3))))
    return out


@pytest.mark.parametrize("tile", [2048, 16])
@pytest.mark.parametrize("dim", [64, 3])
def test_links_and_components_against_all_pairs(spark, tile, dim):
    rows = clustered(dim, dim=dim)
    got = vector_components(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()
    assert sorted((r["id"], r["n_links"], r["component"], r["kept"]) for r in got) == brute(rows)


def test_odd_vectors(spark):
    x = [1.0, 2.0, 3.0]
    rows = [(1, x, 0), (2, x, 0), (3, x, 1), (4, x, None), (5, x, None), (6, None, 0), (7, [], 0), (8, [0.0] * 3, 0),
            (9, [1.0, None, 3.0], 0), (10, [1.0, float("nan"), 3.0], 0), (11, [1.0, float("inf"), 3.0], 0),
            (12, [2.0, 4.0, 6.0], 0), (13, [1.0, 2.0], 0), (14, [1e38, 2e38, 3e38], 0), (15, [-1.0, -2.0, -3.0], 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit("x")).withColumn("copies", F.lit(None))
    got = vector_digest(docs).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == brute(rows)
    assert vector_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    none = vector_digest(spark.createDataFrame([(None, x, 0), (1, x, 0)], SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in none) == [("1", 0, True), ("None", 0, False)]


def test_repeated_ids_count_each(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)]
    got = vector_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == [(1, 2), (1, 2), (2, 2)]
