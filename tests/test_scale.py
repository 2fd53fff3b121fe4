"""What keeps tasks small and steps cheap as tables grow."""
import numpy as np
from pyspark.sql import functions as F

from logloom import session
from logloom.operators import cluster as C
from logloom.operators import vectorize as VZ
from logloom.registry import as_queries
from logloom.registry.vectors import probed

SF = "/root/testdata/sf0.001"


def piece_rows(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_one_row_group_in_many_pieces_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "PIECE_ROWS", 1000)
    path, cores = str(tmp_path / "one"), spark.sparkContext.defaultParallelism
    spark.range(20_000).coalesce(1).write.parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "2k")
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= cores and max(piece_rows(scan)) == 20_000
        out = session.spread(scan)
        assert len(piece_rows(out)) == 20 and max(piece_rows(out)) <= 1100
        assert sorted(r.id for r in out.collect()) == list(range(20_000))
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_even_and_small_pieces_and_empty_tables_pass(spark, tmp_path):
    path = str(tmp_path / "even")
    spark.range(0, 1600, 1, spark.sparkContext.defaultParallelism * 2).write.parquet(path)
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "64m")
        scan = spark.read.parquet(path)
        assert session.spread(scan) is scan
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert session.spread(scan.where("id < 0")).count() == 0


def test_steps_multiply_few_rows_as_dense_matrices():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, 300)
    ends = np.r_[0, np.cumsum(sizes)]
    slots, weights = rng.integers(0, 40, ends[-1]), rng.random(ends[-1])   # slots may repeat in a row
    x = np.zeros((300, 40))
    np.add.at(x, (np.repeat(np.arange(300), sizes), slots), weights)
    rows, seen = np.arange(0, 300, 2), []
    for part, used, dense in VZ._steps(rows, ends, slots, weights):
        assert len(part) <= VZ.ROWS_PER_STEP
        assert np.allclose(dense, x[part][:, used]) and np.allclose(x[part].sum(axis=1), dense.sum(axis=1))
        seen += list(part)
    assert seen == list(rows)


def test_probes_shuffle_no_terms_and_no_vectors(spark):
    text = as_queries()["vectorize_tfidf"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "explode(arrays_zip" not in text
    assert not any("Exchange hashpartitioning" in line and "embedding" in line for line in text.splitlines())


def test_probes_of_a_split_without_a_basis_are_zero(spark):
    kind = "split string, seq long, slots array<int>, weights array<double>"
    rows = spark.createDataFrame([("a", 1, [0, 1], [0.6, 0.8]), (None, 2, [0], [1.0])], kind)
    vectors = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "seq long, embedding array<double>")
    got = {r.seq: r.holds for r in probed(spark, rows, {"a": np.eye(2)}, vectors).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_one_pass_sums_every_start(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 6))
    fits = [x[:3], x[10:14], x[20:22]]
    table = spark.createDataFrame([([float(v) for v in r],) for r in x], "embedding array<double>").repartition(4)
    for fit, (sums, counts, cost) in zip(fits, C._one_pass(table, fits)):
        squared = ((x[:, None] - fit[None]) ** 2).sum(axis=2)
        place = squared.argmin(axis=1)
        assert np.array_equal(counts, np.bincount(place, minlength=len(fit)))
        assert np.allclose(sums, [x[place == j].sum(axis=0) for j in range(len(fit))])
        assert np.isclose(cost, squared.min(axis=1).sum())
