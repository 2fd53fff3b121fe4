"""Streams over several micro-batches equal one batch run."""
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.operators import detect as D
from logloom.operators.condense import condense_template
from logloom.registry import inputs as I
from logloom.session import scratch_path
from logloom.streaming import live as L
from logloom.streaming.run import current_groups, keep_updates, land, read_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    """The record table in pieces that are out of time order."""
    path = scratch_path(spark, "pieces")
    I.t_log(spark, SF).repartition(6, F.hash("message")).write.parquet(path)
    return path


def stream(spark, table):
    return read_stream(spark, table, spark.read.parquet(table).schema, max_files=1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_many_batches_land_once(spark, table):
    path, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "checkpoint")
    for _ in range(2):   # a restart with the same checkpoint adds nothing
        landed = land(stream(spark, table), path, checkpoint)
    assert landed.exceptAll(spark.read.parquet(table)).count() == 0
    assert landed.count() == spark.read.parquet(table).count()


def test_updates_survive_a_restart(spark, table):
    path, checkpoint = scratch_path(spark, "updates"), scratch_path(spark, "checkpoint")
    counted = stream(spark, table).groupBy("level").agg(F.count("*").alias("n"))
    for _ in range(2):
        keep_updates(counted, ["level"], path, checkpoint)
    got = current_groups(spark, path, StructType(list(counted.schema.fields)), ["level"])
    assert rows(got) == rows(spark.read.parquet(table).groupBy("level").count())


@pytest.fixture(scope="module")
def in_time(spark, tmp_path_factory):
    """The record table in five files, one time range each, in order: nothing is late."""
    path = str(tmp_path_factory.mktemp("intime") / "t")
    log = I.t_log(spark, SF).orderBy("ts_us").collect()
    os.makedirs(path)
    for i in range(5):
        piece = log[i * len(log) // 5:(i + 1) * len(log) // 5]
        spark.createDataFrame(piece, I.t_log(spark, SF).schema).coalesce(1).write.parquet(f"{path}/tmp{i}")
        (part,) = [f for f in os.listdir(f"{path}/tmp{i}") if f.endswith(".parquet")]
        os.replace(f"{path}/tmp{i}/{part}", f"{path}/{i}.parquet")
        os.utime(f"{path}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def piece_stream(spark, path):
    return read_stream(spark, f"{path}/*.parquet", I.t_log(spark, SF).schema, max_files=1)


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_every_running_result_is_complete(spark, in_time, delay):
    batch = I.t_log(spark, SF)
    levels = batch.withColumn("window", F.window(F.timestamp_micros("ts_us"), L.PERIOD)).groupBy("window", "level").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    assert rows(L.review_digest(piece_stream(spark, in_time), delay=delay)) == rows(L.digest_of_levels(levels))
    assert rows(L.running_counts(piece_stream(spark, in_time), "os_source", delay)) == rows(
        batch.groupBy("os_source").count())
    got = L.running_condense(piece_stream(spark, in_time), delay)
    want = condense_template(batch)
    columns = ["source", "level", "message", "seq", "id", "count"]
    assert rows(got.select(*columns)) == rows(want.select(*columns))
    assert rows(L.running_offenders(piece_stream(spark, in_time), delay=delay)) == rows(D.repeat_offenders(batch))
    assert rows(L.running_bursts(piece_stream(spark, in_time), 3600, 3, delay).select("seq")) == rows(
        D.detect_bursts(batch, 3600, 3).where("is_burst").select("seq"))


def test_late_rows_reach_the_detectors(spark, table):
    batch = spark.read.parquet(table)
    assert rows(L.running_escalations(stream(spark, table))) == rows(D.escalation_sources(batch))
    got = L.running_bursts(stream(spark, table), 3600, 3).select("seq")
    assert rows(got) == rows(D.detect_bursts(batch, 3600, 3).where("is_burst").select("seq"))
    assert rows(L.running_offenders(stream(spark, table))) == rows(D.repeat_offenders(batch))


def test_content_of_a_review(spark, table):
    landed = spark.read.parquet(table)
    first, last = landed.agg(F.min("ts_us"), F.max("ts_us")).first()
    middle = (first + last) // 2
    content = L.review_content(landed, first, middle, last=5)
    assert content["critical"].count() == 5 and content["critical"].agg(F.max("ts_us")).first()[0] < middle
    assert content["patterns"].where("type = 'cluster'").agg(F.sum("count")).first()[0] == landed.where(
        F.col("ts_us") < middle).count()
    assert content["sample"].agg(F.max("ts_us")).first()[0] < middle


def test_scratch_is_empty_after_its_scope(spark, table):
    from logloom.session import path_exists, scratch_scope, stage
    with scratch_scope(spark):
        staged = stage(spark.range(10).toDF("n"))
        assert L.running_counts(stream(spark, table), "level").count() > 0
        assert path_exists(spark, staged.scratch_path)
    assert not path_exists(spark, staged.scratch_path)
