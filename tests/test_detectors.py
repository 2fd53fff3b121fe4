"""Detectors over streams: state by source and slice of time, kept summaries, and their store."""
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import detect as D
from logloom.operators.order import ranked_in_group
from logloom.registry import inputs as I
from logloom.session import scratch_path
from logloom.streaming import live as L
from logloom.streaming.run import keyed_state, read_stream
from logloom.streaming.slices import NO_STEP, burst_rows, slice_bursts, slice_summaries, summaries
from logloom.streaming.store import BATCH, GroupStore, plan_merges

SHAPE = "id string, seq long, ts_us long, source string, level string"
LEVELS = ["DEBUG", "INFO", "NOTICE", "WARNING", "ERROR"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(spark, path, pieces):
    """One file per piece, read in this order."""
    os.makedirs(path)
    for i, piece in enumerate(pieces):
        spark.createDataFrame(piece, SHAPE).coalesce(1).write.parquet(f"{path}/_tmp{i}")
        (part,) = [f for f in os.listdir(f"{path}/_tmp{i}") if f.endswith(".parquet")]
        os.replace(f"{path}/_tmp{i}/{part}", f"{path}/{i}.parquet")
        os.utime(f"{path}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def stream(spark, path):
    return read_stream(spark, f"{path}/*.parquet", spark.createDataFrame([], SHAPE).schema, max_files=1)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Five files of ten minutes each; a fifth of the rows come one file late.
    One source has half of the rows; times repeat and lie on both sides of slices."""
    rng = np.random.default_rng(4)
    pieces = [[] for _ in range(6)]
    for seq in range(500):
        t = int(rng.integers(0, 3000)) * 1_000_000
        source = "hot" if seq % 2 else f"s{rng.integers(0, 12)}"
        level = LEVELS[int(rng.integers(0, 3 if source == "hot" else 5))]
        pieces[t // 600_000_000 + int(rng.random() < 0.2)].append((str(seq), seq, t, source, level))
    pieces[0].append(("no time", 1000, None, "hot", "ERROR"))
    return files(spark, str(tmp_path_factory.mktemp("shuffled") / "t"), pieces)


@pytest.mark.parametrize("delay", [None, "20 minutes"])
@pytest.mark.parametrize("slice_secs", [120, 1800])
def test_files_out_of_order_equal_one_batch(spark, shuffled, delay, slice_secs):
    batch = spark.read.parquet(f"{shuffled}/*.parquet")
    got = L.running_bursts(stream(spark, shuffled), 60, 4, delay, slice_secs)
    want = D.detect_bursts(batch, 60, 4).where("is_burst")
    assert rows(got) == rows(want.select("source", "ts_us", "seq", "id")) != []
    for step in (1, 2, 4):
        escalating = L.running_escalations(stream(spark, shuffled), step, delay, slice_secs)
        assert rows(escalating) == rows(D.escalation_sources(batch, step)) != []


def test_a_late_row_takes_an_escalation_back(spark, tmp_path):
    minute = 60_000_000
    first = [("0", 0, 0, "a", "DEBUG"), ("1", 1, 10 * minute, "a", "WARNING"), ("2", 2, 5 * minute, "b", "DEBUG")]
    late = [("3", 3, 4 * minute, "a", "INFO"), ("4", 4, 6 * minute, "a", "NOTICE")]
    path = files(spark, str(tmp_path / "t"), [first, late])
    only = read_stream(spark, f"{path}/0*.parquet", spark.createDataFrame([], SHAPE).schema)
    assert rows(L.running_escalations(only, 2)) == [("a",)]
    assert rows(L.running_escalations(stream(spark, path), 2)) == []


def test_rows_later_than_the_delay_are_left_out(spark, tmp_path):
    minute = 60_000_000
    pieces = [[("0", 0, 0, "a", "DEBUG")], [("1", 1, 100 * minute, "a", "DEBUG")], [("2", 2, 100 * minute, "a", "DEBUG")],
              [("3", 3, 1, "a", "ERROR"), ("4", 4, 101 * minute, "a", "DEBUG")]]
    path = files(spark, str(tmp_path / "t"), pieces)
    assert rows(L.running_escalations(stream(spark, path), 2, "10 minutes")) == []
    assert rows(L.running_bursts(stream(spark, path), 60, 3, "10 minutes").select("seq")) == [(1,), (2,), (4,)]
    assert rows(L.running_escalations(stream(spark, path), 2)) == [("a",)]


def _state_rows(spark, stream_, mode):
    """Rows of state after every batch, and rows each batch handed out."""
    seen = []
    with keyed_state(spark):
        query = (stream_.writeStream.outputMode(mode).foreachBatch(lambda df, n: seen.append(df.count()))
                 .option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start())
        query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]], seen


def test_state_is_bounded_by_the_delay(spark, tmp_path):
    minute = 60_000_000
    pieces = [[(f"{i}-{k}", i * 40 + k, (i * 40 + k) * minute, "a", "INFO") for k in range(40)] for i in range(6)]
    path = files(spark, str(tmp_path / "t"), pieces)
    for make, mode in ((lambda d: slice_summaries(stream(spark, path), 600, d), "update"),
                       (lambda d: slice_bursts(stream(spark, path), 60, 3, 600, d), "append")):
        bounded, _ = _state_rows(spark, make("10 minutes"), mode)
        whole, _ = _state_rows(spark, make(None), mode)
        assert bounded[-1] < whole[-1] and max(bounded[2:]) <= 8


def test_a_batch_renews_only_what_it_touches(spark, tmp_path):
    hour = 3_600_000_000
    pieces = [[("0", 0, 0, "a", "INFO"), ("1", 1, 0, "b", "INFO")], [("2", 2, 5, "b", "ERROR")], [("3", 3, hour, "b", "INFO")]]
    path = files(spark, str(tmp_path / "t"), pieces)
    _, handed = _state_rows(spark, slice_summaries(stream(spark, path), 1800), "update")
    assert handed == [2, 1, 1]


def test_a_stopped_detector_goes_on(spark, tmp_path):
    """Two runs with one checkpoint, a file each: the second knows the rows of the first."""
    second = 1_000_000
    path = files(spark, str(tmp_path / "t"), [[("0", 0, 0, "a", "DEBUG"), ("1", 1, 5 * second, "a", "DEBUG")]])
    places = dict(path=scratch_path(spark, "landed"), checkpoint=scratch_path(spark, "checkpoint"))
    kept = dict(path=scratch_path(spark, "kept"), checkpoint=scratch_path(spark, "checkpoint"))
    assert rows(L.running_bursts(stream(spark, path), 60, 3, **places)) == []
    assert rows(L.running_escalations(stream(spark, path), 2, **kept)) == []
    spark.createDataFrame([("2", 2, 9 * second, "a", "ERROR")], SHAPE).coalesce(1).write.parquet(f"{path}/_more")
    (part,) = [f for f in os.listdir(f"{path}/_more") if f.endswith(".parquet")]
    os.replace(f"{path}/_more/{part}", f"{path}/9.parquet")
    assert rows(L.running_bursts(stream(spark, path), 60, 3, **places).select("seq")) == [(0,), (1,), (2,)]
    assert rows(L.running_escalations(stream(spark, path), 2, **kept)) == [("a",)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), max_size=25), st.integers(0, 12), st.integers(1, 5))
def test_burst_rows(seen, width, threshold):
    seen = sorted(seen)
    want = [any(sum(s == u and a <= x <= a + width for u, x in seen) >= threshold for v, a in seen if v == s and a <= t <= a + width)
            for s, t in seen]
    source, at = np.array([s for s, _ in seen], "U1"), np.array([t for _, t in seen], np.int64)
    assert burst_rows(at, width, threshold, source).tolist() == want


SEEN = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 9), st.integers(0, 9), st.integers(-1, 7)), max_size=14,
                unique_by=lambda r: r[:3])


@settings(max_examples=300, deadline=None)
@given(SEEN, st.integers(0, 10))
def test_summaries_in_one_piece_and_in_two(seen, cut):
    want = []
    for source in {r[0] for r in seen}:
        in_time = sorted(r[1:] for r in seen if r[0] == source)
        steps = [b[2] - a[2] for a, b in zip(in_time, in_time[1:])]
        want.append((source, *in_time[0], *in_time[-1], max(steps, default=NO_STEP)))

    def frame(rows):
        return pd.DataFrame(rows, columns=["source", "ts_us", "seq", "rank"]).astype({"source": object, "ts_us": "int64", "seq": "int64", "rank": "int64"})

    def plain(found):
        return sorted(((None if pd.isna(r[0]) else r[0], *map(int, r[1:])) for r in found.itertuples(index=False)), key=repr)
    assert plain(summaries(frame(seen))) == sorted(want, key=repr)
    early, late = [r for r in seen if r[1] < cut], [r for r in seen if r[1] >= cut]
    assert plain(summaries(frame(late), summaries(frame(early)))) == sorted(want, key=repr)


def test_segments_of_small_batches():
    """Runs that go on from one Arrow batch to the next are one segment."""
    source, rank = [None, None, "a", "a", "a", "b", "a", "a"], [1, 4, 2, 2, 5, 0, 3, 1]

    class Here:
        @staticmethod
        def get():
            return Here
        partitionId = staticmethod(lambda: 7)
    real, D.TaskContext = D.TaskContext, Here
    try:
        for size in (1, 2, 3, 8):
            table = pa.table({"source": pa.array(source, pa.string()), "rank": pa.array(rank, pa.int32())})
            got = [tuple(r.values()) for b in D._segments(iter(table.to_batches(size))) for r in b.to_pylist()]
            assert got == [(None, 7, 1, 4, 3), ("a", 7, 2, 5, 3), ("b", 7, 0, 0, None), ("a", 7, 3, 1, -2)]
    finally:
        D.TaskContext = real


def test_few_parts_after_many_batches():
    parts, written = [], 0
    for number in range(1000):
        parts, merges, dropped = plan_merges([*parts, [f"b{number}", 0]], 8, number)
        assert len(parts) <= 7 * 4 and len({n for n, _ in parts}) == len(parts)
        assert not {n for n, _ in parts} & set(dropped)
        written += len(merges)
    assert written < 1000 / 7 + 4


def _store(spark, fan=3):
    return GroupStore(spark, scratch_path(spark, "store"), ["k"], fan)


def _write(store, spark, number):
    batch = spark.createDataFrame([(number % 4, number), (None, number), (100 + number, number)], "k long, v long")
    store.write(batch, number)
    return batch.schema


def _want(batches):
    out = {}
    for n in batches:
        out.update({n % 4: n, None: n, 100 + n: n})
    return sorted(out.items(), key=repr)


def test_store_keeps_the_last_row_of_a_group(spark):
    store = _store(spark)
    for n in range(14):
        schema = _write(store, spark, n)
        assert rows(store.current(schema)) == _want(range(n + 1))
    assert len(store._names("parts")) <= 12 and len(store._names("manifests")) <= 5


@pytest.mark.parametrize("at", ["_publish", "_tidy"])
def test_store_survives_a_failure_inside_a_merge(spark, monkeypatch, at):
    """The batch that merges fails before its manifest is there, or after it; then it is repeated."""
    store = _store(spark)
    for n in range(8):
        schema = _write(store, spark, n)
    whole, broke = getattr(store, at), []

    def fail(*args):
        broke.append(args)
        raise OSError("lost")
    monkeypatch.setattr(store, at, fail)
    with pytest.raises(OSError):
        _write(store, spark, 8)
    assert broke
    assert rows(GroupStore(spark, store.path, ["k"], 3).current(schema)) == _want(range(9 if at == "_tidy" else 8))
    monkeypatch.setattr(store, at, whole)
    for n in range(8, 13):
        _write(store, spark, n)
    assert rows(store.current(schema)) == _want(range(13))
    assert store._read([n for n, _ in store._manifest()["parts"]], schema).groupBy("k", BATCH).count().where("count > 1").count() == 0


def test_a_reader_keeps_its_snapshot_over_a_merge(spark):
    store = _store(spark)
    for n in range(4):
        schema = _write(store, spark, n)
    before = store.current(schema)
    for n in range(4, 6):   # merges what the reader names
        _write(store, spark, n)
    assert rows(before) == _want(range(4))


def test_an_empty_store(spark):
    schema = spark.createDataFrame([], "k long, v long").schema
    assert rows(_store(spark).current(schema)) == []


def _content(found):
    return {name: rows(df.select("start_us", *sorted(c for c in df.columns if c != "start_us"))) for name, df in found.items()}


def test_reviews_of_closed_periods_and_after_a_restart(spark, tmp_path, monkeypatch):
    hour = 3_600_000_000
    schema = I.t_log(spark, "/root/testdata/sf0.001").schema
    log = [r.asDict() for r in I.t_log(spark, "/root/testdata/sf0.001").orderBy("seq").limit(60).collect()]
    for i, r in enumerate(log):
        r["ts_us"] = i * hour // 12 + (hour // 3 if i % 5 == 0 else 0)   # five hours, some rows early
    path = str(tmp_path / "t")
    os.makedirs(path)

    def add(number, piece):
        spark.createDataFrame([tuple(r[f.name] for f in schema) for r in piece], schema).coalesce(1).write.parquet(f"{path}/_{number}")
        (part,) = [f for f in os.listdir(f"{path}/_{number}") if f.endswith(".parquet")]
        os.replace(f"{path}/_{number}/{part}", f"{path}/{number}.parquet")

    def source():
        return read_stream(spark, f"{path}/*.parquet", schema, max_files=1)
    places = dict(landed=scratch_path(spark, "landed"), path=scratch_path(spark, "reviews"), checkpoint=scratch_path(spark, "checkpoint"))
    add(0, log[:30])
    first = _content(L.review_stream(source(), "1 hour", "30 minutes", **places))
    assert {r[0] for r in first["patterns"]} == {0}
    # the stream fails inside the reviews of the next batch, after one table was written
    add(1, log[30:])
    real, broke = L.review_content, []

    def fails(*args):
        found = real(*args)
        if args[1] == hour and not broke:
            broke.append(1)
            found["sample"].write.mode("overwrite").parquet(f"{places['path']}/patterns/start_us={args[1]}")
            raise OSError("lost")
        return found
    monkeypatch.setattr(L, "review_content", fails)
    with pytest.raises(Exception):
        L.review_stream(source(), "1 hour", "30 minutes", **places)
    assert broke
    second = _content(L.review_stream(source(), "1 hour", "30 minutes", **places))
    table = spark.read.schema(schema).parquet(f"{path}/*.parquet")
    latest = max(r["ts_us"] for r in log)
    over = [s * hour for s in range(6) if (s + 1) * hour <= latest - hour // 2]
    assert {r[0] for r in second["patterns"]} == set(over) and len(over) >= 3
    for start in over:
        for name, df in real(table, start, start + hour).items():
            want = rows(df.withColumn("start_us", F.lit(start).cast("long")).select("start_us", *sorted(df.columns)))
            assert [r for r in second[name] if r[0] == start] == want
    assert all(r in second["critical"] for r in first["critical"])


def test_no_period_is_over(spark, tmp_path):
    path = files(spark, str(tmp_path / "t"), [[("0", 0, 0, "a", "ERROR")]])
    log = I.t_log(spark, "/root/testdata/sf0.001").limit(1)
    log.withColumn("ts_us", F.lit(5).cast("long")).coalesce(1).write.parquet(f"{path}/log")
    found = L.review_stream(read_stream(spark, f"{path}/log", log.schema), "1 hour")
    assert {name: df.count() for name, df in found.items()} == {"patterns": 0, "sample": 0, "critical": 0}


def test_ranks_in_groups_of_any_size(spark):
    """One group has most rows, one is null; rows of a group lie in many ranges, and no range has them all."""
    df = spark.range(3000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 4 > 0, "hot").otherwise(
        F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 3001).alias("v"), F.lit("x").alias("rank"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # so few rows would be put together again
    try:
        got = ranked_in_group(df, ["g"], [F.col("v").desc()])
        assert got.where("g = 'hot'").select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    seen = {}
    for r in got.orderBy("g", F.col("v").desc()).collect():
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["rank"] == seen[r["g"]]
    assert sum(seen.values()) == 3000 and seen["hot"] > 2000
    assert ranked_in_group(df.limit(0), ["g"], [F.col("v")]).count() == 0
