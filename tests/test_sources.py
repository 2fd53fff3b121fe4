"""Files, saving and loading."""
import pytest
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.sources.files import read_lines
from logloom.sources.journald import collect_linux
from logloom.sources.syslog import dedup_raw, ingest_syslog_files, parse_syslog, union_sources
from logloom.sources.windows import ingest_windows_events
from logloom.registry import inputs as I
from logloom.sources.tables import load_jsonl, load_variant, save_records, save_variants, write_split


@pytest.fixture
def small_splits(spark):
    """Many pieces per file."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "500")
    spark.conf.set(keys[1], "10")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_in_file_order(spark, tmp_path, small_splits):
    b = [f"b line {i} " + "x" * (i % 37) for i in range(400)]
    a = [f"a {i}" for i in range(150)] + [""] + ["last"]
    for name, lines in (("b.log", b), ("a.log", a)):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    paths = [str(tmp_path / "b.log"), str(tmp_path / "missing.log"), str(tmp_path / "a.log")]
    df = read_lines(spark, paths)
    assert spark.read.text(paths[0]).rdd.getNumPartitions() > 3
    rows = df.orderBy("seq").collect()
    assert [r.value for r in rows] == b + a
    assert [r.seq for r in rows] == list(range(len(b) + len(a)))
    assert [r.line_no for r in rows] == list(range(len(b))) + list(range(len(a)))
    capped = read_lines(spark, paths, max_lines=123).orderBy("seq").collect()
    assert [r.value for r in capped] == b[:123] + a[:123]


def test_no_file_at_all(spark, tmp_path):
    assert read_lines(spark, [str(tmp_path / "none")]).count() == 0


def test_bad_bytes_and_names(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "auth.log").write_bytes(b"Jan 10 12:00:00 h p: \xff caf\xc3\xa9\n\n")
    r, = ingest_syslog_files(spark, [str(folder / "auth.log")], year=2024).collect()
    assert (r.message, r.os_source) == ("� café", "auth")


def lines(spark, values, path="/x/a.log"):
    return parse_syslog(spark.createDataFrame([(v, path, i) for i, v in enumerate(values)],
                                              "value string, path string, seq long"), 2024)


def test_dedup_keeps_the_first(spark):
    got = dedup_raw(lines(spark, ["p", "q", "p", "r", "q"])).orderBy("seq").collect()
    assert [(r.raw, r.seq) for r in got] == [("p", 0), ("q", 1), ("r", 3)]


def test_dedup_of_one_hot_line(spark):
    hot = ["same"] * 3000 + [f"l{i}" for i in range(300)]
    got = dedup_raw(lines(spark, hot[::-1]).repartition(7)).collect()
    assert len(got) == 301 and min(r.seq for r in got if r.raw == "same") == 300


def test_union_prefers_the_first_collection(spark):
    got = union_sources(lines(spark, ["p", "q"], "/x/a.log"), lines(spark, ["q", "r"], "/x/b.log")).orderBy("seq").collect()
    assert [(r.raw, r.os_source) for r in got] == [("p", "a"), ("q", "a"), ("r", "b")]


def test_json_round_trip_keeps_nulls(spark, tmp_path):
    records = lines(spark, ["Jan 10 12:00:00 h p[3]: m", "odd line", 'quote " \\ é'])
    path = str(tmp_path / "out")
    save_records(records, path, with_text=True)
    assert load_jsonl(spark, path).exceptAll(records).count() == 0
    assert '"pid":null' in "".join(r.value for r in spark.read.text(path).collect())
    plain = str(tmp_path / "plain")
    save_records(records, plain, with_text=False)
    assert load_jsonl(spark, plain).where("text IS NOT NULL").count() == 0


def test_bad_line_fails_the_load(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"1"}\n\n{"id":\n')
    with pytest.raises(Exception):
        load_jsonl(spark, str(tmp_path / "x.jsonl")).collect()
    assert load_jsonl(spark, str(tmp_path / "x.jsonl"), mode="DROPMALFORMED").count() == 1


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_variants(spark, tmp_path, form):
    records = lines(spark, ["a", "b", "c"])
    vectors = records.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.25)))
    path = str(tmp_path / "v")
    written = save_variants({"original": vectors, "vectorized": vectors, "sample": vectors.limit(0)}, path, form)
    assert written == ["original", "vectorized"]
    assert "embedding" not in load_variant(spark, path, "original", form).columns
    back = load_variant(spark, f"{path}/vectorized", form=form)
    assert back.select(S.VECTORIZED.fieldNames()).exceptAll(vectors.select(S.VECTORIZED.fieldNames())).count() == 0


def test_split_write_leaves_unknown_out(spark, tmp_path):
    records = lines(spark, ["Jan 10 12:00:00 h p: error", "odd line"])
    write_split(records, str(tmp_path / "s"), "level")
    assert [r.split for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["error"]


def test_collect_linux(spark, tmp_path):
    (tmp_path / "auth.log").write_text("Jan 10 12:00:00 h p: m\nJan 10 12:00:00 h p: m\n")
    (tmp_path / "j.json").write_text('{"MESSAGE":"a","PRIORITY":"2"}\n{"MESSAGE":"a","PRIORITY":"2"}\nbroken\n')
    got = collect_linux(spark, [str(tmp_path / "auth.log")], [str(tmp_path / "j.json")], year=2024)
    assert [(r.os_source, r.level, r.message) for r in got.orderBy("seq").collect()] == [
        ("auth", "INFO", "m"), ("journald", "CRITICAL", "a")]


def test_nothing_is_cut_by_default(spark, tmp_path):
    lines = [f"Jan  2 03:04:{i % 60:02} host app[{i}]: message {i}" for i in range(12_000)]
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n")
    assert ingest_syslog_files(spark, [str(tmp_path / "app.log")], year=2024).count() == 12_000
    assert collect_linux(spark, [str(tmp_path / "app.log")], [], year=2024).count() == 12_000
    events = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, "Setup").otherwise("System").alias("channel"),
        F.timestamp_seconds("id").alias("time_generated"), F.lit(1).alias("event_type"), F.col("id").alias("event_id"),
        F.lit("s").alias("source_name"), F.lit("c").alias("computer_name"), F.array(F.lit("x")).alias("string_inserts"),
        F.lit("m").alias("message"), F.col("id").alias("seq"))
    got = ingest_windows_events(events).groupBy("os_source").count().collect()
    assert {r["os_source"]: r["count"] for r in got} == {"Setup": 3_000, "System": 6_000}
    capped = ingest_windows_events(events, max_events=2_500).groupBy("os_source").agg(
        F.count("*").alias("n"), F.min("seq").alias("first")).collect()
    assert {(r["os_source"], r["n"], r["first"]) for r in capped} == {("Setup", 2_500, 1_500), ("System", 2_500, 5_251)}


def test_a_split_of_large_files_is_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    from logloom.sources import tables
    rows = spark.range(0, 800, 1, 8).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "ERROR").otherwise("INFO").alias("level"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    pieces = rows.rdd.getNumPartitions()
    for least, files in ((50 if pieces == 8 else 1, pieces), (1000, 1)):   # files of 50 rows are large, or small
        monkeypatch.setattr(tables, "FILE_ROWS", least)
        path = tmp_path / f"s{least}"
        write_split(rows, str(path), "level")
        assert [len(list((path / f"split={v}").glob("*.parquet"))) for v in ("error", "info")] == [files, files]
        assert spark.read.parquet(str(path)).where("split = lower(level)").select("id").distinct().count() == 800


def test_a_rebuild_takes_its_sample_from_the_saved_pattern(spark, tmp_path):
    from logloom.plans.rebuild import rebuild
    path = str(tmp_path / "all")
    found = rebuild(I.t_log(spark, "/root/testdata/sf0.001"), path, clusters="group")
    names = ["seq", "rank", "message", "cluster_id", "pattern_label", "is_burst", "is_escalation_source", "is_repeat_offender"]
    saved = spark.read.parquet(f"{path}/sample")
    assert "embedding" not in saved.columns and set(saved.columns) == set(found.sample.columns)
    assert sorted(saved.select(*names).collect()) == sorted(found.sample.select(*names).collect()) != []
    for name in ("jsonl", "jsonl_text"):
        files = list((tmp_path / "all" / name).glob("part-*"))
        assert files and all(f.name.endswith(".json.gz") for f in files)
        assert load_jsonl(spark, f"{path}/{name}").count() == 1000
