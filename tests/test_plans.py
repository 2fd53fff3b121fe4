"""What the physical plans must and must not contain."""
import pytest

import __spark_entry__ as entry_point
from logloom.operators import detect as D
from logloom.registry import inputs as I

SF = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream", "save", "load"))])
def test_no_products_and_no_row_udfs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert banned not in text, banned


@pytest.mark.parametrize("name", ["dedup_raw", "newest_per_channel", "first_lines_per_file", "sample_per_cluster",
                                  "cluster_keywords"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name, columns", [
    ("summary_by_level", "event_id:bigint,event_type:string"),
    ("repeat_offenders", "ts:timestamp_ntz,user_id:bigint,event_type:string"),
    ("detect_escalations", "event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string")])
def test_scans_read_only_what_is_used(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(QUERIES[name](spark, SF))


def test_a_level_filter_reaches_the_scan(spark):
    table = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(D.repeat_offenders(table.withColumnsRenamed({"event_type": "level", "user_id": "source"})))
    assert "PushedFilters: [In(event_type" in text


def test_the_costly_parse_is_done_once(spark):
    assert plan(QUERIES["ingest_journald_json"](spark, SF)).count("parseJson(") == 1
    assert plan(QUERIES["parse_syslog_iso"](spark, SF)).count("?<proc>") == 1
    text = plan(QUERIES["hash_embedding"](spark, SF))
    assert text.count("md5(") == 1


@pytest.mark.parametrize("name", ["condense_exact", "condense_template", "consultation_report", "stream_condense"])
def test_condensation_aggregates_numbers_only(spark, name):
    """Whole records are never sorted for an aggregate, in staged parts neither."""
    from logloom.operators import condense
    text = plan(QUERIES[name](spark, SF)) + plan(condense.group_numbers(
        I.t_log(spark, SF), ["source", "level", "message"]))
    assert "HashAggregate" in text and "SortAggregate" not in text.split("max_by")[0]


def test_hot_keys_combine_before_the_shuffle(spark):
    for name in ("condense_exact", "cluster_modes", "summary_by_level", "repeat_offenders"):
        assert "partial_count" in plan(QUERIES[name](spark, SF)), name
    assert "rangepartitioning" in plan(D.escalation_sources(I.t_log(spark, SF)))


def test_only_measured_tables_are_broadcast(spark, monkeypatch):
    """With the automatic choice off, hints alone decide."""
    from logloom import session
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(QUERIES["detect_bursts"](spark, SF))
        for name, limit in (("BROADCAST_ROWS", 3), ("BROADCAST_BYTES", 10)):
            with monkeypatch.context() as m:
                m.setattr(session, name, limit)
                df = QUERIES["detect_bursts"](spark, SF)
                assert "BroadcastHashJoin" not in plan(df)
                assert df.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_whole_report_moves_lines_and_not_records(spark, monkeypatch):
    """Ranks stage a line and what orders it; templates are counted once."""
    from logloom.operators import order
    from logloom.plans import reports
    staged, masked = [], []

    def spy(df, name="stage"):
        staged.append(df.columns)
        return real(df, name)

    def counted(records, *a, **k):
        masked.append(records.columns)
        return condense(records, *a, **k)

    real, condense = order.stage, reports.condense_template
    monkeypatch.setattr(order, "stage", spy)
    monkeypatch.setattr(reports, "condense_template", counted)
    monkeypatch.setattr("logloom.operators.summary.condense_template", counted)
    QUERIES["consultation_report_whole"](spark, SF)
    ranges = [c for c in staged if "__at" in c]
    assert len(ranges) == 2 and all(set(c) == {"dataset", "count", "seq", "line", "__at"} for c in ranges)
    assert len(masked) == 2 and all("raw" not in c and "text" not in c for c in masked)
