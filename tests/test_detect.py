"""Detectors against plain restatements of their rules, on awkward input."""
import random

import pytest
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.operators import detect as D
from logloom.operators import order
from logloom.operators.cluster import auto_k, auto_k_column, cluster_keywords, cluster_modes, group_clusters
from logloom.operators.condense import condense_exact, condense_template
from logloom.plans.patterns import detect_patterns
from logloom.streaming.cadence import rebuild_decisions

LEVELS = ["DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "EMERGENCY", "ALERT", "AUDIT_FAILURE", "UNKNOWN"]


def make(seed, n, span, hot=0.4):
    """(seq, source, ts seconds or None, level) with ties, nulls, no order, one hot source."""
    r = random.Random(seed)
    return [(i, "hot" if r.random() < hot else r.choice(["a", "b", "c", None]),
             None if r.random() < 0.05 else r.randrange(span), r.choice(LEVELS)) for i in range(n)]


def frame(spark, rows, unit=1_000_000):
    return spark.createDataFrame(
        [(i, str(i), s, None if t is None else t * unit, lv, f"m {i % 3}", "os") for i, s, t, lv in rows],
        "seq long, id string, source string, ts_us long, level string, message string, os_source string")


def by_source(rows):
    out = {}
    for i, s, t, lv in rows:
        if t is not None:
            out.setdefault(s, []).append((t, i, lv))
    return {s: sorted(v) for s, v in out.items()}


def bursts(rows, window, threshold):
    found = set()
    for events in by_source(rows).values():
        for t0, _, _ in events:
            inside = [i for t, i, _ in events if t0 <= t <= t0 + window]
            if len(inside) >= threshold:
                found.update(inside)
    return found


@pytest.mark.parametrize("seed, n, span, window, threshold, chunk", [
    (1, 400, 2000, 10, 3, 10**6), (2, 400, 2000, 10, 3, 20), (3, 300, 300, 0, 3, 1), (4, 300, 5000, 60, 4, 61),
    (5, 200, 50, 5, 30, 5), (6, 200, 1000, 7, 1, 9), (7, 500, 100000, 600, 5, 50), (8, 300, 40, 60, 2, 33)])
def test_bursts(spark, seed, n, span, window, threshold, chunk):
    rows = make(seed, n, span)
    got = D.detect_bursts(frame(spark, rows), window, threshold, chunk).where("is_burst").collect()
    assert {r.seq for r in got} == bursts(rows, window, threshold) and len(got) == len({r.seq for r in got})


def test_one_source_within_one_second_is_cut_evenly(spark):
    rows = [(i, "hot", i * 97 % 1_000_000, "INFO") for i in range(3000)]
    table = frame(spark, rows, unit=1)
    got = D.detect_bursts(table, 0.000_5, 3, 250)
    assert {r.seq for r in got.where("is_burst").collect()} == bursts(rows, 500, 3)
    placed = order.in_order(D.tick_counts(table), [F.col("source"), F.col("ts_us")], "place", 250)
    sizes = [r["count"] for r in placed.groupBy(F.floor(F.col("place") / 250)).count().collect()]
    assert len(sizes) == 12 and set(sizes) == {250}
    assert sorted(r["place"] for r in placed.collect()) == list(range(3000))


def test_burst_edges(spark):
    three = [(i, "s", 5, "INFO") for i in range(3)]
    assert D.detect_bursts(frame(spark, three), 0, 3).where("is_burst").count() == 3
    apart = [(0, "s", 0, "INFO"), (1, "s", 60, "INFO"), (2, "t", 0, "INFO"), (3, "t", 61, "INFO")]
    assert [r.seq for r in D.detect_bursts(frame(spark, apart), 60, 2).where("is_burst").orderBy("seq").collect()] == [0, 1]
    before_epoch = [(i, "s", -3 + i, "INFO") for i in range(6)]
    assert D.detect_bursts(frame(spark, before_epoch), 2, 3, 2).where("is_burst").count() == 6


def escalating(rows, step):
    out = set()
    for s, events in by_source(rows).items():
        ranks = [S.SEVERITY_RANK.get(lv, -1) for _, _, lv in events]
        if any(b - a >= step for a, b in zip(ranks, ranks[1:])):
            out.add(s)
    return out


@pytest.mark.parametrize("seed, n, step", [(1, 12, 2), (2, 25, 4), (3, 60, 6), (4, 300, 7), (5, 40, 5)])
@pytest.mark.parametrize("parts", ["1", "8"])
def test_escalations(spark, seed, n, step, parts):
    rows = make(seed, n, 50)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.source for r in D.escalation_sources(frame(spark, rows).repartition(5), step).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == escalating(rows, step)


@pytest.mark.parametrize("levels, yes", [(["UNKNOWN", "INFO"], True), (["AUDIT_FAILURE", "INFO"], True),
                                         (["DEBUG", "INFO", "NOTICE", "WARNING", "ERROR"], False),
                                         (["INFO", "WARNING"], True), (["ERROR", "INFO"], False)])
def test_escalation_rule(spark, levels, yes):
    rows = [(i, "s", i, lv) for i, lv in enumerate(levels)]
    assert (D.escalation_sources(frame(spark, rows)).count() == 1) is yes


def test_one_hot_source_is_cut_into_ranges(spark):
    """A steep step at every possible cut of a source that fills all ranges."""
    for at in (1, 250, 499, 500, 501, 750, 999):
        rows = [(i, "hot", i, "DEBUG" if i < at else "NOTICE") for i in range(1000)]
        assert [r.source for r in D.escalation_sources(frame(spark, rows)).collect()] == ["hot"]


def test_offenders_and_null_source(spark):
    rows = [(i, None, i, "ALERT") for i in range(2)] + [(2, None, 2, "ERROR")] + [(3, "b", 3, "ERROR")] * 2
    got = D.repeat_offenders(frame(spark, rows)).collect()
    assert [(r.source, r.critical_count, r["count"]) for r in got] == [(None, 3, 1)]


def test_flags_join_null_sources(spark):
    rows = [(i, None, i, "ERROR") for i in range(4)] + [(9, "x", 0, "INFO")]
    p = detect_patterns(frame(spark, rows).withColumn("dataset", F.lit("d")).withColumn("timestamp", F.lit("t")), "group")
    got = {r.seq: (r.is_burst, r.is_repeat_offender, r.is_escalation_source) for r in p.pattern.collect()}
    assert got == {**{i: (True, True, False) for i in range(4)}, 9: (False, False, False)}
    assert {r.id for r in p.summary.collect()} == {"cluster_0", "cluster_1", "burst_0", "repeat_None"}
    assert [(r.cluster_id, r.seq) for r in p.sample.orderBy("cluster_id", "rank").collect()] == [(0, 0), (0, 1), (1, 9)]


def test_modes_and_keywords_keep_first_seen(spark):
    rows = [(0, 7, "B", "y", "o", "beta alpha"), (1, 7, "A", "x", "o", "alpha beta gamma"),
            (2, 7, "A", "y", None, "delta"), (3, 7, "B", "x", None, "gamma gamma"), (4, 8, None, None, "", "")]
    df = spark.createDataFrame(rows, "seq long, cluster_id long, level string, source string, os_source string, message string")
    m = {r.cluster_id: r for r in cluster_modes(df.repartition(4)).collect()}
    assert (m[7].level, m[7].source, m[7].os_source, m[7]["count"], m[7].first_seq) == ("B", "y", "o", 4, 0)
    assert (m[8].level, m[8].source, m[8].os_source) == (None, None, "")
    words = cluster_keywords(df.repartition(4)).orderBy("rank").collect()
    assert [(r.token, r.n) for r in words] == [("gamma", 3), ("beta", 2), ("alpha", 2)]


def test_group_ids_in_first_seen_order(spark, monkeypatch):
    rows = make(11, 500, 50)
    want, seen = {}, []
    for i, s, _, lv in rows:
        if (lv, s) not in seen:
            seen.append((lv, s))
        want[i] = seen.index((lv, s))
    df = frame(spark, rows).repartition(6)
    assert {r.seq: r.cluster_id for r in group_clusters(df).collect()} == want
    monkeypatch.setattr(order, "ROWS_PER_TASK", 7)   # many ranges
    assert {r.seq: r.cluster_id for r in group_clusters(df).collect()} == want


def test_condense(spark):
    rows = [(0, "a", "I", "x 1"), (1, "a", "I", "x 2"), (2, "a", "I", "x 1"), (3, "b", "I", "x 1"), (4, None, "I", "x 9")]
    df = spark.createDataFrame(rows, "seq long, source string, level string, message string").repartition(3)
    exact = {(r.source, r.message): (r.seq, r["count"]) for r in condense_exact(df).collect()}
    assert exact == {("a", "x 1"): (0, 2), ("a", "x 2"): (1, 1), ("b", "x 1"): (3, 1), (None, "x 9"): (4, 1)}
    masked = {r.source: (r.message, r.seq, r["count"], r.condensed) for r in condense_template(df).collect()}
    assert masked == {"a": ("x <N>", 0, 3, True), "b": ("x <N>", 3, 1, True), None: ("x <N>", 4, 1, True)}


@pytest.mark.parametrize("n, k", [(1, 1), (2, 2), (7, 2), (8, 2), (18, 3), (32, 4), (199, 9), (200, 10), (10**6, 10)])
def test_auto_k(spark, n, k):
    assert auto_k(n) == k
    assert spark.createDataFrame([(n,)], "n long").select(auto_k_column(F.col("n")).alias("k")).first().k == k


def test_cadence(spark):
    r = random.Random(3)
    batches, at = [], 0
    for b in range(300):
        at += r.randrange(1, 200) * 1_000_000
        batches.append((b, r.choice([0, 1, 5, 40]), 1 if r.random() < 0.1 else 0, at))
    want, new, last = [], 0, batches[0][3]
    for b, n, c, t in batches:
        new += n
        reason = ("critical event" if c else "count threshold" if new >= 100
                  else "time interval" if new > 0 and t - last >= 300_000_000 else None)
        want.append((b, new, reason))
        if reason:
            new, last = 0, t
    df = spark.createDataFrame(batches, "batch long, rows long, critical long, at_us long").repartition(4)
    assert [(r.batch, r.new_rows, r.reason) for r in rebuild_decisions(df).orderBy("batch").collect()] == want
    assert {w[2] for w in want} == {None, "critical event", "count threshold", "time interval"}
