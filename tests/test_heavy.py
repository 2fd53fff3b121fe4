"""Most frequent terms from bounded summaries equal a full count."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import heavy as H


def texts(seed=1, n=400):
    """Skewed terms in four splits, one of them null; some texts empty or null."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = []
    for i in range(n):
        split = rng.choice(["a", "a", "b", None, "few"])
        if split == "few":
            terms = rng.choices(words[:3], k=rng.randint(0, 2))
        else:
            terms = None if i % 50 == 0 else rng.choices(words, weights, k=rng.randint(0, 12))
        rows.append((split, terms))
    return rows


def plain_top(rows, most):
    total, df = defaultdict(Counter), defaultdict(Counter)
    for split, terms in rows:
        total[split].update(terms or [])
        df[split].update(set(terms or []))
    out = []
    for split, counts in total.items():
        first = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]
        out += [(split, t, n, df[split][t], k + 1) for k, (t, n) in enumerate(first)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [2, 8, 20, 1000])
@pytest.mark.parametrize("most", [3, 15])
def test_any_number_of_counters(spark, monkeypatch, counters, most):
    rows = texts()
    df = spark.createDataFrame(rows, "split string, terms array<string>").repartition(5)
    want = plain_top(rows, most)
    assert sorted((tuple(r) for r in H.top_terms(df, most, counters).collect()), key=repr) == want
    monkeypatch.setattr(H, "_too_large", lambda size: True)   # candidates are not sent
    assert sorted((tuple(r) for r in H.top_terms(df, most, counters).collect()), key=repr) == want


def test_summaries_are_handed_on_when_many_are_held(spark, monkeypatch):
    monkeypatch.setattr(H, "HELD", 4)
    rows = texts(2)
    df = spark.createDataFrame(rows, "split string, terms array<string>").repartition(3)
    assert sorted((tuple(r) for r in H.top_terms(df, 6, 10).collect()), key=repr) == plain_top(rows, 6)


def test_nothing_to_count(spark):
    df = spark.createDataFrame([("a", None), ("a", [])], "split string, terms array<string>")
    assert H.top_terms(df, 5).count() == 0
    assert H.top_terms(df.limit(0), 5).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=8), max_size=12), st.integers(1, 5))
def test_counters_are_wrong_by_no_more_than_their_error(batches, counters):
    own, true = H.Summary(), Counter()
    for batch in batches:
        got = Counter(batch)
        true.update(got)
        own.add(list(got), np.array(list(got.values()), np.int64), np.array(list(got.values()), np.int64), counters)
    for t in "abcdefgh":
        assert own.total.get(t, 0) <= true[t] <= own.total.get(t, 0) + own.error
    assert own.error * (counters + 1) <= sum(true.values()) and len(own.total) <= 2 * counters


def test_no_term_of_a_text_is_shuffled(spark):
    """Between the texts and their vectors there is no exchange."""
    from logloom.operators import vectorize as VZ
    df = spark.createDataFrame([(i, f"user {i} logs in from host {i % 7}") for i in range(50)], "seq long, text string")
    plan = VZ.tfidf(df, text=F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_batches_are_counted_in_steps_of_bounded_terms(monkeypatch):
    import pyarrow as pa
    from logloom.operators import heavy
    monkeypatch.setattr(heavy, "TERMS_PER_STEP", 10)
    lists = [["a"] * 4, ["b"] * 4, None, [], ["c"] * 25, ["a", "b"], ["d"] * 10, []]
    batch = pa.RecordBatch.from_pydict({"split": pa.array(["x", "y"] * 4), "terms": pa.array(lists, pa.list_(pa.string()))})
    met = []
    real = heavy.batch_counts
    monkeypatch.setattr(heavy, "batch_counts", lambda split, terms: met.append(terms.to_pylist()) or real(split, terms))
    rows = [r for b in heavy._summaries(None)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [t for step in met for t in step] == lists
    assert all(len(step) == 1 or sum(len(t or []) for t in step) <= 10 for step in met)
    counted = {(r["split"], r["term"]): (r["total"], r["df"]) for r in rows if r["term"]}
    assert counted == {("x", "a"): (4, 1), ("y", "b"): (5, 2), ("x", "c"): (25, 1), ("y", "a"): (1, 1), ("x", "d"): (10, 1)}
