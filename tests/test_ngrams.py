"""Terms found by bytes and counted as numbers equal those of the regular expression."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.functions.templates import ngram_terms
from logloom.operators import heavy as H
from logloom.operators import ngrams as N
from logloom.operators import vectorize as VZ

ODD = ["", " ", "a", "ab", "a b cd", "x\x00yz_9 -ab-", "École à l'œuvre, ß ÀÉ é", "µµ ªº ² ×× ÷÷ ¼¼ naïve", "Привет мир x", "ἀρχή ab",
       "漢字 kana かな ab", "éa ́b c‍d", "İstanbul IIı ΑΣ", "Ⅷ ⅷⅷ ⓐⓑ", "ɏɏ ɐɐ ʼn", "tab\tnew\nline\rend", "a1 1a 11 1", "😀 ab😀cd", "ǅ ǆ ĲĲ"]


def cut(spark, values, text="text"):
    """Terms of every text: as the column function says, and as the steps find them."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc long, text string")
    want = {r.doc: r.t for r in df.select("doc", ngram_terms("text").alias("t")).collect()}
    got = defaultdict(list)
    table = N.spelled(F.lit(""), F.col("doc"), F.col("text"), df).toArrow()
    for batch in table.to_batches():
        for step in N.steps(batch.column("text"), batch.column("wide")):
            names = N.plain(step.names)
            for place, row in enumerate(step.rows):
                words = [names[c] for c in step.code[step.ends[place]:step.ends[place + 1]]]
                got[batch.column("doc")[int(row)].as_py()] = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return want, got


def test_words_of_every_latin_character(spark):
    """Beside letters, beside blanks, and doubled; and beyond the last one cut by bytes."""
    values = [v for c in map(chr, range(1, N.LATIN + 300)) for v in (f"ab{c}cd", f" {c} {c}{c} x{c}")]
    want, got = cut(spark, values)
    assert {values[i]: t for i, t in got.items()} == {values[i]: t for i, t in want.items()} and len(got) == len(values)


@pytest.mark.parametrize("most", [1, 6, 1 << 18])
def test_words_of_odd_texts(spark, monkeypatch, most):
    monkeypatch.setattr(N, "WORDS_PER_STEP", most)
    want, got = cut(spark, [*ODD, *(" ".join(ODD[i:]) for i in range(len(ODD))), None, *ODD])
    assert dict(got) == want


def sentences(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["мир", "é"]
    weights = [1 / (i + 1) for i in range(27)]
    return [(rng.choice(["a", "a", "b", None]), None if i % 40 == 0 else " ".join(rng.choices(words, weights, k=rng.randint(0, 9)))) for i in range(n)]


def plain_top(rows, most):
    total, df = defaultdict(Counter), defaultdict(Counter)
    for split, text in rows:
        words = re.findall(r"\b\w\w+\b", (text or "").lower())
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        total[split].update(terms)
        df[split].update(set(terms))
    return sorted(((split, t, n, df[split][t], k + 1) for split, counts in total.items()
                   for k, (t, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])), key=repr)


@pytest.mark.parametrize("counters, sure", [(2, 1 << 20), (8, 5), (40, 20), (1000, 1 << 20)])
def test_top_terms_of_texts(spark, monkeypatch, counters, sure):
    monkeypatch.setattr(N, "SURE", sure)
    rows = sentences()
    df = spark.createDataFrame(rows, "split string, text string").repartition(3)
    texts = N.spelled(F.col("split"), F.lit(0), F.col("text"), df).select("split", "text", "wide")

    def top():
        return sorted((tuple(r) for r in H.top_terms(texts, 12, counters, N.summaries, N.recount).collect()), key=repr)

    assert top() == plain_top(rows, 12)
    monkeypatch.setattr(H, "_too_large", lambda size: True)   # candidates are not sent
    assert top() == plain_top(rows, 12)


def batch(rows):
    return pa.RecordBatch.from_pydict({"split": pa.array([s for s, _ in rows], pa.string()), "text": pa.array([(t or "").lower() for _, t in rows]),
                                       "wide": pa.array([False] * len(rows))})


@pytest.mark.parametrize("held, numbered", [(1 << 21, 1 << 19), (3, 1 << 19), (1 << 21, 3)])
def test_counters_are_handed_on_when_many_are_held(monkeypatch, held, numbered):
    rows = [(s, t) for s, t in sentences() if "м" not in (t or "")]
    monkeypatch.setattr(N, "HELD", held)
    monkeypatch.setattr(N, "NUMBERED", numbered)
    monkeypatch.setattr(N, "WORDS_PER_STEP", 50)
    sums = defaultdict(lambda: [0, 0])
    for r in (r for b in N.summaries(None)(iter([batch(rows[:100]), batch(rows[100:])])) for r in b.to_pylist() if r["term"] is not None):
        sums[r["split"], r["term"]][0] += r["total"]
        sums[r["split"], r["term"]][1] += r["df"]
    assert {k: tuple(v) for k, v in sums.items()} == {(s, t): (n, df) for s, t, n, df, _ in plain_top(rows, 10**6)}


def test_counts_of_keys_too_wide_to_pack():
    row, code = np.zeros(9, np.int64), np.array([0, 1, 0, 1, 0, 2, 0, 1, 0])
    for distinct in (3, 1 << 30):
        found = list(zip(*(a.tolist() for a in N.term_counts(row, code, distinct))))
        assert found == [(0, -1, 5, 1), (0, 1, 3, 1), (0, 2, 1, 1), (1, -1, 3, 1), (1, 0, 3, 1), (2, -1, 1, 1), (2, 0, 1, 1)]


def test_texts_go_to_the_tasks_and_not_their_terms(spark):
    """Pairs of words are made in the task, from numbers; no array of terms is sent."""
    df = spark.createDataFrame([(i, f"user {i} logs in from host {i % 7}") for i in range(50)], "seq long, text string")
    plan = VZ.tfidf(df, text=F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "transform(" not in plan


def test_a_sampled_beginning_saves_a_pass(spark, monkeypatch):
    """Texts of overlapping topics: the bound is met on all rows in two passes; a random beginning takes more."""
    rng = np.random.default_rng(5)
    topics = rng.dirichlet(np.full(300, 0.05), 60)
    data = []
    for i in range(3000):
        mix = 0.5 * topics[rng.integers(60)] + 0.5 * topics[0]
        slots = np.unique(rng.choice(300, 25, p=mix))
        data.append(("", i, slots.tolist(), np.full(len(slots), 1 / np.sqrt(len(slots))).tolist()))
    rows = spark.createDataFrame(data, "split string, seq long, slots array<int>, weights array<double>").repartition(4).cache()
    passes, real = [], VZ.gram_times
    monkeypatch.setattr(VZ, "gram_times", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(VZ, "SPARE", 16)
    x = np.zeros((3000, 300))
    for _, i, slots, weights in data:
        x[i, slots] = weights
    gram = x.T @ x
    for seeded, most in ((2048, 2), (1, 12)):
        monkeypatch.setattr(VZ, "SEEDED", seeded)
        passes.clear()
        (v,) = VZ.svd_bases(rows, {"": (300, 30)}).values()
        values = np.einsum("ij,ij->j", v, gram @ v)
        assert np.linalg.norm(gram @ v - v * values, axis=0).max() <= VZ.TOLERANCE * np.linalg.eigvalsh(gram)[-1]
        assert len(passes) <= most
