import random

import pytest
from pyspark.sql import functions as F

from logloom.llm.decontam import (CHUNK, Index, contaminated, decontaminate, edit_budget, find_passages, normalise,
                                  search_texts)

from .helpers import DOCUMENTS, documents, infix_distance

BENCH = "item_id long, text string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n))


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        p = rng.randrange(len(s))
        s[p:p + 1] = rng.choice([[], ["q"], [s[p], "z"]])
    return "".join(s)


@pytest.mark.parametrize("seed", range(4))
def test_every_passage_within_the_budget_and_no_other(seed):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randint(5, 40))) for i in range(20)]
    index = Index(items)
    texts, want = [], []
    for _ in range(25):
        i, item = rng.choice(items)
        m = len(normalise(item))
        text = sentence(rng, 20) + " " + edited(rng, item, rng.randint(0, int(0.15 * m))) + " " + sentence(rng, 9)
        texts.append(text)
        near = infix_distance(normalise(item), normalise(text))
        want.append((i, near, near <= edit_budget(m)[0]))
    for found in (search_texts(texts, index), search_texts(texts, index, chunk=2500)):
        for (i, near, inside), hits in zip(want, found):
            best = {h[0]: h for h in hits}
            assert (i in best) == inside
            if inside:
                assert best[i][3] == near


def test_spans_long_items_and_blocks(spark):
    rng = random.Random(9)
    long = sentence(rng, 300)
    bench = spark.createDataFrame([(1, long), (2, sentence(rng, 30)), (2, None), (3, "tiny"), (None, sentence(rng, 12))], BENCH)
    part = long[500:1300]
    docs = documents(spark, [(7, "before " + part + " after"), (8, sentence(rng, 200)), (7, "before " + part + " after")])
    rows = contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(7, 1)}
    text = normalise("before " + part + " after")
    for r in rows:
        if r["edits"] == 0:
            want = normalise(long)[r["passage_start"]:r["passage_start"] + r["passage_chars"]]
            assert text[r["start"]:r["end"]] == want
    from logloom.llm import decontam
    blocks = list(decontam.benchmark_blocks(bench, "item_id", "text", most=400))
    assert len(blocks) > 1 and sum(map(len, blocks)) == 4


def test_odd_rows_and_clean_documents_stay(spark):
    rng = random.Random(4)
    item = sentence(rng, 25)
    bench = spark.createDataFrame([(1, item)], BENCH)
    rows = [(1, None), (2, ""), (3, item.upper().replace(" ", "\n\t")), (4, "clean words"), (4, "clean words"),
            (None, item[:len(item) // 2]), (6, sentence(rng, 5) + item)]
    docs = documents(spark, rows).withColumn("matches", F.lit("mine"))
    kept = decontaminate(docs.drop("matches"), bench)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted(
        (str(i), str(t)) for i, t in rows if i not in (3, 6))
    assert find_passages(docs, bench).count() == len(rows)
    assert decontaminate(spark.createDataFrame([], DOCUMENTS), bench).count() == 0
    assert decontaminate(docs, spark.createDataFrame([], BENCH)).count() == len(rows)


def test_a_text_longer_than_a_scan():
    rng = random.Random(5)
    item = sentence(rng, 30)
    filler = sentence(rng, 2000)
    text = (filler + " ") * (CHUNK // len(filler) + 2)
    text = text[:CHUNK - 40] + " " + item + " " + text[:5000]
    (hits,) = search_texts([text], Index([(1, item)]))
    assert [(h[0], h[3]) for h in hits] == [(1, 0)]
