import random

import numpy as np
import pytest

from logloom.llm.toxicity import (SYMBOLS, char_model, count_trigrams, decode, keep_clean, readings, score_documents,
                                  toxicity_digest, words_of)

from .helpers import DOCUMENTS, crc, documents

LABELS = "doc_id long, quality int, toxic int"
SYLLABLES = "ba ko ri mo te lu sa ne vi do ga pe".split()
BAD = ["idiot", "moron", "stupid", "clown", "loser"]


def prose(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(700):
        w, toxic = prose(rng, rng.randint(20, 120)), i % 4 == 0
        if toxic:
            for b in rng.sample(BAD, 3):
                w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, corpus):
    return char_model(count_trigrams(documents(spark, corpus[0]))).tolist()


def test_trigrams_of_all_texts(spark):
    counts = count_trigrams(documents(spark, [(1, "ab a"), (2, None), (3, "AB")])).reshape((SYMBOLS,) * 3)
    assert counts[0, 0, 1] == 2 and counts[0, 1, 2] == 2 and counts[1, 2, 0] == 2 and counts[2, 0, 1] == 1


def test_model_is_a_distribution(model):
    assert np.allclose(np.exp(np.array(model)).reshape(SYMBOLS, SYMBOLS, SYMBOLS).sum(axis=2), 1, atol=1e-3)


@pytest.mark.parametrize("text", ["idiot", "1d1ot", "i d i o t", "i.d.i.o.t", "iiidiooot", "IDIOT!!", "id!ot", "i-d-i-0-t", "(idiot)"])
def test_disguises_are_restored(model, text):
    assert "idiot" in words_of(f"some words {text} and more", model, {})


def test_plain_words_stay(model):
    assert readings("word", model) == ["word"] and readings("(word),", model) == ["word"]
    assert readings("", model) == [] and readings("%%%", model) == [] and decode("", model) == ""
    assert "well" in readings("well-known", model)
    assert words_of("x" * 5000 + "9" * 5000, model, {}) is not None


@pytest.mark.parametrize("text", ["1d10t" + "!" * 60, "1d10t" + "." * 60, "(" * 60 + "1d10t", "m" + "0" * 60 + "ron",
                                  "i  d \t i\n o   t", "id io t"])
def test_long_stretched_and_loose_disguises_are_restored(model, text):
    found = words_of(f"some words {text} andmore", model, {})
    assert ("moron" if text[0] == "m" else "idiot") in found


def test_words_inside_long_tokens_are_decoded(model):
    assert any(w.startswith("idiot") for w in words_of("-".join("idi0t" * 12), model, {}))
    text = "bakori." * 200 + "m0r0n" + ".molute" * 200  # no white space
    assert any("moron" in w for w in words_of(text, model, {}))
    assert decode("a-" * 50_000, model)


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    got = toxicity_digest(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if crc(i) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_disguised_documents_go_and_clean_ones_stay(spark, corpus):
    rows, labels = corpus
    rng = random.Random(7)
    disguised = [(1000 + i, " ".join(prose(rng, 30) + ["m0r0n", "s t u p i d", "cl0wn"])) for i in range(20)]
    clean = [(2000 + i, " ".join(prose(rng, 50))) for i in range(50)] + [(3000, None), (3001, "")]
    docs = documents(spark, rows + disguised + clean)
    kept = {r["doc_id"] for r in keep_clean(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert not kept & {i for i, _ in disguised}
    assert {i for i, _ in clean} <= kept


def test_labels_that_teach_nothing(spark, corpus):
    docs = documents(spark, [*corpus[0][:10], (None, None), (3, "repeated"), (3, "repeated")])
    for labels in ([], [(1, 1, None), (None, 1, 1)], [(1, 1, 1), (2, 1, 1)]):
        got = score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 13 and {r["predicted"] for r in got} == {0}
    assert score_documents(spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], LABELS)).count() == 0
