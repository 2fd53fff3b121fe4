import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm.bpe import (VOCABULARY, Encoder, Vocabulary, bpe_digest, decode_ids, encode_texts, joined, merge_rounds,
                             read_vocabulary, spaced_pieces, token_list)

from .helpers import DOCUMENTS, documents

LIBRARY = Tokenizer.from_file(VOCABULARY)
OWN = Vocabulary(read_vocabulary())


def wanted(texts):
    return [e.ids for e in LIBRARY.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]


def got(texts):
    ids, ends = Encoder(OWN).encode(texts)
    return [part.tolist() for part in np.split(ids, ends[:-1])]


def test_every_code_point():
    texts = [f"a{c}!b{c}{c}1{c}'s" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    off = [t for t, a, b in zip(texts, got(texts), wanted(texts)) if a != b]
    assert off == []


ODD = st.sampled_from(list("aabehinrst 019'<|>\n\t\x1c\x85́̇İΣσΒß世\U0001f600")
                      + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "the ", "ing"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(ODD, max_size=60).map("".join), min_size=1, max_size=8))
def test_mixed_texts(texts):
    assert got(texts) == wanted(texts)


@pytest.mark.parametrize("text", ["a" * 20_001, "ab" * 5_000 + "c", "ha" * 5_000, "the" * 9_999,
                                  "".join(np.random.default_rng(1).choice(list("etaoinshrdlu"), 60_000))])
def test_long_words(text):
    assert got([text, "short"]) == wanted([text, "short"])


def test_merges_that_may_be_followed_at_once():
    """A symbol made by two merges, used between them: only the first place of the later one is merged in a round."""
    class Small:
        size, early = 10, np.array([False, False, True])
        made = np.array([5, 6, 5])   # ab -> 5, then 5a -> 6, then c d -> 5 again
        keys = np.array([0 * 10 + 1, 2 * 10 + 3, 5 * 10 + 2])
        rank = np.array([0, 2, 1], np.int32)
        ranks = Vocabulary.ranks
    # c d c d: the first c d makes 5, which takes the next c before that meets its d
    ids, n = merge_rounds(np.array([2, 3, 2, 3]), np.array([4]), _bind(Small))
    assert ids.tolist() == [6, 3] and n.tolist() == [2]


def _bind(kind):
    one = kind()
    one.ranks = lambda left, right: kind.ranks(one, left, right)
    return one


def test_pieces_end_where_words_end():
    text = "it's  so ́odd <|endoftext|> x" * 50
    parts = list(spaced_pieces(text, 40))
    assert "".join(parts) == text and len(parts) > 20
    assert sum(got(parts), []) == wanted([text])[0]


def test_words_are_learned_again_when_too_many_are_held(monkeypatch):
    monkeypatch.setattr("logloom.llm.bpe.KEPT_IDS", 3)
    monkeypatch.setattr("logloom.llm.bpe.STEP_WORDS", 2)
    texts = ["one two three four", "five six", "", "one unlikelihood seven"]
    assert got(texts) == wanted(texts)


def test_digest_against_the_library(spark):
    texts = ["Some words, some more.", None, "", " \n", "naïve Straße İ <|endoftext|> 12", "x" * 3000, "same", "same"]
    rows = {r["doc_id"]: r for r in bpe_digest(documents(spark, list(enumerate(texts)))).collect()}
    assert len(rows) == len(texts)
    for i, ids in enumerate(wanted(texts)):
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_decoding_any_ids(spark, monkeypatch):
    monkeypatch.setattr("logloom.llm.bpe.STEP_WORDS", 2)
    rows = [[5, 49407, 320], None, [], [-1, 320, 10**6], [None, 320]]
    want = [LIBRARY.decode([i for i in r or [] if i is not None and 0 <= i < OWN.size], skip_special_tokens=False) for r in rows]
    assert joined(pa.array(rows, pa.list_(pa.int32())), pa.array(token_list(json.loads(read_vocabulary())))).to_pylist() == want
    df = spark.createDataFrame([(r,) for r in rows], "ids array<int>")
    assert [r["decoded"] for r in decode_ids(df).collect()] == want


def test_empty_table_and_clashing_names(spark):
    assert bpe_digest(spark.createDataFrame([], DOCUMENTS)).count() == 0
    docs = documents(spark, [(None, "b c"), (1, "b c")]).withColumns({"ids": F.lit("z"), "decoded": F.lit(2), "n_tokens": F.lit(3)})
    assert [r["n_tokens"] for r in bpe_digest(docs).collect()] == [2, 2]
    both = decode_ids(encode_texts(docs))
    assert {r["decoded"] for r in both.collect()} == {"b</w> c</w>"} and both.columns.count("ids") == 1
