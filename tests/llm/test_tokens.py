import tiktoken

from logloom.llm.tokens import SPLIT, pieces, read_ranks, token_counts

from .helpers import DOCUMENTS, documents


def encoder():
    return tiktoken.Encoding("t", pat_str=SPLIT, mergeable_ranks=read_ranks(), special_tokens={})


def test_every_limit_against_the_documents(spark):
    texts = ["one two three", None, "", "naïve Wörter, 12345!", "one two three", "a" * 5000, "word " * 3000]
    lengths = [0 if t is None else len(encoder().encode_ordinary(t)) for t in texts]
    got = {r["n_tokens"]: r for r in token_counts(documents(spark, list(enumerate(texts)))).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r["documents"] == lengths.count(limit)
        assert r["tokens_within"] == sum(x for x in lengths if x <= limit)
        assert r["documents_longer"] == sum(x > limit for x in lengths)
        assert r["tokens_truncated"] == sum(min(x, limit) for x in lengths)
        assert r["quantile"] == sum(x <= limit for x in lengths) / len(lengths)


def test_pieces_count_like_the_whole():
    text = ("It's 3 o'clock,  já  \n\n  über-all " * 400 + "word " * 500) * 3
    assert "".join(pieces(text, 1000)) == text and len(list(pieces(text, 1000))) > 5
    whole = len(encoder().encode_ordinary(text))
    assert sum(len(encoder().encode_ordinary(p)) for p in pieces(text, 1000)) == whole


def test_no_rows(spark):
    assert token_counts(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_by_columns(spark):
    docs = documents(spark, [(1, "a b", "x"), (2, "a b", "y"), (3, "a b c", "y"), (4, "q", None)])
    got = token_counts(docs, by=["source"]).collect()
    assert sorted((str(r["source"]), r["documents"], r["documents_longer"]) for r in got) == [
        ("None", 1, 0), ("x", 1, 0), ("y", 1, 0), ("y", 1, 1)]
