import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import divergence as D
from logloom.llm.transducer import Transducer

from .helpers import DOCUMENTS


def plain_divergence(rows, least=10, top=10):
    """Every group with every kept term, by whole numbers."""
    docs = [[x or "" for x in r] for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)) for t, _, _ in docs]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), found in zip(docs, terms):
        df[lang].update(set(found))
        count[lang, source].update(found)
    out = []
    for lang in df:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        sources = sorted(s for x, s in count if x == lang)

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1000000000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            told = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(told, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(out)


def sample(seed=1, n=240):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "日本", "Été", "zz", "a", "ab", "abc", "x1y", "don't", "q_r"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["s1", "s2", "ß", "s10", None, "S1"])
        text = None if i % 37 == 0 else " ".join(rng.choices(words, k=rng.choice([0, 3, 40])))
        rows.append((text, "xx" if lang == "xx" and i > 5 else lang, source))
    return rows + [("only here", "fr", "s1"), (None, "fr", "s2"), ("", "fr", None)] + rows[:5]


SHAPE = "text string, lang string, source string, n int, ord string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE)   # names that the operator uses inside


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_every_group_and_term(spark):
    data = sample()
    assert rows(D.divergence(frame(spark, data))) == plain_divergence(data)


def test_many_blocks_tiles_and_passes(spark, monkeypatch):
    for name, value in dict(BLOCK_TERMS=3, SENT_BYTES=900, HELD=10, STEP_TOKENS=5, TILE=2, PIECE_TERMS=4).items():
        monkeypatch.setattr(D, name, value)
    data = sample(2)
    assert rows(D.divergence(frame(spark, data))) == plain_divergence(data)


def test_equal_sources_tie_by_name(spark):
    data = [(f"a b c {'d' * (i % 2)}", "en", s) for s in ("x", "y", "é", "z") for i in range(4)]
    got = rows(D.divergence(frame(spark, data)))
    assert got == plain_divergence(data)
    assert [r[3] for r in got if r[1] == "x" and r[2] == "pair"] == ["y", "z", "é"]


def test_nothing_to_compare(spark):
    assert D.divergence(spark.createDataFrame([], DOCUMENTS)).count() == 0
    few = [("one two", "en", "a"), ("one", "en", "b"), (None, None, None)]
    assert rows(D.divergence(frame(spark, few))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_of_large_counts():
    n, whole = np.array([[0, 10**15, 3 * 10**15]]), np.array([4 * 10**15])
    want = [1 + 1000000000 * (int(c) + 2) // int(whole[0]) for c in n[0]]
    assert D.shares(n, whole).tolist() == [want]
    assert D.shares(n * 1000, whole * 1000).tolist() == [[1 + 1000000000 * (int(c) * 1000 + 2) // (int(whole[0]) * 1000) for c in n[0]]]


@pytest.mark.parametrize("words", [[], [b""], [b"a"], [b"", b"a", b"ab"], sorted({bytes(random.Random(i).choices(b"abc\xc3\xa9", k=i % 9)) for i in range(600)})])
def test_ordinals(words):
    made = Transducer.from_bytes(Transducer.build(words).to_bytes())
    assert made.ordinals(words).tolist() == list(range(len(words)))
    others = [w + x for w in [*words, b"zz"] for x in (b"a", b"\xff", b"c" * 40) if w + x not in words]
    assert (made.ordinals(others) == -1).all()
    assert made.ordinals([]).tolist() == []


def test_as_few_states_as_there_are_endings():
    """Two prefixes share a state exactly if the same endings follow them."""
    rng = random.Random(8)
    words = sorted({bytes(rng.choices(b"ab", k=rng.randint(1, 7))) + rng.choice([b"", b"ing", b"ed"]) for _ in range(300)})
    endings = {frozenset(w[k:] for w in words if w[:k] == p) for word in words for k in range(len(word) + 1) for p in [word[:k]]}
    assert len(Transducer.build(words).final) == len(endings)
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])


def test_shares_in_longs_and_beyond(spark):
    """Counts whose product fits a long are not divided as decimals."""
    edge = D.LONG_COUNT
    counts = [(n, whole, kept) for n in (0, 7, edge, edge + 1, 1 << 40) for whole, kept in ((n, 1), (n + 12345, 678), (1 << 45, 5))]
    rows = spark.createDataFrame(counts, "n long, total long, kept long")
    got = rows.select("*", D.share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    assert dict(got.dtypes)["p"] == "bigint"
    assert all(r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.kept) for r in got.collect())
