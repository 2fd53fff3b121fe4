import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from logloom.llm import spelling as S
from logloom.session import stage

from .helpers import DOCUMENTS, documents


def plain_counts(rows):
    """Words of (id, text) by the letter of the rule, one occurrence at a time."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(counts):
    """All pairs compared."""
    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if a != b and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(rows, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(S, "RANGE_WORDS", 7)


@pytest.mark.parametrize("letters,longest", [("ab", 6), ("abé", 5), ("abcdefgh", 3)])
def test_every_pair(spark, small_ranges, letters, longest):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(150)}
    counts = {w: 5 ** rng.randint(0, 5) + rng.randint(0, 1) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(S.variants(df)) == plain_variants(counts)


def test_nodes_are_one_per_prefix(spark, small_ranges):
    rng = random.Random(3)
    words = stage(spark.createDataFrame([("".join(rng.choice("abñ") for _ in range(rng.randint(1, 9))),) for _ in range(400)],
                                        "word string").distinct())
    node, number = {}, {}
    for word, nodes, n in S.trie_nodes(words, "word", ["word"]).collect():
        assert len(nodes) == len(word) + 1
        number[n] = word
        for k, x in enumerate(nodes):
            assert node.setdefault(word[:k], x) == x
    assert len(set(node.values())) == len(node)
    assert [number[n] for n in sorted(number)] == sorted(number.values())


def test_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 20)
    rng = random.Random(5)
    base = ["planet", "planets", "Planet", "plänets", "x-planet", "tiny", "flower", "flowers", "flowres", "ÀÉÎõü", "×÷×÷×÷", "aaaaaab"]
    texts = [(i, " ".join(rng.choices(base, k=60))) for i in range(300)]
    texts += [(None, "flower " * 9), (301, None), (302, ""), (303, "1 2 3"), (7, texts[7][1]), (304, "q" * 5000 + " " + "Q" * 5000)]
    texts += [(400 + i, "z" * 3000) for i in range(5)]
    got = S.variant_digest(documents(spark, texts))
    want = plain_variants(plain_counts(texts))
    assert rows(got) == want
    assert any(w == "planes" or w == "plaets" or len(w) == 6 and w not in base for w, *_ in want)   # some were shortened


def test_chain_of_forms(spark):
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg"]
    df = spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(words)], "word string, n long")
    got = {r["word"]: r for r in S.variants(df).collect()}
    assert {r["root"] for r in got.values()} == {"akjihg"}
    assert [got[w]["form"] for w in words] == words[1:] + [None]


def test_no_words_and_clashing_names(spark):
    assert S.variant_digest(spark.createDataFrame([], DOCUMENTS)).count() == 0
    docs = documents(spark, [(1, "someword " * 6), (2, None)]).selectExpr("*", "1 AS n", "2 AS word", "3 AS name", "4 AS number")
    assert rows(S.variant_digest(docs)) == [("someword", None, "someword", 6, 0, None)]
