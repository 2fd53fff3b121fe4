import math
import os
import random
import time
from collections import Counter

import numpy as np
import pytest

from logloom.llm import lm

from .helpers import DOCUMENTS, crc, documents, words


@pytest.fixture(scope="module")
def vocab():
    head = np.sort(np.random.default_rng(0).integers(1, 1000, 40))[::-1].astype(float)
    return lm.Vocabulary({}, {}, head, np.array([0, 1, 3, 10, 40]), np.arange(1.0, lm.TAILS + 1),
                         np.zeros(lm.TAILS), 100, 10)


def codes(rng, n, least, most):
    return [rng.integers(0, 40 + lm.TAILS, rng.integers(least, most)).astype(np.int32) for _ in range(n)]


def test_gradient_against_differences(vocab):
    rng = np.random.default_rng(1)
    net = lm.Network(vocab)
    net.theta = net.theta.astype(np.float64) + rng.normal(0, 0.2, len(net.theta))
    net.__dict__.update(net.views(net.theta))
    streams = lm.Streams(codes(rng, 8, 3, 30), 4, vocab.inputs - 1)
    place, mask = next(iter(streams.windows(12)))
    keep, h0 = (~streams.begins[place]).astype(float), rng.normal(0, 0.3, (place.shape[1], net.h))

    def loss():
        h, out = h0, []
        for t in range(len(place)):
            h = net.step(net.X[streams.given[place][t]], h * keep[t][:, None])[0]
            out.append(h)
        return -net.log_probs(np.concatenate(out)[mask.ravel()], streams.code[place].ravel()[mask.ravel()]).mean()

    g, _ = net.gradient(streams.given[place], streams.code[place], keep, mask, h0)
    big = np.flatnonzero(np.abs(g) > 1e-4)
    for i in rng.choice(big, 40):
        net.theta[i] += 1e-5
        up = loss()
        net.theta[i] -= 2e-5
        down = loss()
        net.theta[i] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(float(g[i]), rel=2e-3, abs=1e-5)


def test_scores_carry_the_state_and_sum_to_one(vocab):
    rng = np.random.default_rng(2)
    net = lm.Network(vocab)
    net.theta += rng.normal(0, 0.2, len(net.theta)).astype(np.float32)
    docs = codes(rng, 9, 1, 120)  # longer than a window
    got = lm.score_documents(net, docs)
    n = 40 + lm.TAILS
    for d, s in zip(docs, got):
        h, total, before = np.zeros((1, net.h), np.float32), 0.0, vocab.inputs - 1
        for c in d:
            h = net.step(net.X[[before]], h)[0]
            p = np.exp(net.log_probs(np.repeat(h, n, 0), np.arange(n)))
            assert p.sum() == pytest.approx(1, abs=1e-4)
            total, before = total + math.log(p[c]), c
        assert s == pytest.approx(total, abs=2e-3)


def test_the_output_layer_works_on_few_rows_at_once(vocab, monkeypatch):
    rng = np.random.default_rng(6)
    docs, sizes, exp = codes(rng, 600, 20, 80), [], np.exp

    def seen(x, *args, **named):
        sizes.append(np.size(x))
        return exp(x, *args, **named)

    monkeypatch.setattr(np, "exp", seen)
    net = lm.Network(vocab)
    lm.train(net, docs)
    lm.score_documents(net, docs)
    assert max(sizes) <= 1024 * (net.n_classes + lm.TAILS)


def test_gradient_and_scores_do_not_depend_on_blocks(vocab, monkeypatch):
    rng = np.random.default_rng(7)
    net, docs = lm.Network(vocab), codes(rng, 30, 1, 60)
    net.theta += rng.normal(0, 0.2, len(net.theta)).astype(np.float32)
    streams = lm.Streams(docs, 8, vocab.inputs - 1)
    place, mask = next(iter(streams.windows(32)))
    keep, h = (~streams.begins[place]).astype(np.float32), np.zeros((place.shape[1], net.h), np.float32)

    def both():
        return net.gradient(streams.given[place], streams.code[place], keep, mask, h)[0], lm.score_documents(net, docs)

    g, s = both()
    for rows, few in ((7, 1), (1, 1000)):
        monkeypatch.setattr(lm, "ROWS", rows)
        monkeypatch.setattr(lm, "FEW", few)
        for got, want in zip(both(), (g, s)):
            assert np.allclose(got, want, rtol=1e-4, atol=1e-6)


def test_places_give_the_codes_of_words():
    head = np.array([3.0, 2.0])
    v = lm.Vocabulary({}, {b"a": 0, lm.END: 1}, head, np.array([0, 1, 2]), np.ones(lm.TAILS), np.zeros(lm.TAILS), 5, 2)
    some = [b"a", lm.END, b"b", b"xy", b"\xc3\xa9", b"long-word"]
    got = lm.Places(v.ids).of(some)
    assert np.where(got < 0, len(head) - 1 - got, got).tolist() == [v.code(w) for w in some]


def test_training_lowers_the_loss(vocab):
    rng = np.random.default_rng(3)
    docs = [np.tile([1, 5, 9, 12], rng.integers(3, 9)).astype(np.int32) for _ in range(3000)]
    net = lm.Network(vocab)
    before = lm.score_documents(net, docs).sum()
    lm.train(net, docs)
    assert lm.score_documents(net, docs).sum() > 0.6 * before


def reference(rows):
    counts = Counter()
    for i, text in rows:
        if crc(i) % 7 != 2:
            counts.update([*words(text), b" "])
    n, v, out = sum(counts.values()), len(counts), []
    for i, text in rows:
        w = [*words(text), b" "]
        out.append((i, crc(i) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n,
                    sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out


def order(r):
    return str(r[:4])


@pytest.mark.parametrize("dictionary", [200_000, 20])
def test_counts_and_base_scores(spark, monkeypatch, dictionary):
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("Ab cd EF gh é ij kl".split()) + rng.choice(["", "x", str(rng.randint(0, 40))])
                         for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (3, "repeated id"), (3, "repeated id"), (502, "w " * 20_000)]
    got = lm.lm_digest(documents(spark, rows)).collect()
    got = sorted((tuple(r) for r in got), key=order)
    want = sorted(reference(rows), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)


def test_learned_order_beats_counts_on_held_out_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        own = ["red green blue".split(), "uno dos tres".split()][rng.randrange(2)]
        rows.append((i, " ".join(own * rng.randint(5, 40))))
    old = lm.SHARE
    got = [r for r in lm.lm_digest(documents(spark, rows)).collect() if r["held_out"]]
    assert old == lm.SHARE and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_without_training_rows(spark):
    assert lm.lm_digest(spark.createDataFrame([], DOCUMENTS)).count() == 0
    only = next(i for i in range(100) if crc(i) % 7 == 2)
    (r,) = lm.lm_digest(documents(spark, [(only, "a b")])).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    (r,) = lm.lm_digest(documents(spark, [(None, "a b")])).collect()
    assert not r["held_out"] and r["n_known"] == 3


def test_every_training_text_is_learned_from_once(spark, monkeypatch, tmp_path):
    rows = [(i, f"w{i} " * (1 + i % 5)) for i in range(400)] + [(None, None), (401, "same"), (402, "same")]
    docs = documents(spark, rows).repartition(3)
    counts = lm.stage(lm.count_words(docs), "words")
    vocab = lm.vocabulary(counts)
    learn, folder = lm.train, str(tmp_path)

    def train(net, docs, **options):
        with open(f"{folder}/{os.getpid()}-{time.time_ns()}", "w") as f:
            f.write(" ".join(str(c) for d in docs for c in d))
        return learn(net, docs, **options)

    monkeypatch.setattr(lm, "train", train)
    lm.fit(docs, vocab, held=50)
    parts = [list(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    assert max(map(len, parts)) < 60  # no more at once than is held and a text
    want = Counter(vocab.code(w) for _, t in rows for w in [*words(t), lm.END])
    assert Counter(c for p in parts for c in p) == want


def mixed_texts(seed, n=160):
    """Texts of 1 to 20,000 words, most of them short, whose words follow one another by a rule."""
    rng = random.Random(seed)
    words_ = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        length = 20_000 if i == 1 else 6_000 if i == 2 else int(1 + 400 * rng.random() ** 4)
        at, text = rng.randrange(60), []
        for _ in range(length):
            text.append(words_[at])
            at = (at * 7 + rng.choice([1, 1, 1, 5])) % 60
        rows.append((i, " ".join(text)))
    return rows


def held_out_score(net, vocab, rows):
    codes = [np.array([vocab.code(w) for w in [*words(t), lm.END]], dtype=np.int32) for _, t in rows]
    return lm.score_documents(net, codes).sum() / sum(map(len, codes))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_texts_of_mixed_lengths_are_learned_whatever_the_partitions(spark, partitions):
    rows, held = mixed_texts(1), mixed_texts(2, 60)[3:]
    docs = documents(spark, rows).repartition(partitions)
    vocab = lm.vocabulary(lm.stage(lm.count_words(docs), "words"))
    before = held_out_score(lm.Network(vocab), vocab, held)
    assert held_out_score(lm.Network(vocab, lm.fit(docs, vocab)), vocab, held) > before + 0.2


@pytest.mark.parametrize("seed", range(4))
def test_every_round_is_better_than_none(spark, seed):
    rows, held = mixed_texts(1), mixed_texts(2, 60)[3:]
    vocab = lm.vocabulary(lm.stage(lm.count_words(documents(spark, rows)), "words"))
    net, rng = lm.Network(vocab), random.Random(seed)
    before = held_out_score(net, vocab, held)
    slices = [rng.randrange(2) for _ in rows]
    for r in (0, 1):
        lm.train(net, [np.array([vocab.code(w) for w in [*words(t), lm.END]], dtype=np.int32) for s, (_, t) in zip(slices, rows) if s == r])
        assert held_out_score(net, vocab, held) > before + 0.2
