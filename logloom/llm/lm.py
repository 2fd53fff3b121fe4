"""Language-model scoring: a gated recurrent network with a class-factored softmax."""
from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stage
from .common import id_crc

END = b" "  # no word holds white space
HELD_OUT, FOLDS = 2, 7

# Words with outputs of their own; the others are drawn from one of TAILS classes by their last two bytes.
HEAD = 2048
CLASSES = 32
TAILS = 64
HIDDEN = 32
# Words whose counts travel to the tasks; counts of rarer ones are joined.
DICTIONARY = 200_000
# Rounds of fitting, and the share of the training documents that each reads: a slice of its own, all of them together.
ROUNDS = 2
SHARE = 1 / ROUNDS
# Streams read side by side and steps of a window, in fitting and in scoring.
FIT_STREAMS, FIT_STEPS = 256, 32
FULL_TOKENS = 2048
STREAMS, STEPS = 256, 32
# Tokens held before they are scored together, and before they are learned from.
HELD_TOKENS = 2 << 20
LEARNED_TOKENS = 1 << 20
RATE = 0.02
# Distinct words a task counts before it sends them on.
COUNTED = 300_000
CHUNK = 8192
# Rows of the output layer worked on together, so that their logits stay in the cache of a core.
ROWS = 1024
# Rows of one input word that are added one after another; more are added at once.
FEW = 8


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


# ---- counts ----------------------------------------------------------------

def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(id_crc(doc_id), F.lit(FOLDS)) == HELD_OUT


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all rows of ``docs``, the end included; counted in the task, then summed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()),
                                               "c": pa.array(list(seen.values()), pa.int64())})
        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens_of(t.as_py()))
                seen[END] += 1
                if len(seen) > COUNTED:
                    yield sent()
                    seen.clear()
        yield sent()

    return (docs.select(text).mapInArrow(count, "word binary, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


@dataclass
class Vocabulary:
    counts: dict[bytes, int]    # of the most frequent words
    ids: dict[bytes, int]       # head words, most frequent first
    head: np.ndarray            # their counts
    starts: np.ndarray          # first head word of each class, and the end
    tail: np.ndarray            # tokens of each tail class
    tail_log: np.ndarray        # log10 of tokens + words + 1 of each tail class
    n: int
    v: int

    @property
    def inputs(self) -> int:
        return len(self.head) + TAILS + 1

    def code(self, word: bytes) -> int:
        k = self.ids.get(word)
        return len(self.head) + tail_class(word) if k is None else k


class Places(dict):
    """The places of known words; -1, -2 ... is the tail class of any other."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-2:]) % TAILS

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Bounded tables of a staged word count."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the lowest count whose words still fit the dictionary
    sizes = counts.groupBy("c").count()
    upper = sizes.where(F.col("c") > 64).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if upper <= DICTIONARY:
        few = {r["c"]: r["count"] for r in sizes.where("c <= 64").collect()}
        least = 65
        while least > 1 and upper + few.get(least - 1, 0) <= DICTIONARY:
            least -= 1
            upper += few.get(least, 0)
    else:
        lo, hi = 65, int(n)
        while lo < hi:
            mid = (lo + hi) // 2
            if counts.where(F.col("c") >= mid).count() <= DICTIONARY:
                hi = mid
            else:
                lo = mid + 1
        least = lo
    rows = counts.where(F.col("c") >= least).collect()  # no more than DICTIONARY
    known = {bytes(r["word"]): r["c"] for r in rows}
    ranked = sorted(known.items(), key=lambda x: (-x[1], x[0]))
    top = dict(ranked[:HEAD])
    if END not in top:  # its count is that of the documents
        if len(top) >= HEAD:
            top.popitem()
        top[END] = known.get(END, 0)
    words = sorted(top.items(), key=lambda x: (-x[1], x[0]))
    head = np.array([c for _, c in words], dtype=np.float64)
    share = np.sqrt(head + 1).cumsum() / np.sqrt(head + 1).sum()
    edge = np.searchsorted(share, np.arange(1, CLASSES) / CLASSES) + 1
    starts = np.unique(np.r_[0, np.minimum(edge, len(head)), len(head)])
    suffix = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    heads = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in words], "word binary")
    tails = {r["t"]: r for r in counts.join(F.broadcast(heads), "word", "left_anti")  # HEAD rows
             .groupBy(F.pmod(F.crc32(suffix), F.lit(TAILS)).alias("t"))
             .agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    tail = np.array([tails[t]["c"] if t in tails else 0 for t in range(TAILS)], dtype=np.float64)
    kinds = np.array([tails[t]["v"] if t in tails else 0 for t in range(TAILS)], dtype=np.float64)
    return Vocabulary(known, {w: i for i, (w, _) in enumerate(words)}, head, starts, tail,
                      np.log10(tail + kinds + 1), int(n), int(v))


# ---- network -----------------------------------------------------------------

class Network:
    """Gated recurrent units over one-hot inputs; an output class, then a word of a head class.

    All parameters lie in one vector, so that copies can be averaged. The
    output biases start at the logarithms of the corpus counts.
    """

    def __init__(self, vocab: Vocabulary, theta: np.ndarray | None = None, seed: int = 0):
        self.vocab, self.h = vocab, HIDDEN
        self.n_head = len(vocab.head)
        self.n_classes = len(vocab.starts) - 1
        shapes = {"X": (vocab.inputs, 3 * self.h), "U": (self.h, 3 * self.h),
                  "C": (self.h, self.n_classes + TAILS), "c": (self.n_classes + TAILS,),
                  "W": (self.n_head, self.h), "w": (self.n_head,)}
        self.shapes = shapes
        size = sum(math.prod(s) for s in shapes.values())
        self.theta = np.zeros(size, np.float32) if theta is None else theta
        self.__dict__.update(self.views(self.theta))
        self.class_of = np.repeat(np.arange(self.n_classes), np.diff(vocab.starts))
        if theta is None:
            rng = np.random.default_rng(seed)
            self.X[:] = rng.normal(0, 0.1, self.X.shape)
            self.U[:] = rng.normal(0, 0.3 / math.sqrt(self.h), self.U.shape)
            self.C[:] = rng.normal(0, 0.05, self.C.shape)
            mass = np.r_[np.add.reduceat(vocab.head, vocab.starts[:-1]), vocab.tail] + 0.5
            self.c[:] = np.log(mass / mass.sum())
            for a, b in zip(vocab.starts, vocab.starts[1:]):
                self.w[a:b] = np.log((vocab.head[a:b] + 1) / (vocab.head[a:b] + 1).sum())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = flat[at:at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def step(self, x: np.ndarray, h: np.ndarray):
        k = self.h
        g = h @ self.U
        zr = x[:, :2 * k] + g[:, :2 * k]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n = zr[:, k:] * g[:, 2 * k:]
        n += x[:, 2 * k:]
        np.tanh(n, out=n)
        after = h - n
        after *= zr[:, :k]
        after += n
        return after, zr, n, g

    def targets(self, code: np.ndarray) -> np.ndarray:
        return np.where(code < self.n_head, self.class_of[np.minimum(code, self.n_head - 1)],
                        code - self.n_head + self.n_classes)

    def log_probs(self, states: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Natural log of each token's class and, for head words, of the word in it."""
        target, order, spans = self.by_class(code)
        code, s = code[order], states[order]
        found = np.empty(len(code))
        for a in range(0, len(code), ROWS):
            own = target[a:a + ROWS]
            found[a:a + ROWS] = _own_log(_logits(s[a:a + ROWS], self.C, self.c), own)
        for a, b, lo, hi in spans:
            found[a:b] += _own_log(_logits(s[a:b], self.W[lo:hi].T, self.w[lo:hi]), code[a:b] - lo)
        out = np.empty(len(code))
        out[order] = found
        return out

    def by_class(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """(sorted classes of the tokens, their places in this order, spans of
        at most ROWS tokens of one head class: first, last, the class's words)."""
        target = self.targets(code).astype(np.min_scalar_type(self.n_classes + TAILS))
        order = np.argsort(target, kind="stable")
        target = target[order]
        cut = np.searchsorted(target, np.arange(self.n_classes + 1))
        starts = self.vocab.starts
        spans = [(a, min(a + ROWS, int(cut[k + 1])), int(starts[k]), int(starts[k + 1]))
                 for k in range(self.n_classes) if starts[k + 1] - starts[k] > 1
                 for a in range(int(cut[k]), int(cut[k + 1]), ROWS)]
        return target, order, spans

    def gradient(self, given: np.ndarray, code: np.ndarray, keep: np.ndarray, mask: np.ndarray, h: np.ndarray):
        """(gradient of the mean loss, state after the window): the loss runs
        back through this window only, the state goes on into the next."""
        steps, width, k = *given.shape, self.h
        kind = self.theta.dtype
        before = np.empty((steps, width, k), kind)
        states = np.empty_like(before)
        gates, news, inner = [], [], []
        for t in range(steps):
            h = np.multiply(h, keep[t][:, None], out=before[t])
            states[t], zr, n, g = self.step(self.X[given[t]], h)
            h = states[t]
            gates.append(zr)
            news.append(n)
            inner.append(g[:, 2 * k:])
        flat = np.zeros_like(self.theta)
        grad = self.views(flat)
        on = np.flatnonzero(mask.ravel())
        scale = kind.type(1 / max(len(on), 1))
        target, order, spans = self.by_class(code.ravel()[on])
        on = on[order]
        s, y = states.reshape(-1, k)[on], code.ravel()[on]
        ds = np.empty_like(s)
        for a in range(0, len(on), ROWS):
            part = s[a:a + ROWS]
            p = _excess(_logits(part, self.C, self.c), target[a:a + ROWS], scale)
            grad["C"] += part.T @ p
            grad["c"] += p.sum(axis=0)
            np.matmul(p, self.C.T, out=ds[a:a + ROWS])
        for a, b, lo, hi in spans:
            q = _excess(_logits(s[a:b], self.W[lo:hi].T, self.w[lo:hi]), y[a:b] - lo, scale)
            grad["W"][lo:hi] += q.T @ s[a:b]
            grad["w"][lo:hi] += q.sum(axis=0)
            ds[a:b] += q @ self.W[lo:hi]
        back = np.zeros((steps * width, k), kind)
        back[on] = ds
        back = back.reshape(steps, width, k)
        dx = np.empty((steps, width, 3 * k), kind)
        after = np.zeros_like(h)
        dg = np.empty((width, 3 * k), kind)
        for t in range(steps - 1, -1, -1):
            z, r, n = gates[t][:, :k], gates[t][:, k:], news[t]
            d = back[t]
            d += after
            after = z * d
            dn = d - after
            dz = before[t] - n
            dz *= after
            np.multiply(dz, 1 - z, out=dg[:, :k])
            n *= n
            dn *= np.subtract(1, n, out=n)
            dx[t, :, 2 * k:] = dn
            dn *= r
            dg[:, 2 * k:] = dn
            dn *= inner[t]
            np.multiply(dn, np.subtract(1, r, out=r), out=dg[:, k:2 * k])
            dx[t, :, :2 * k] = dg[:, :2 * k]
            grad["U"] += before[t].T @ dg
            after += dg @ self.U.T
            after *= keep[t][:, None]
        _add_rows(grad["X"], given.ravel(), dx.reshape(-1, 3 * k))
        return flat, h


def _logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = states @ weights
    out += bias
    return np.clip(out, -60, 60, out=out)


def _own_log(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Natural log probability of one outcome in each row; the logits are overwritten."""
    out = logits[np.arange(len(own)), own].astype(np.float64)
    out -= np.log(_row_sums(np.exp(logits, out=logits)))
    return out


def _row_sums(rows: np.ndarray) -> np.ndarray:
    return rows @ np.ones(rows.shape[1], rows.dtype)


def _excess(logits: np.ndarray, own: np.ndarray, scale) -> np.ndarray:
    """Gradient of the loss by the logits, which are overwritten."""
    p = np.exp(logits, out=logits)
    p *= (scale / _row_sums(p))[:, None]
    p[np.arange(len(own)), own] -= scale
    return p


def _add_rows(out: np.ndarray, place: np.ndarray, rows: np.ndarray) -> None:
    """Add every row to the row of ``out`` that it has its place in."""
    place = place.astype(np.min_scalar_type(len(out)))
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    size = np.diff(np.r_[first, len(place)])
    for i in np.flatnonzero(size > FEW):
        out[place[first[i]]] += rows[order[first[i]:first[i] + size[i]]].sum(axis=0)
    for j in range(FEW):
        at = first[(size > j) & (size <= FEW)]
        out[place[at]] += rows[order[at + j]]


class Streams:
    """Documents laid end to end in streams of nearly equal length, read side by side."""

    def __init__(self, docs: list[np.ndarray], width: int, start: int):
        """``docs``: codes of each document; ``start``: the input code before its first token."""
        load = [(0, i) for i in range(min(width, max(len(docs), 1)))]
        held: list[list[int]] = [[] for _ in load]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, i = heapq.heappop(load)
            held[i].append(d)
            heapq.heappush(load, (n + len(docs[d]), i))
        held.sort(key=lambda ds: -sum(len(docs[d]) for d in ds))
        order = [d for ds in held for d in ds]
        self.code = np.concatenate([docs[d] for d in order]) if order else np.empty(0, np.int32)
        lengths = np.array([len(docs[d]) for d in order], dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        self.given = np.empty_like(self.code)
        self.given[1:] = self.code[:-1]
        self.given[first] = start
        self.begins = np.zeros(len(self.code), dtype=bool)
        self.begins[first] = True
        self.doc = np.repeat(order, lengths)
        self.length = np.array([sum(len(docs[d]) for d in ds) for ds in held], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def windows(self, steps: int):
        """(places by step and stream, whether there is a token); streams that ended are left out."""
        for at in range(0, int(self.length.max(initial=0)), steps):
            live = int((self.length > at).sum())
            step = at + np.arange(steps)[:, None]
            step = step[:max(1, min(steps, int(self.length[0]) - at))]
            mask = step < self.length[None, :live]
            yield np.where(mask, self.offset[None, :live] + step, self.offset[None, :live]), mask


def score_documents(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of every document's codes. The state is carried
    from window to window until the document ends."""
    out = np.zeros(len(docs))
    streams = Streams(docs, STREAMS, net.vocab.inputs - 1)
    h = np.zeros((len(streams.length), net.h), np.float32)
    for place, mask in streams.windows(STEPS):
        h = h[:place.shape[1]]
        keep = (~streams.begins[place]).astype(np.float32)
        given, states = streams.given[place], np.empty((*place.shape, net.h), np.float32)
        for t in range(len(place)):
            h = net.step(net.X[given[t]], h * keep[t][:, None])[0]
            states[t] = h
        on = mask.ravel()
        at, states = place.ravel()[on], states.reshape(-1, net.h)[on]
        for a in range(0, len(at), CHUNK):
            part = at[a:a + CHUNK]
            out += np.bincount(streams.doc[part], net.log_probs(states[a:a + CHUNK], streams.code[part]), len(docs))
    return out


class Moments:
    """What Adam carries from window to window, and from one call of ``train``
    to the next: decayed sums of gradients and of their squares."""

    def __init__(self, net: Network):
        self.m, self.v, self.k = np.zeros_like(net.theta), np.zeros_like(net.theta), 0


def train(net: Network, docs: list[np.ndarray], rate: float = RATE, moments: Moments | None = None) -> int:
    """One pass of truncated backpropagation with Adam; tokens seen.

    Streams end at different places. A window that fewer of them fill says
    less about all texts: with under FULL_TOKENS tokens its step is shorter in proportion.
    """
    streams = Streams(docs, FIT_STREAMS, net.vocab.inputs - 1)
    moments = moments or Moments(net)
    m, v, k = moments.m, moments.v, moments.k
    step = np.empty_like(net.theta)
    h = np.zeros((len(streams.length), net.h), np.float32)
    for place, mask in streams.windows(FIT_STEPS):
        keep = (~streams.begins[place]).astype(np.float32)
        g, h = net.gradient(streams.given[place], streams.code[place], keep, mask, h[:place.shape[1]])
        norm = float(np.sqrt(np.dot(g, g)))
        if norm > 1:
            g /= norm
        k += 1
        m *= 0.9
        m += g
        v *= 0.99
        v += np.multiply(g, g, out=g)
        np.sqrt(np.multiply(v, 0.01 / (1 - 0.99 ** k), out=step), out=step)
        step += 1e-6
        np.divide(m, step, out=step)
        full = min(1.0, mask.sum() / FULL_TOKENS)
        net.theta -= np.multiply(step, 0.1 * rate * full / (1 - 0.9 ** k), out=step)
    moments.k = k
    return int(streams.length.sum())


def slice_of(rounds: int, text: str = "text") -> Column:
    """The round, from 0, that reads a text. Every text has one, null too."""
    return F.pmod(F.xxhash64(F.col(text)), F.lit(rounds))


def fit(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, held: int = LEARNED_TOKENS) -> np.ndarray:
    """Parameters after one pass over all training documents, of which each of
    ``rounds`` reads a slice.

    Every task goes through its own documents of the slice from the same
    start, about ``held`` tokens at a time; the copies are averaged by their
    tokens, parameter block by block, and are the next round's start.
    """
    spark = docs.sparkSession
    theta = Network(vocab).theta
    block = 1 << 14
    sent_vocab = spark.sparkContext.broadcast(vocab)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(theta)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent_vocab.value
            net = Network(own, sent.value.copy())
            heads, moments, texts, size, n = Places(own.ids), Moments(net), [], 0, 0
            for batch in batches:
                for t in batch.column(0):
                    place = heads.of([*tokens_of(t.as_py()), END])
                    texts.append(np.where(place < 0, net.n_head - 1 - place, place))
                    size += len(texts[-1])
                    if size >= held:
                        n += train(net, texts, moments=moments)
                        texts, size = [], 0
            if texts:
                n += train(net, texts, moments=moments)
            if not n:
                return
            for i, at in enumerate(range(0, len(net.theta), block)):
                yield pa.RecordBatch.from_pydict({
                    "block": [i], "n": [n],
                    "part": pa.array([(net.theta[at:at + block].astype(np.float64) * n).tolist()],
                                     pa.list_(pa.float64()))})

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for i, n, part in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(),
                                      batch.column("part")):
                    x = part.values.to_numpy()
                    if i in sums:
                        sums[i][0] += n
                        sums[i][1] += x
                    else:
                        sums[i] = [n, x.copy()]
            for i, (n, x) in sums.items():
                yield pa.RecordBatch.from_pydict({"block": [i], "n": [n],
                                                  "part": pa.array([x.tolist()], pa.list_(pa.float64()))})

        kind = "block long, n long, part array<double>"
        rows = (docs.where(slice_of(rounds) == r).select("text").mapInArrow(learn, kind)
                .repartition("block").mapInArrow(total, kind).collect())  # one copy of the parameters
        if not rows:
            continue
        theta = theta.copy()
        for row in rows:
            theta[row["block"] * block:(row["block"] + 1) * block] = np.array(row["part"]) / row["n"]
    return theta


# ---- scoring -------------------------------------------------------------------

def _score(sent, kind: pa.DataType):
    """Rows of one document (word null) and of its words whose counts a task does not have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, theta = sent.value
        net = Network(vocab, theta)
        n_head = len(vocab.head)
        # head words, then the others whose counts are here, then the tail classes from the last to the first
        others = [w for w in vocab.counts if w not in vocab.ids]
        places = Places(vocab.ids)
        places.update(zip(others, range(n_head, n_head + len(others))))
        tails = np.array([tail_class(w) for w in others], dtype=np.int64)
        logs = np.log10(np.array([vocab.counts[w] for w in others], dtype=np.float64) + 1)
        code_of = np.r_[:n_head, n_head + tails, n_head + np.arange(TAILS)[::-1]].astype(np.int32)
        base_of = np.r_[np.log10(vocab.head + 1), logs, np.zeros(TAILS)]
        extra_of = np.r_[np.zeros(n_head), logs - vocab.tail_log[tails], -vocab.tail_log[::-1]]
        held: list[tuple] = []
        tokens = 0

        def flush():
            scores = score_documents(net, [d[2] for d in held]) / math.log(10)
            rid, ids, flag, words, tf, n_tokens, n_known, base, score = [], [], [], [], [], [], [], [], []
            for (row, key, codes, out, known, partial, extra, unknown), s in zip(held, scores):
                rid.append(row)
                ids.append(key)
                flag.append(out)
                words.append(None)
                tf.append(0)
                n_tokens.append(len(codes))
                n_known.append(known)
                base.append(partial)
                score.append(s + extra)
                for w, c in unknown.items():
                    rid.append(row)
                    ids.append(None)
                    flag.append(None)
                    words.append(w)
                    tf.append(c)
                    n_tokens.append(0)
                    n_known.append(0)
                    base.append(0.0)
                    score.append(0.0)
            return pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(ids, kind), pa.array(flag, pa.bool_()),
                 pa.array(words, pa.binary()), pa.array(tf, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                names=["rid", "id", "held_out", "word", "tf", "n_tokens", "n_known", "base", "score"])

        for batch in batches:
            for row, key, out, text in zip(*[batch.column(c).to_pylist() for c in ("rid", "id", "held_out", "text")]):
                words = tokens_of(text)
                words.append(END)
                place = places.of(words)
                away = np.flatnonzero(place < 0)
                codes, unknown = code_of[place], Counter(map(words.__getitem__, away.tolist()))
                partial, extra = float(base_of[place].sum()), float(extra_of[place].sum())
                empty_end = int(vocab.counts.get(END, 0) == 0)  # without training documents the end is unknown
                held.append((row, key, codes, out, len(words) - len(away) - empty_end, partial, extra, unknown))
                tokens += len(words)
            if tokens >= HELD_TOKENS:
                yield flush()
                held, tokens = [], 0
        if held:
            yield flush()
    return run


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every whole text by the network, and by word counts.

    Counts, classes and the network come from the rows whose id's CRC-32 mod 7
    is not 2, the network from one pass over all of these. Rare words are drawn from a class by their last bytes, in which
    each has its count and one more and all unknown ones together one. Counts
    of words beyond the dictionary are joined to the documents' own counts.
    Null and empty texts are just the end. A null id is training text; rows
    that repeat an id are scored each. Without training rows all words are
    unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                       held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    training = rows.where("NOT held_out")
    counts = stage(count_words(training), "words")
    vocab = vocabulary(counts)
    theta = fit(training, vocab)
    sent = spark.sparkContext.broadcast((vocab, theta))
    kind = dict(docs.dtypes)[id_col]
    schema = (f"rid long, id {kind}, held_out boolean, word binary, tf long, n_tokens long, n_known long, "
              "base double, score double")
    parts = rows.mapInArrow(_score(sent, to_arrow_type(rows.schema["id"].dataType)), schema)
    # no word begins with a space, so these keys meet nothing and are spread
    key = F.coalesce("word", F.concat(F.lit(" "), F.col("rid").cast("string")).cast("binary"))
    joined = parts.withColumn("word", key).join(counts.where(F.length("word") > 0), "word", "left")
    more = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    summed = joined.groupBy("rid").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + more).alias("base"), F.sum(F.col("score") + more).alias("score"))
    floor = math.log10(vocab.n + vocab.v + 1)
    return summed.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score")


def lm_digest(docs: DataFrame) -> DataFrame:
    return score_corpus(docs.select("doc_id", "text"))
