"""Toxicity: a noisy channel restores disguised words, then restored text is scored."""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage
from .common import id_crc

# Labelled documents of each class that the classifier is fitted on, at most.
SAMPLE = 4000
# Of these, the share that the word weights come from; the rest fit the final curve.
LEXICON_SHARE = 0.7
# Lengths of the word beginnings that have weights besides whole words.
PREFIXES = (4, 5, 6)
# A weight needs this log-likelihood ratio statistic and this log odds ratio.
SIGNIFICANCE = 24.0
LEAST_ODDS = 2.0
# Words whose weight a task remembers before it starts anew.
MEMORY = 400_000

SYMBOLS = 64
# What a symbol may stand for, with the cost of reading it so (natural log units).
LEET = {
    "0": (("o", 0.5),), "1": (("i", 0.7), ("l", 0.7)), "2": (("z", 1.5),), "3": (("e", 0.5),),
    "4": (("a", 0.5),), "5": (("s", 0.5),), "6": (("g", 1.0), ("b", 1.5)), "7": (("t", 0.5),),
    "8": (("b", 0.7),), "9": (("g", 1.0),), "@": (("a", 0.3),), "$": (("s", 0.3),),
    "!": (("i", 0.5), ("l", 1.5)), "|": (("l", 0.7), ("i", 0.7)), "+": (("t", 0.7),), "(": (("c", 1.0),),
    "€": (("e", 0.5),), "¡": (("i", 0.5),),
}
DROP = 9.0       # a leet symbol that stands for nothing
# A separator inside a word and between words; between single letters, where it most likely
# is disguise, and elsewhere.
JOIN_LETTERS, SPLIT_LETTERS = 0.2, 5.0
JOIN, SPLIT = 2.0, 0.2
ONE_OF_MANY = 0.2  # a run of three or more letters read as one
TWO_OF_MANY = 0.7  # or as two
ONE_OF_TWO = 3.0
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…|%&*#^~=_/\\-"
LETTERS = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
# Single characters set apart by white space, and pieces of one or two.
LOOSE = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
PIECES = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")
UNIT = re.compile(rf"([^\W\d_])\1*|([{re.escape(''.join(LEET))}])\2{{2,}}|.", re.S)


# ---- character language model ---------------------------------------------

def symbol(c: str) -> int:
    """1 to 26 for a-z, more for other letters, 0 for what is no letter."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (SYMBOLS - 27) if c.isalpha() else 0


def symbol_table() -> np.ndarray:
    return np.array([symbol(chr(i)) for i in range(1 << 16)], dtype=np.uint8)


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Letter trigrams of all documents, ends of words included: SYMBOLS cubed counts.

    Each task counts its texts in one array and sends what is not zero.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = symbol_table(), np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                low = (t.as_py() or "").lower()
                for at in range(0, len(low), 1 << 20):
                    codes = np.frombuffer(low[at:at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
                    s = np.concatenate([[0, 0], table[np.minimum(codes, 0xFFFF)], [0]]).astype(np.int64)
                    total += np.bincount(s[:-2] * SYMBOLS ** 2 + s[1:-1] * SYMBOLS + s[2:], minlength=len(total))
        gram = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": gram, "n": total[gram]})

    rows = (docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram")
            .agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    out[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def char_model(trigrams: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after two others, smoothed with shorter contexts."""
    tri = trigrams.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    tri[0, 0, 0] = 0  # runs of what is no letter say nothing about words
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 10 * p1) / (bi.sum(axis=1, keepdims=True) + 10)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32).ravel()


# ---- noisy channel ----------------------------------------------------------

def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of every part of a lower-case token, each with its channel cost; a space ends a word."""
    out = []
    units = list(UNIT.finditer(token))
    solid = [bool(m.group(1)) or m.group()[0] in LEET for m in units] + [False, False]
    for i, m in enumerate(units):
        run = m.group()
        c = run[0]
        if m.group(1):
            if len(run) == 1:
                out.append([(c, 0.0)])
            elif len(run) == 2:
                out.append([(run, 0.0), (c, ONE_OF_TWO)])
            else:
                out.append([(c, ONE_OF_MANY), (c + c, TWO_OF_MANY)])
        elif c in LEET and len(run) > 1:
            out.append([(r * n, cost + more) for r, cost in LEET[c] for n, more in ((1, ONE_OF_MANY), (2, TWO_OF_MANY))]
                       + [("", DROP)])
        elif c in LEET:
            out.append([*LEET[c], ("", DROP)])
        else:
            apart = not solid[i - 2] and not solid[i + 2] if i > 1 else not solid[i + 2]
            out.append([("", JOIN_LETTERS), (" ", SPLIT_LETTERS)] if apart else [("", JOIN), (" ", SPLIT)])
    return out


def decode(token: str, model: list[float]) -> str:
    """The likeliest reading: Viterbi over pairs of last symbols, in time linear in the length."""
    states: dict = {(0, 0): (0.0, None)}  # score and, last first, the readings so far
    for options in lattice(token):
        new: dict = {}
        for (a, b), (score, path) in states.items():
            for reading, cost in options:
                x, y, s = a, b, score - cost
                for c in reading:
                    z = symbol(c)
                    s += model[x * SYMBOLS * SYMBOLS + y * SYMBOLS + z]
                    x, y = (0, 0) if z == 0 else (y, z)
                old = new.get((x, y))
                if old is None or s > old[0]:
                    new[x, y] = (s, (path, reading) if reading else path)
        states = new
    ends = {k: s + (model[k[0] * SYMBOLS * SYMBOLS + k[1] * SYMBOLS] if k[1] else 0.0) for k, (s, _) in states.items()}
    best = max(ends.values())
    return max(_spelled(states[k][1]) for k, s in ends.items() if s == best)


def _spelled(path: tuple | None) -> str:
    parts = []
    while path is not None:
        path, reading = path
        parts.append(reading)
    return "".join(reversed(parts))


def readings(token: str, model: list[float]) -> list[str]:
    """Words that a lower-case token without white space may be meant as.

    Plain words stand for themselves: their lattice has one path. Others add
    the channel's reading to the letters as they are.
    """
    if token.isalpha():
        return [token] if not TRIPLE.search(token) else [token, *decode(token, model).split()]
    core = token.strip(EDGES)
    if core.isalpha() and not TRIPLE.search(core):
        rest = token[token.find(core) + len(core):].rstrip(".,;:?")
        # a symbol or two at the end can be letters too
        if not rest or len(rest) > 2 or not all(c in LEET for c in rest):
            return [core]
    plain = LETTERS.findall(token)
    if not any(c in LEET or c.isalpha() for c in token):
        return plain
    ends = token.strip(".,;:?\"'()[]{}<>«»„“”…%&*#^~=_/\\-")
    found = [*plain, *decode(ends, model).split()]
    if ends != core and core:
        found += decode(core, model).split()
    return list(dict.fromkeys(found))


def words_of(text: str, model: list[float], known: dict[str, list[str]]) -> set[str]:
    """Distinct restored words of a whole text; ``known`` remembers tokens."""
    low = text.lower()
    out: set[str] = set()
    tokens = set(low.split())
    for apart in (LOOSE, PIECES):
        tokens.update(" ".join(m.group().split()) for m in apart.finditer(low))
    for t in tokens:
        words = known.get(t)
        if words is None:
            if len(known) > MEMORY:
                known.clear()
            if " " in t:
                words = decode(t, model).split()
            else:
                words = readings(t, model)
            known[t] = words
        out.update(words)
    return out


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) >= n]]


# ---- classifier --------------------------------------------------------------

def terms(strongest: float, total: float, n: int, size: int) -> list[float]:
    """What the curve weighs: how strong, how many and how dense toxic words are."""
    return [1.0, strongest, total, math.log1p(n), math.log1p(1000.0 * n / max(size, 20)), float(n > 0)]


@dataclass(frozen=True)
class Scorer:
    model: list[float]
    weights: dict[str, float]
    curve: tuple[float, ...]  # of the terms that ``terms`` gives

    def evidence(self, words: set[str], memory: dict[str, float]) -> tuple[float, float, int, int]:
        """(strongest weight, sum of weights, words with one, words)."""
        strongest, total, n = 0.0, 0.0, 0
        for w in words:
            x = memory.get(w)
            if x is None:
                if len(memory) > MEMORY:
                    memory.clear()
                x = memory[w] = max([self.weights.get(f, 0.0) for f in features_of(w)])
            if x:
                n += 1
                total += x
                strongest = max(strongest, x)
        return strongest, total, n, len(words)

    def score(self, *evidence) -> float:
        z = sum(a * b for a, b in zip(self.curve, terms(*evidence)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _sketch(text: Column) -> Column:
    """Smallest hash among five-word shingles: equal for most pairs of near copies."""
    @F.pandas_udf("long")
    def least(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                w = (t or "").lower().split()
                out.append(min((xxhash.xxh64_intdigest(" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))))
                           - (1 << 63))
            yield pd.Series(out, dtype="int64")
    return least(text)


def _usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) that may teach."""
    return (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(F.pmod(id_crc(), F.lit(5)) != 0)
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Staged (doc_id, toxic, text): of each class, at most ``sample`` labelled
    training documents in the order of a hash, near copies once."""
    usable = _usable(labels)
    order = F.xxhash64("doc_id")
    # a bounded number of ids
    chosen = usable.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(
        usable.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    chosen = F.broadcast(stage(chosen, "chosen"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("sketch", _sketch(F.col("text")))
    kept = stage(rows, "labelled")
    firsts = kept.groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    return stage(firsts.select("r.doc_id", "toxic", "r.text"), "sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Character model of all documents, word weights and curve of a bounded sample of labelled ones.

    A weight is the log odds ratio of a word, or of a beginning of words,
    between toxic and other documents of the sample; only significant ones
    stay. The curve is a ridge logistic regression on other documents than
    those the weights come from. Labels only; language and source are not used.
    """
    spark = docs.sparkSession
    model = char_model(count_trigrams(docs)).tolist()
    sent = spark.sparkContext.broadcast(model)
    rows = training_sample(docs, labels, sample)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(100)) < int(100 * LEXICON_SHARE))

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for i, t, y in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")]):
                found = sorted({f for w in words_of(t or "", sent.value, known) for f in features_of(w)})
                yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()),
                                                  "toxic": pa.array([y] * len(found), pa.int32())})

    learn = rows.where("part").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Scorer(model, {}, (-4.0,))
    counts = learn.mapInArrow(restored, "feature string, toxic int").groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    odds = F.log((a + 0.5) / (bad + 1.0)) - F.log((b + 0.5) / (good + 1.0))
    n, m = float(bad + good), a + b

    def part(x: Column, want: Column) -> Column:
        return F.when(x > 0, x * F.log(x / want)).otherwise(0.0)

    g2 = 2 * (part(a, m * bad / n) + part(b, m * good / n) + part(bad - a, (n - m) * bad / n)
              + part(good - b, (n - m) * good / n))
    # significant words of a bounded sample
    kept = counts.where((odds >= LEAST_ODDS) & (g2 >= SIGNIFICANCE)).select("feature", odds.alias("w")).collect()
    weights = {r["feature"]: float(r["w"]) for r in kept}
    first = Scorer(model, weights, (-4.0,))
    held = spark.sparkContext.broadcast(first)

    def evident(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memory = {}, {}
        for batch in batches:
            found = [held.value.evidence(words_of(t or "", held.value.model, known), memory)
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"terms": pa.array([terms(*f) for f in found], pa.list_(pa.float64())),
                                              "toxic": batch.column("toxic").cast(pa.int32())})

    rest = rows.where("NOT part").select("text", "toxic").mapInArrow(
        evident, "terms array<double>, toxic int").collect()  # rows of the bounded sample
    curve = logistic(np.array([r["terms"] for r in rest], dtype=float).reshape(len(rest), -1),
                     np.array([r["toxic"] for r in rest], dtype=float))
    # the sample may hold the classes in other parts than the labels do
    every = {r["toxic"]: r["count"] for r in _usable(labels).groupBy("toxic").count().collect()}
    there = {c: sum(r["toxic"] == c for r in rest) for c in (0, 1)}
    if all(there.values()):
        shift = math.log(every[1] / every[0]) - math.log(there[1] / there[0])
        curve = (curve[0] + shift, *curve[1:])
    discard(rows)
    return Scorer(model, weights, curve)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> tuple[float, ...]:
    """Newton steps with a ridge on all but the constant."""
    if not len(y) or y.min() == y.max():
        return (-4.0, 1.0)
    beta, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - keep @ beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + keep
        beta = beta + np.linalg.solve(bend, slope)
    return tuple(map(float, beta))


def toxicity(spark, scorer: Scorer, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known, memory = sent.value, {}, {}
        for texts in batches:
            yield pd.Series([own.score(*own.evidence(words_of(t or "", own.model, known), memory)) for t in texts],
                            dtype="float64")
    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5).

    Whole texts are restored and scored; null and empty ones hold no word and
    get the score of a text without evidence. Labels other than 0 and 1 and
    null ids teach nothing; a document labelled twice is toxic if one label
    says so; without labels of both classes nothing is predicted toxic.
    Repeated rows stay; input columns named like the results are replaced.
    """
    scorer = fit(docs, labels, sample)
    return (docs.withColumn("score", toxicity(docs.sparkSession, scorer, F.col("text")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", (F.pmod(id_crc(), F.lit(5)) == 0).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those predicted toxic, all columns as they are."""
    score = toxicity(docs.sparkSession, fit(docs, labels, sample), F.col("text"))
    return docs.withColumn("__score", score).where("__score < 0.5").drop("__score")
