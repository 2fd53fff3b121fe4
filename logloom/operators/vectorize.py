"""Text vectors: signed word hashing, TF-IDF, and its truncated SVD."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.base import let
from ..functions.records import embedding_input_text
from ..functions.templates import ngram_terms
from ..functions.vectors import hash_embedding, norm, run_lengths
from ..session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, stage
from .heavy import COUNTERS, list_ends, top_terms
from .ngrams import Listed, Step, cut_wide, plain, recount, runs, spelled, steps, summaries
from .order import explode_once

# A text is a unit vector before projection; what is left of it below this
# length is rounding error and stays the zero vector.
ZERO_LENGTH = 1e-10
# Sparse rows that a task multiplies in one go, as a dense matrix of the features they use.
ROWS_PER_STEP = 32
# Features whose sums travel together.
BLOCK_FEATURES = 512
# Random vectors of a sketch beyond those asked for, and the residual it may leave.
SPARE = 32
TOLERANCE = 0.008
# Rows of a split, about, that its first basis is taken from.
SEEDED = 8192
# Numbers of all bases that one group of splits may have.
BASIS_NUMBERS = 8_000_000


def vocabulary(rows: DataFrame, max_features: int) -> DataFrame:
    """The most frequent terms of each split with their inverse document
    frequency; ties at the cut in alphabetical order. ``slot`` numbers them.
    ``rows`` holds (split, text, wide), see ``spelled``."""
    kept = top_terms(rows.select("split", "text", "wide"), max_features, COUNTERS, summaries, recount)
    sizes = rows.groupBy(F.col("split").alias("__split")).agg(F.count("*").alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return kept.join(sizes, F.col("split").eqNullSafe(F.col("__split"))).select(
        "split", "term", (F.col("rank") - 1).alias("slot"), idf.alias("idf"))


def tfidf(records: DataFrame, key: str = "seq", text: Column | None = None,
          split: Column | None = None, max_features: int = S.TFIDF_FEATURES, names: bool = True) -> DataFrame:
    """Sparse unit TF-IDF vectors of one and two word terms.

    One row per text with at least one kept term: ``split``, ``key``,
    ``terms`` (left out without ``names``), ``slots`` and ``weights``, ordered by slot. The vocabulary is
    small by its parameter and goes to the tasks, which weigh each text where
    it is: no term of a text is shuffled. Only if the vocabularies of all
    splits together are too large to send are the terms joined with them.
    """
    rows = texts(records, key, text, split)
    vocab = stage(vocabulary(rows, max_features), "vocabulary")
    known = _sendable(vocab)
    if known is None:
        joined = _weighed_by_join(rows, vocab, key)
        return joined if names else joined.drop("terms")
    return _weighed(rows, known, key, names)


def texts(records: DataFrame, key: str, text: Column | None, split: Column | None) -> DataFrame:
    """(split, doc, text, wide) of every record, see ``spelled``."""
    return spelled(F.lit("") if split is None else split, F.col(key), embedding_input_text() if text is None else text, records)


def _sendable(vocab: DataFrame) -> dict[str | None, list[tuple]] | None:
    """The vocabularies of all splits, None if they are measured too large to send."""
    size = vocab.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if size[0] > BROADCAST_ROWS or size[1] > BROADCAST_BYTES:
        return None
    known: dict[str | None, list[tuple]] = {}
    for r in vocab.orderBy("split", "slot").toLocalIterator():
        known.setdefault(r["split"], []).append((r["term"], r["idf"]))
    return known


def _weighed_by_join(rows: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    counted = explode_once(rows.select("split", "doc", run_lengths(ngram_terms("text")).alias("t")), "t")
    terms = counted.select("split", "doc", F.col("t.value").alias("term"), F.col("t.n").alias("tf"))
    words = vocab.select(F.col("split").alias("__split"), F.col("term").alias("__term"), "slot", "idf")
    weight = (1 + F.log("tf")) * F.col("idf")
    found = (terms.join(words, F.col("split").eqNullSafe(F.col("__split")) & (F.col("term") == F.col("__term")))
             .groupBy("split", "doc").agg(F.array_sort(F.collect_list(F.struct("slot", "term", weight.alias("w")))).alias("e")))
    unit = let(norm("e.w"), lambda n: F.transform("e.w", lambda x: x / n))
    return found.select("split", F.col("doc").alias(key), F.col("e.term").alias("terms"),
                        F.col("e.slot").alias("slots"), unit.alias("weights"))


class Weights:
    """Vocabularies of several splits, as lists of (term, idf) in the order of slots."""

    def __init__(self, known: dict[str | None, list[tuple]]):
        self.listed = {split: Listed([term for term, _ in words]) for split, words in known.items()}
        self.idf = {split: np.array([x for _, x in words]) for split, words in known.items()}

    def of(self, split: pa.Array, step: Step) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per split of some texts: its rows with kept terms, where each one's
        entries end, and slots and unit weights of all entries."""
        names = plain(step.names)
        for own, row, code in step.groups(split):
            if own not in self.listed:
                continue
            at, slot, tf = self.listed[own].find(row, code, names)
            weight = (1 + np.log(tf)) * self.idf[own][slot]
            weight /= np.sqrt(np.bincount(at, weight * weight))[at]
            first, counts = runs(at)
            yield own, step.rows[at[first]], np.r_[0, np.cumsum(counts)], slot, weight


def _weighed(rows: DataFrame, known: dict[str | None, list[tuple]], key: str, names: bool) -> DataFrame:
    """Weights of the kept terms of every text, inside the task."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(sent.value)
        spelt = {split: pa.array([term for term, _ in words], pa.string()) for split, words in sent.value.items()} if names else {}
        for batch in batches:
            for step in steps(batch.column("text"), batch.column("wide")):
                for own, found, ends, slot, weight in weights.of(batch.column("split"), step):
                    if len(found):
                        values = {"terms": spelt[own].take(pa.array(slot))} if names else {}
                        values |= {"slots": pa.array(slot.astype(np.int32)), "weights": pa.array(weight)}
                        lists = {name: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), v) for name, v in values.items()}
                        yield pa.RecordBatch.from_pydict({"split": pa.array([own] * len(found), pa.string()),
                                                          key: batch.column("doc").take(pa.array(found)), **lists})

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"split string, {key} {kind}, {'terms array<string>, ' if names else ''}slots array<int>, weights array<double>")


def _project(basis: np.ndarray, ends: np.ndarray, slots: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of some sparse rows, in steps: (rows, vectors)."""
    for part, used, dense in _steps(rows, ends, slots, weights):
        scores = dense @ basis[used]
        size = np.linalg.norm(scores, axis=1, keepdims=True)
        yield part, np.where(size < ZERO_LENGTH, 0.0, scores / np.maximum(size, ZERO_LENGTH))


def _embedder(spark: SparkSession, known: dict, bases: dict, split: str, text: str, wide: str) -> Column:
    """Vectors of texts under fitted vocabularies and bases; zeros without a kept term."""
    sent = spark.sparkContext.broadcast((known, bases))

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        weights, bases = Weights(sent.value[0]), sent.value[1]
        for splits, *spelt in batches:
            named = splits.dictionary_encode("encode")
            width = np.array([bases[g].shape[1] for g in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
            ends = np.r_[0, np.cumsum(width)]
            flat = np.zeros(ends[-1])
            for step in steps(*spelt):
                for own, rows, entries, slot, weight in weights.of(splits, step):
                    for part, vectors in _project(bases[own], entries, slot, weight, np.arange(len(rows))):
                        flat[(ends[rows[part]][:, None] + np.arange(vectors.shape[1])).ravel()] = vectors.ravel()
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
    return embed(split, text, wide)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each sparse row of a batch ends, and the slots and weights of all."""
    return (list_ends(batch.column("slots")), batch.column("slots").flatten().to_numpy().astype(np.int64),
            batch.column("weights").flatten().to_numpy())


def _steps(rows: np.ndarray, ends: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cut some rows of a batch into steps of ROWS_PER_STEP: the rows, the
    features they use, and their weights as a matrix of rows by features."""
    for first in range(0, len(rows), ROWS_PER_STEP):
        part = rows[first:first + ROWS_PER_STEP]
        n = ends[part + 1] - ends[part]
        start = np.cumsum(n) - n
        at = np.repeat(ends[part] - start, n) + np.arange(n.sum())
        used, place = np.unique(slots[at], return_inverse=True)
        place += np.repeat(np.arange(len(part)) * len(used), n)
        yield part, used, np.bincount(place, weights[at], len(part) * len(used)).reshape(len(part), len(used))


def _groups(split: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
    named = split.dictionary_encode("encode")
    code = named.indices.to_numpy()
    for g, own in enumerate(named.dictionary.to_pylist()):
        yield own, np.flatnonzero(code == g)


def gram_times(rows: DataFrame, bases: dict[str | None, np.ndarray]) -> dict[str | None, np.ndarray]:
    """X'X times a narrow basis for each split, in one pass over the rows.

    Every task adds up its own part, no more tasks than there are cores. The
    parts travel in blocks of features and are added where blocks meet; only
    features x width numbers of each split come back.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(bases)
    kind = "split string, block int, sums binary"

    def blocks(totals: dict) -> Iterator[pa.RecordBatch]:
        for (split, block), total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([split], pa.string()), pa.array([block], pa.int32()),
                                              pa.array([total.tobytes()], pa.binary())], names=["split", "block", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            ends, slots, weights = _entries(batch)
            for split, own in _groups(batch.column("split")):
                q = shared.value[split]
                total = totals.setdefault(split, np.zeros_like(q))
                _xtx(q, total, own, ends, slots, weights)
        yield from blocks({(split, k): t[k * BLOCK_FEATURES:(k + 1) * BLOCK_FEATURES] for split, t in totals.items()
                           for k in range(-(-len(t) // BLOCK_FEATURES))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for split, block, sums in zip(*[batch.column(c).to_pylist() for c in ("split", "block", "sums")]):
                values = np.frombuffer(sums)
                totals[split, block] = totals[split, block] + values if (split, block) in totals else values
        yield from blocks(totals)

    parts = rows.select("split", "slots", "weights").coalesce(context.defaultParallelism).mapInArrow(partial, kind)
    out = {split: np.zeros_like(q) for split, q in bases.items()}
    for r in parts.repartition("split", "block").mapInArrow(added, kind).collect():  # bounded by BASIS_NUMBERS
        first = r["block"] * BLOCK_FEATURES
        values = np.frombuffer(r["sums"]).reshape(-1, out[r["split"]].shape[1])
        out[r["split"]][first:first + len(values)] = values
    shared.unpersist()
    return out


def _xtx(q: np.ndarray, total: np.ndarray, own: np.ndarray, ends: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> None:
    """Add X'X times ``q`` over some rows of a batch to ``total``."""
    for _, used, dense in _steps(own[ends[own + 1] > ends[own]], ends, slots, weights):
        total[used] += dense.T @ (dense @ q[used])


def first_bases(rows: DataFrame, shapes: dict[str | None, tuple[int, int]], seed: int) -> dict[str | None, np.ndarray]:
    """Orthonormal bases to begin with, SPARE wider than asked for: random ones,
    turned towards the leading vectors of about SEEDED rows of their split.

    A better beginning saves a pass over all rows. It settles nothing: the
    residual is measured on all rows.
    """
    bases = {}
    for split, (features, dims) in shapes.items():
        start = np.random.default_rng(seed).standard_normal((features, min(dims + SPARE, features)))
        bases[split] = np.linalg.qr(start)[0]
    narrow = {split: q for split, q in bases.items() if q.shape[1] < len(q)}
    if not narrow:
        return bases
    sizes = _of_splits(rows, narrow).groupBy("split").count().collect()  # one row per split
    rates = [F.col("split").eqNullSafe(F.lit(r["split"])) & (F.rand(seed) < SEEDED / r["count"]) for r in sizes]
    if not rates:
        return bases
    shared = rows.sparkSession.sparkContext.broadcast(narrow)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for split, own in _groups(batch.column("split")):
                held.setdefault(split, []).append((own, *_entries(batch)))
        for split, parts in held.items():
            q = shared.value[split]
            for _ in range(3):
                total = np.zeros_like(q)
                for part in parts:
                    _xtx(q, total, *part)
                q = np.linalg.qr(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([split], pa.string()), pa.array([q.tobytes()], pa.binary())], names=["split", "basis"])

    some = rows.select("split", "slots", "weights").where(reduce(or_, rates)).repartition(len(sizes), "split")
    for r in some.mapInArrow(turn, "split string, basis binary").collect():  # bounded by BASIS_NUMBERS
        bases[r["split"]] = np.frombuffer(r["basis"]).reshape(bases[r["split"]].shape)
    shared.unpersist()
    return bases


def svd_bases(rows: DataFrame, shapes: dict[str | None, tuple[int, int]], seed: int = 42,
              tolerance: float = TOLERANCE, most_passes: int = 12) -> dict[str | None, np.ndarray]:
    """Leading right singular vectors of each split, by a range finder.

    ``shapes`` gives (features, dims) per split. The first pass multiplies
    the first basis by X'X; each further pass takes what the last product adds to the space met so far. The best vectors
    v inside that space come with what they miss, the length of X'Xv - lv, at
    no further pass. A split is done when no such residual exceeds
    ``tolerance`` of the largest eigenvalue, or its space is whole. All splits
    share the passes; each ends in features x width matrices, which the
    vocabulary bounds.
    """
    bases, out = first_bases(rows, shapes, seed), {}
    met = {split: [np.empty((features, 0)), np.empty((features, 0))] for split, (features, _) in shapes.items()}
    for number in range(most_passes):
        for split, image in gram_times(_of_splits(rows, bases) if out else rows, bases).items():
            features, dims = shapes[split]
            q, y = met[split] = [np.hstack(pair) for pair in zip(met[split], (bases.pop(split), image))]
            inside = q.T @ y
            values, inner = np.linalg.eigh((inside + inside.T) / 2)
            first = np.argsort(values)[::-1][:dims]
            v = q @ inner[:, first]
            residual = np.linalg.norm(y @ inner[:, first] - v * values[first], axis=0)
            room = features - q.shape[1]
            if room and number + 1 < most_passes and residual.max(initial=0) > tolerance * max(values.max(initial=0), 0):
                for _ in range(2):   # twice, for rounding errors
                    image = np.linalg.qr(image - q @ (q.T @ image))[0]
                bases[split] = image[:, :room]
            else:
                out[split] = v
                del met[split]
        if not bases:
            break
    return out


def _of_splits(rows: DataFrame, splits) -> DataFrame:
    return rows.where(reduce(or_, [F.col("split").eqNullSafe(F.lit(s)) for s in splits]))


def svd_parts(rows: DataFrame, sizes: DataFrame, dims: int) -> list[dict[str | None, tuple[int, int]]]:
    """(features, dims) of every split, in groups whose bases together stay
    below BASIS_NUMBERS; one row per split comes to the driver."""
    shapes = (rows.groupBy("split").agg(F.max(F.array_max("slots")).alias("last"))
              .join(sizes.select(F.col("split").alias("s"), "n"), F.col("split").eqNullSafe(F.col("s"))))
    groups, held = [{}], 0
    for r in shapes.orderBy("split").toLocalIterator():
        features = r["last"] + 1
        own = min(dims, r["n"] - 1 if r["n"] > 1 else 1, features)
        size = features * (own + SPARE)
        if groups[-1] and held + size > BASIS_NUMBERS:
            groups.append({})
            held = 0
        groups[-1][r["split"]] = (features, own)
        held += size
    return groups


def svd_embedding(records: DataFrame, key: str = "seq", text: Column | None = None,
                  dims: int = S.SVD_DIMS, max_features: int = S.TFIDF_FEATURES,
                  seed: int = 42, split: Column | None = None) -> DataFrame:
    """(``split``, ``key``, ``embedding``): unit rows of TF-IDF projected on
    the leading singular vectors of their split, by default of all records.

    Vocabularies and vectors of all splits come from the same passes over the
    data. Texts without a kept term have no row.
    """
    rows = stage(tfidf(records, key, text, split, max_features, names=False), "tfidf")
    sizes = records.groupBy((F.lit("") if split is None else split).cast("string").alias("split")).agg(
        F.count("*").alias("n"))
    return svd_of_rows(rows, sizes, key, dims, seed)[0]


def svd_of_rows(rows: DataFrame, sizes: DataFrame, key: str, dims: int, seed: int = 42) -> tuple[DataFrame, dict[str | None, np.ndarray]]:
    """Vectors of staged TF-IDF rows, and the basis of each split. ``sizes``
    has one row per split: how many texts it has, ``n``."""
    kind = rows.schema[key].dataType.simpleString()
    out, bases = None, {}
    for shapes in svd_parts(rows, sizes, dims):
        if not shapes:
            continue
        own = _of_splits(rows, shapes)
        fitted = svd_bases(own, shapes, seed)
        bases |= fitted
        shared = rows.sparkSession.sparkContext.broadcast(fitted)
        part = own.select("split", key, "slots", "weights").mapInArrow(
            _projector(shared, key), f"split string, {key} {kind}, embedding array<double>")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("split", key, F.lit(None).cast("array<double>").alias("embedding"))
    return out, bases


def _projector(shared, key: str):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, slots, weights = _entries(batch)
            for split, own in _groups(batch.column("split")):
                for rows, vectors in _project(shared.value[split], ends, slots, weights, own[ends[own + 1] > ends[own]]):
                    bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * vectors.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([split] * len(rows), pa.string()), batch.column(key).take(pa.array(rows)),
                         pa.ListArray.from_arrays(bounds, pa.array(vectors.ravel()))], names=["split", key, "embedding"])
    return project


def vectorize(records: DataFrame, backend: str = "hash", key: str = "seq",
              dims: int | None = None) -> DataFrame:
    """Records with ``embedding``; an existing one is replaced.

    ``hash`` stays inside the row. ``tfidf`` is fitted on these records; a
    text without a kept term gets the zero vector. ``given`` keeps the column
    a caller's own model filled.
    """
    if backend == "given":
        return records.withColumn("embedding", F.col("embedding").cast("array<double>"))
    plain = records.drop("embedding")
    if backend == "hash":
        return plain.withColumn("embedding", hash_embedding(embedding_input_text(), dims or S.HASH_DIMS))
    if backend != "tfidf":
        raise ValueError(f"unknown backend {backend!r}")
    return _fitted(plain, key, dims or S.SVD_DIMS, None)


class Fit:
    """Vocabularies and bases of all splits, in groups that are sent together."""

    def __init__(self, known: dict, groups: list[dict], split: str | None):
        self.known, self.groups, self.split = known, groups, split

    def place(self) -> Column:
        """A record's split; rows without a value are a split of their own."""
        return F.lit("") if self.split is None else F.coalesce(F.col(self.split).cast("string"), F.lit("\x00"))

    def bases(self) -> dict[str | None, np.ndarray]:
        return {name: basis for group in self.groups for name, basis in group.items()}


def fit_tfidf(records: DataFrame, key: str = "seq", dims: int = S.SVD_DIMS, split: str | None = None) -> Fit | None:
    """TF-IDF vocabularies and SVD bases of the records' texts, per value of
    ``split`` if one is given; None if the vocabularies are too large to send."""
    fit = Fit({}, [], split)
    spelt = texts(records, key, None, fit.place())
    known = _sendable(stage(vocabulary(spelt, S.TFIDF_FEATURES), "vocabulary"))
    if known is None:
        return None
    rows = stage(_weighed(spelt, known, key, names=False), "tfidf")
    sizes = spelt.groupBy("split").agg(F.count("*").alias("n"))
    fit.known = known
    fit.groups = [svd_bases(_of_splits(rows, shapes), shapes) for shapes in svd_parts(rows, sizes, dims) if shapes]
    return fit


def with_vectors(records: DataFrame, fit: Fit) -> DataFrame:
    """Records with the ``embedding`` of their own text, made in their own row:
    no record is joined or shuffled. Without a kept term it is zero."""
    spark, place, columns = records.sparkSession, fit.place(), [c for c in records.columns if c != "embedding"]
    low = records.withColumn("__split", place).withColumn("__text", F.lower(embedding_input_text()))
    low = cut_wide(low, "__text", "__wide")
    out = None
    for bases in fit.groups:
        own = low if fit.split is None else low.where(F.col("__split").isin(*bases))
        vector = _embedder(spark, {s: fit.known[s] for s in bases}, bases, "__split", "__text", "__wide")
        part = own.withColumn("embedding", vector).select(*columns, "embedding")
        out = part if out is None else out.unionByName(part)
    # without any kept term there is nothing to fit: vectors of no numbers
    empty = F.array().cast("array<double>")
    if out is None:
        out = records.withColumn("embedding", empty)
    elif fit.split is not None:
        out = out.unionByName(records.where(~place.isin(*fit.bases())).withColumn("embedding", empty))
    return out.select(*columns, "embedding")


def _fitted(plain: DataFrame, key: str, dims: int, split: str | None) -> DataFrame:
    """Records with their TF-IDF vectors, a zero vector where no term was kept."""
    fit = fit_tfidf(plain, key, dims, split)
    return _joined_vectors(plain, key, dims, Fit({}, [], split).place()) if fit is None else with_vectors(plain, fit)


def _joined_vectors(plain: DataFrame, key: str, dims: int, field: Column) -> DataFrame:
    """The same for vocabularies too large to send: vectors come back by key."""
    fitted = stage(svd_embedding(plain, key, dims=dims, split=field), "embedding")
    vectors = fitted.select(F.col(key).alias("__key"), "embedding")
    widths = broadcast_if_small(stage(
        fitted.groupBy(F.col("split").alias("__split")).agg(F.max(F.size("embedding")).alias("__width")), "widths"))
    joined = (plain.join(vectors, plain[key] == F.col("__key"), "left")
              .join(widths, field == F.col("__split"), "left"))
    zero = F.array_repeat(F.lit(0.0), F.coalesce("__width", F.lit(0)))
    return joined.withColumn("embedding", F.coalesce("embedding", zero)).select(*plain.columns, "embedding")


def vectorize_per_split(records: DataFrame, split: str, backend: str = "hash", key: str = "seq",
                        dims: int | None = None) -> DataFrame:
    """Embeddings fitted inside every value of the ``split`` column.

    Hash vectors do not depend on the split. TF-IDF keeps a vocabulary and a
    basis per value; all values are fitted by the same passes over the data,
    in groups whose bases fit in memory together.
    """
    if backend != "tfidf":
        return vectorize(records, backend, key, dims)
    return _fitted(records.drop("embedding"), key, dims or S.SVD_DIMS, split)
