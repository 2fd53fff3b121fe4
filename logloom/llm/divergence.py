"""How far the term distributions of sources lie apart, and the terms that set a source off from its language."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered, top_in_group
from ..session import broadcast_if_small, stage
from .transducer import Transducer

# Runs of letters and of anything beyond ASCII, in lower-cased UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCS = 10
TOP_TERMS = 10
# Probabilities are whole parts of this.
UNIT = 1_000_000_000
# Counts up to this, times UNIT, fit a long.
LONG_COUNT = (1 << 63) // UNIT - 3
# Terms of one transducer.
BLOCK_TERMS = 1 << 14
# Bytes of transducers sent to the tasks at once; beyond, the texts are read again for the next ones.
SENT_BYTES = 64 << 20
# Counts that a task holds before it hands them on, and tokens that it looks up together.
HELD = 500_000
STEP_TOKENS = 1 << 17
# Sources and terms of one piece of the comparison of sources.
TILE = 64
PIECE_TERMS = 512


def plain(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The three columns read, nulls as empty text."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for name, c in (("lang", lang), ("source", source), ("text", text))])


def _terms(texts: pa.Array) -> Iterator[list[bytes]]:
    for text in texts.cast(pa.binary()):
        yield TERM.findall(text.as_py().lower())


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of terms in at least so many documents of a language.
    Documents are counted in the tasks, HELD numbers at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, terms in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                                                  pa.array(list(terms.values()), pa.int64())], names=["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, terms in zip(batch.column("lang").to_pylist(), _terms(batch.column("text"))):
                held.setdefault(lang, Counter()).update(set(terms))
            if sum(map(len, held.values())) > HELD:
                yield from rows()
        yield from rows()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term")


def vocabulary(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, ord): the kept terms with their ordinal, from 0, in the byte order of the language's terms."""
    placed = stage(numbered(kept_terms(docs, least_docs), [F.col("lang"), F.col("term")], "place"), "terms")
    first = placed.groupBy("lang").agg(F.min("place").alias("first")).withColumnRenamed("lang", "__lang")
    first = broadcast_if_small(stage(first, "langs"))
    return placed.join(first, F.col("lang") == F.col("__lang")).select("lang", "term", (F.col("place") - F.col("first")).alias("ord"))


def transducers(terms: DataFrame) -> DataFrame:
    """One row per language and BLOCK_TERMS terms: first ordinal, first term, and their transducer."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("ord")
        words = group.column("term").cast(pa.binary()).to_pylist()
        made = Transducer.build(words).to_bytes()
        return pa.table({"lang": group.column("lang").slice(0, 1), "first": group.column("ord").slice(0, 1),
                         "term": pa.array([words[0]], pa.binary()), "made": pa.array([made], pa.binary())})

    block = F.floor(F.col("ord") / BLOCK_TERMS)
    return (terms.withColumn("block", block).groupBy("lang", "block")
            .applyInArrow(build, "lang string, first long, term binary, made binary"))


class Lookup:
    """Transducers of several languages and ranges of terms."""

    def __init__(self, rows: list):
        self.of: dict[str, list] = {}
        for lang, first, term, made in sorted(rows, key=lambda r: (r[0], r[1])):
            self.of.setdefault(lang, []).append((first, term, Transducer.from_bytes(made)))

    def ordinals(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Ordinals among the language's terms; -1 for others."""
        found = np.full(len(words), -1, np.int64)
        parts = self.of.get(lang, [])
        if len(parts) == 1:
            near = np.zeros(len(words), np.int64)
        else:
            near = np.searchsorted(np.array([p[1] for p in parts] + [None], object)[:-1], np.array(words + [None], object)[:-1], "right") - 1
        for i, (first, _, made) in enumerate(parts):
            at = np.flatnonzero(near == i)
            got = made.ordinals([words[k] for k in at])
            found[at] = np.where(got < 0, -1, got + first)
        return found


def recount(docs: DataFrame, made: DataFrame) -> DataFrame:
    """(lang, source, ord, n): occurrences of kept terms, by streaming the texts
    through the transducers. These are sent at most SENT_BYTES at a time; a
    larger vocabulary takes one pass over the texts per such part."""
    spark = docs.sparkSession
    sizes = sorted(made.select("lang", "first", F.octet_length("made").alias("size")).collect())
    passes, used = [], SENT_BYTES
    for lang, first, size in sizes:   # one row per transducer
        if used + size > SENT_BYTES:
            passes.append([])
            used = 0
        passes[-1].append((lang, first))
        used += size
    kind = "lang string, source string, ord long, n long"
    if not passes:
        return spark.createDataFrame([], kind)
    counted = None
    for part in passes:
        if len(passes) > 1:
            wanted = F.broadcast(spark.createDataFrame(part, "lang string, first long"))
            rows = made.join(wanted, ["lang", "first"]).select("lang", "first", "term", "made").collect()
        else:
            rows = made.select("lang", "first", "term", "made").collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])
        one = docs.mapInArrow(_counter(sent), kind)
        counted = one if counted is None else counted.unionByName(one)
    return counted.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def _counter(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(sent.value)
        groups: dict[tuple[str, str], int] = {}
        keys, numbers = [], []

        def squeeze() -> None:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, back, np.concatenate(numbers))
            keys[:], numbers[:] = [key], [total]

        def rows() -> pa.RecordBatch:
            names = list(groups)
            group = keys[0] >> 40
            lang, source = [pa.array([g[i] for g in names], pa.string()).take(pa.array(group)) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays([lang, source, pa.array(keys[0] & ((1 << 40) - 1)), pa.array(numbers[0])],
                                             names=["lang", "source", "ord", "n"])
            keys.clear()
            numbers.clear()
            groups.clear()
            return out

        def tally(lang: str, words: list[bytes], group: list[int]) -> None:
            if not words:
                return
            coded = pa.array(words, pa.binary()).dictionary_encode()
            ordinal = look.ordinals(lang, coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            good = ordinal >= 0
            key, n = np.unique((np.array(group, np.int64)[good] << 40) | ordinal[good], return_counts=True)
            keys.append(key)
            numbers.append(n)

        for batch in batches:
            by_lang: dict[str, tuple[list, list]] = {}
            for lang, source, terms in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _terms(batch.column("text"))):
                words, group = by_lang.setdefault(lang, ([], []))
                words += terms
                group += [groups.setdefault((lang, source), len(groups))] * len(terms)
                if len(words) > STEP_TOKENS:
                    tally(lang, words, group)
                    words.clear()
                    group.clear()
            for lang, (words, group) in by_lang.items():
                tally(lang, words, group)
            if sum(map(len, keys)) > HELD:
                squeeze()
                if len(keys[0]) > HELD // 2:
                    yield rows()
        if keys:
            squeeze()
            yield rows()
    return count


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), in decimals wide enough for any count where a long is not."""
    over = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    wide = F.call_function("div", over, (total + 2 * kept).cast("decimal(20,0)"))
    narrow = F.call_function("div", F.lit(UNIT).cast("long") * (n + 2), total + 2 * kept)
    return 1 + F.when(n <= LONG_COUNT, narrow).otherwise(wide)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same of n[i, j] in whole[i], by long division in steps of 1,000."""
    if whole.max(initial=0) > (1 << 62) // 1000:
        n, whole = n.astype(object), whole.astype(object)
    rest, out = n + 2, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole[:, None]
        rest = rest % whole[:, None]
    return (out + 1).astype(np.int64)


def _lists(arrays: pa.ListArray, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's structs end, and their fields one after another; a null row has none."""
    ends = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(arrays), 0), np.int64))]
    flat = arrays.flatten()
    return ends, [np.asarray(pc.struct_field(flat, f), np.int64) for f in fields]


def _compare(width: np.ndarray, kept: np.ndarray, sides: list[tuple[pa.ListArray, pa.ListArray]]) -> list[np.ndarray]:
    """Sums of distances of all sources of one tile to all of another, per row."""
    read = [(_lists(members, "total"), _lists(entries, "i", "term", "n")) for members, entries in sides]
    out = []
    for i in range(len(width)):
        p = []
        for (members, (total,)), (ends, (place, term, count)) in read:
            total, own = total[members[i]:members[i + 1]], slice(ends[i], ends[i + 1])
            n = np.zeros((len(total), width[i]), np.int64)
            n[place[own], term[own]] = count[own]
            p.append(shares(n, total + 2 * kept[i]))
        a, b = p
        sums = np.zeros((len(a), len(b)), np.int64)
        for k in range(len(a)):
            sums[k] = ((a[k] - b) ** 2 // (a[k] + b)).sum(axis=1)
        out.append(sums.ravel())
    return out


def pair_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.

    A language's sources are cut in tiles and its terms in pieces. Each pair
    of tiles is compared piece by piece, both sides no larger than TILE by
    PIECE_TERMS counts, and the sums of the pieces are added.
    """
    placed = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    placed = stage(placed.withColumns({"tile": F.floor(F.col("at") / TILE), "i": F.col("at") % TILE}), "placed")
    tiles = stage(placed.groupBy("lang", "tile", "kept").agg(F.sort_array(F.collect_list(F.struct("i", "total", "source"))).alias("members")), "tiles")
    names = broadcast_if_small(placed.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "tile", "i"))
    entries = (counts.join(names, (F.col("lang") == F.col("__lang")) & (F.col("source") == F.col("__source")))
               .groupBy("lang", "tile", F.floor(F.col("ord") / PIECE_TERMS).alias("piece"))
               .agg(F.collect_list(F.struct("i", (F.col("ord") % PIECE_TERMS).alias("term"), "n")).alias("entries")))
    entries = stage(entries, "entries")
    # one row per two tiles of a language and piece of its terms; a language without terms has one empty piece
    other = tiles.select("lang", F.col("tile").alias("tile_b"), F.col("members").alias("members_b"))
    last = F.greatest(F.ceil(F.col("kept") / PIECE_TERMS) - 1, F.lit(0))
    grid = (tiles.join(other, "lang").where("tile <= tile_b")
            .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .withColumn("width", F.least(F.lit(PIECE_TERMS), F.col("kept") - F.col("piece") * PIECE_TERMS)))
    grid = (grid.join(entries, ["lang", "tile", "piece"], "left")
            .join(entries.select("lang", F.col("tile").alias("tile_b"), "piece", F.col("entries").alias("entries_b")),
                  ["lang", "tile_b", "piece"], "left"))

    @F.arrow_udf("array<long>")
    def compare(width: pa.Array, kept: pa.Array, a: pa.Array, ea: pa.Array, b: pa.Array, eb: pa.Array) -> pa.Array:
        sums = _compare(width.to_numpy(), kept.to_numpy(), [(a, ea), (b, eb)])
        ends = np.r_[0, np.cumsum([len(s) for s in sums])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sums)) if sums else pa.array([], pa.int64()))

    total = lambda c: F.transform(c, lambda m: F.struct(m["total"].alias("total")))
    compared = grid.withColumn("sums", compare("width", "kept", total("members"), "entries", total("members_b"), "entries_b"))
    wide = F.size("members_b")
    flat = (compared.select("lang", "tile", "tile_b", F.transform("members", lambda m: m["source"]).alias("a"),
                            F.transform("members_b", lambda m: m["source"]).alias("b"), wide.alias("wide"), F.posexplode("sums"))
            .select("lang", (F.col("tile") == F.col("tile_b")).alias("whole"), F.get("a", F.floor(F.col("pos") / F.col("wide")).cast("int")).alias("source"),
                    F.get("b", F.col("pos") % F.col("wide")).alias("item"), F.col("col").alias("value"))
            .where("source <> item"))
    summed = stage(flat.groupBy("lang", "source", "item", "whole").agg(F.sum("value").alias("value")), "pairs")
    turned = summed.where("NOT whole").select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return summed.select("lang", "source", "item", "value").unionByName(turned)


def telling_terms(counts: DataFrame, groups: DataFrame, terms: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): a source's terms of more than their language's share, the ``top`` first ones."""
    whole = groups.groupBy("lang", "kept").agg(F.sum("total").alias("all"))
    sized = groups.join(whole, ["lang", "kept"])
    sized = broadcast_if_small(stage(sized, "sized"))
    every = counts.groupBy("lang", "ord").agg(F.sum("n").alias("m"))
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("m"), F.col("all"), F.col("kept"))
    scored = (counts.join(every, ["lang", "ord"]).join(sized, ["lang", "source"])
              .select("lang", "source", "ord", p.alias("p"), q.alias("q")).where("p > q")
              .select("lang", "source", "ord", distance(F.col("p"), F.col("q")).alias("value")))
    first = stage(top_in_group(scored, ["lang", "source"], [F.desc("value"), F.col("ord")], top), "first")
    named = broadcast_if_small(first)
    return terms.join(named, ["lang", "ord"]).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Distances between the sources of each language (part ``pair``) and each source's telling terms (part ``term``).

    Null text, lang and source are empty text, which is a language or source
    like others. Repeated rows are documents of their own. A group without
    kept terms takes part with equal shares; a language without kept terms has
    distances of 0 and no terms. Ties go to the smaller name in byte order,
    for terms by their ordinal. An empty table gives no row.
    """
    docs = plain(docs, text, lang, source)
    terms = stage(vocabulary(docs, least_docs), "vocabulary")
    made = stage(transducers(terms), "transducers")
    counts = stage(recount(docs, made), "counts")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = stage(docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
                   .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_distances(counts, groups).withColumn("rank", place)
    columns = ["lang", "source", F.lit("pair").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")]
    telling = telling_terms(counts, groups, terms, top)
    return pairs.select(*columns).unionByName(telling.select(*columns[:2], F.lit("term").alias("part"), *columns[3:]))
