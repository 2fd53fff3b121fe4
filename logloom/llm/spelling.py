"""Spelling variants: words one edit apart, and the frequent word that each is a form of."""
from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

LEAST_CHARS = 6
LEAST_COUNT = 5
# A word is a form of one that occurs so many times as often.
TIMES = 5
# One occurrence in so many loses a character, chosen by a hash of document and word.
DROP = 199
# Numbers that a task holds before it hands them on.
HELD = 500_000
# Words of one range of a trie, ranges of one trie, and words looked at per range to cut it.
RANGE_WORDS = 1 << 15
RANGES = 4096
LOOKED_AT = 20
# Bits of a number that count nodes or words inside a range.
INSIDE = 40


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS,
                least_count: int = LEAST_COUNT, drop: int | None = DROP) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least so many characters and occurrences.

    If ``drop`` divides the CRC-32 of ``<doc_id>:<run>``, the run's occurrences
    in that document lose the character at that number modulo its length.
    Null ids and texts are empty. Tasks count HELD different words at a time.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")   # shorter runs are never results

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").cast(pa.binary())):
                found = Counter(run.findall(text.as_py().lower().decode()))
                if drop is not None:
                    start = zlib.crc32(f"{name}:".encode())
                    for word in list(found):
                        h = zlib.crc32(word.encode(), start)
                        if h % drop == 0:
                            n, k = found.pop(word), h % len(word)
                            held[word[:k] + word[k + 1:]] += n
                held.update(found)
                if len(held) > HELD:
                    yield rows()
        yield rows()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((doc_id, "name"), (text, "text"))])
    return (read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.char_length("word") >= least_chars) & (F.col("n") >= least_count)))


def trie_nodes(words: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` with ``nodes``, the numbers of the trie nodes on the path of
    ``key`` from the root on, and ``number``, which grows with ``key``.

    Words are dealt to ranges of their order, each sorted and numbered in one
    pass that holds one path. A node that two ranges share lies on the path of
    the bound between them; the trie of the bounds is numbered beforehand, and
    every range numbers the nodes below it. ``words`` must be staged.
    """
    spark = words.sparkSession
    n = words.count()
    ranges = min(RANGES, ceil(n / RANGE_WORDS)) or 1
    bounds = []
    if ranges > 1:   # at most RANGES * LOOKED_AT words, give or take
        looked = sorted(r[0] for r in words.select(key).sample(min(1.0, ranges * LOOKED_AT / n), seed=7).collect())
        bounds = sorted({looked[len(looked) * i // ranges] for i in range(1, ranges)}) if looked else []
    upper, root = {}, 0
    for bound in bounds:
        at = root
        for c in bound:
            at = upper.setdefault((at, c), len(upper) + 1)
    sent = spark.sparkContext.broadcast((bounds, upper))

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        cuts = sent.value[0]
        return pa.array([bisect_right(cuts, k) for k in keys.to_pylist()], pa.int32())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = sent.value[1]
        last, path, here, made, seen = "", [root], None, 0, 0
        for batch in batches:
            nodes, numbers = [], []
            for where, word in zip(batch.column("range").to_pylist(), batch.column(key).to_pylist()):
                if where != here:
                    last, path, here, made, seen = "", [root], where, 0, 0
                same, most = 0, min(len(last), len(word))
                while same < most and last[same] == word[same]:
                    same += 1
                del path[same + 1:]
                for c in word[same:]:
                    node = shared.get((path[-1], c))
                    if node is None:
                        made += 1
                        node = ((where + 1) << INSIDE) + made
                    path.append(node)
                nodes.append(list(path))
                numbers.append((where << INSIDE) + seen)
                seen, last = seen + 1, word
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes, pa.list_(pa.int64())), pa.array(numbers, pa.int64())],
                                             names=[*columns, "nodes", "number"])

    kinds = dict(words.dtypes)
    shape = ", ".join([*[f"{c} {kinds[c]}" for c in columns], "nodes array<long>", "number long"])
    dealt = words.withColumn("range", range_of(key)).repartitionById(ranges, F.col("range"))
    return dealt.sortWithinPartitions("range", key).mapInArrow(number, shape)


def pair_dictionary(placed: DataFrame) -> DataFrame:
    """Entries (prefix, suffix, gap, first, word, n) of words with their nodes.

    With its character i left out a word stands at (node before i, node after
    i); unshortened it stands between any two characters as a ``gap``. Words
    that share an entry's two nodes are one edit apart. ``first`` marks the
    first of the equal shortened forms that a run of one character gives.
    """
    length = F.size("chars")
    skipped = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.get("prefix", i).alias("prefix"), F.get("suffix", length - 1 - i).alias("suffix"), F.lit(False).alias("gap"),
        (~F.get("chars", i).eqNullSafe(F.get("chars", i - 1))).alias("first")))
    between = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.get("prefix", i).alias("prefix"), F.get("suffix", length - i).alias("suffix"), F.lit(True).alias("gap"), F.lit(True).alias("first")))
    return (placed.withColumn("chars", F.split("word", ""))
            .select("number", "n", F.explode(F.concat(skipped, between)).alias("e")).select("e.*", "number", "n"))


def near_numbers(entries: DataFrame) -> DataFrame:
    """(number, n_near, best): how many words are one edit away, and the most frequent of them.

    The words at one entry differ in one character, so they are no more than
    there are letters, and one gap. Two words meet at one entry only, equal
    shortened forms aside. So neighbours are counted entry by entry, each
    member against the first two and the gap, without forming pairs.
    """
    best = F.struct((-F.col("n")).alias("less"), F.col("number").alias("number"))
    met = entries.groupBy("prefix", "suffix").agg(
        F.collect_list(F.when(~F.col("gap"), F.struct(best.alias("best"), "first"))).alias("skips"),
        F.min(F.when(F.col("gap"), best)).alias("gap"))
    met = met.where((F.size("skips") > 1) | ((F.size("skips") == 1) & F.col("gap").isNotNull()))
    met = met.withColumn("skips", F.sort_array("skips")).withColumn("firsts", F.filter("skips", lambda s: s["first"]))
    one, two = F.get("skips", F.lit(0))["best"], F.get("skips", F.lit(1))["best"]

    def of_skip(s: Column) -> Column:
        other = F.when(s["best"] == one, two).otherwise(one)
        gap = F.when(s["first"], F.col("gap"))
        return F.struct(s["best"]["number"].alias("number"), (F.size("skips") - 1 + gap.isNotNull().cast("int")).alias("near"),
                        F.least(other, gap).alias("best"))

    of_gap = F.struct(F.col("gap.number").alias("number"), F.size("firsts").alias("near"), F.get("firsts", F.lit(0))["best"].alias("best"))
    members = F.concat(F.transform("skips", of_skip), F.when(F.col("gap").isNull(), F.array().cast("array<struct<number:long,near:int,best:struct<less:long,number:long>>>"))
                       .otherwise(F.array(of_gap)))
    return (met.select(F.explode(members).alias("m")).select("m.*").where("near > 0")
            .groupBy("number").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))


def last_forms(forms: DataFrame, smallest: int, largest: int, times: int = TIMES) -> DataFrame:
    """(number, root): where following (number, form) ends. Every step
    multiplies the count, so the longest way is known; each round doubles the
    steps taken."""
    steps = int(log(max(largest, 1) / max(smallest, 1), times)) + 1
    ways = forms.select("number", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        on = ways.select(F.col("number").alias("root"), F.col("root").alias("further"))
        ways = stage(ways.join(on, "root", "left").select("number", F.coalesce("further", "root").alias("root")), "ways")
    return ways


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Neighbours of every word of a table (word, n) of distinct words.

    ``n_near``: words that differ by one inserted, deleted or replaced code
    point. ``form``, ``form_n``: the most frequent of them, on ties the
    smallest, if it occurs at least ``times`` as often as the word; else null.
    ``root``: where following forms ends, the word itself if it has none. All
    neighbours are found, whatever their number; an empty table gives no row.
    Null words are left out; an empty one is a word.
    """
    words = stage(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"),
                                                         F.reverse("word").alias("turned")), "words")
    forward = stage(trie_nodes(words, "word", ["word", "n"]), "forward")
    backward = trie_nodes(words, "turned", ["word"]).select("word", F.col("nodes").alias("suffix"))
    placed = forward.withColumnRenamed("nodes", "prefix").join(backward, "word")
    near = stage(near_numbers(pair_dictionary(placed)), "near")
    names = forward.select("number", "word", "n")
    judged = stage(names.join(near, "number", "left").select(
        "number", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")), "judged")
    forms = judged.where("best IS NOT NULL").select("number", F.col("best.number").alias("form"))
    smallest, largest = judged.agg(F.coalesce(F.min("n"), F.lit(1)), F.coalesce(F.max("n"), F.lit(1))).first()
    roots = last_forms(forms, smallest, largest, times)
    named = names.select(F.col("number").alias("form_number"), F.col("word").alias("form"))
    ends = names.select(F.col("number").alias("root_number"), F.col("word").alias("end"))
    formed = (judged.where("best IS NOT NULL").join(roots.withColumnRenamed("root", "root_number"), "number")
              .withColumn("form_number", F.col("best.number")).join(named, "form_number").join(ends, "root_number")
              .select("word", "form", F.col("end").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n")))
    alone = judged.where("best IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"),
                                                "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return formed.unionByName(alone)


def variant_digest(docs: DataFrame) -> DataFrame:
    """The variants among all words of whole documents."""
    return variants(word_counts(docs)).select("word", "form", "root", "n", "n_near", "form_n")
