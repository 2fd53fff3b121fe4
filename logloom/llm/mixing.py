"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, discard, stage
from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
# Parts that a stretch of a source's permuted order is cut in, level by level, to find where
# its last copy ends: no source has more sums than that.
BINS = 1 << 12
LEVELS = 2
# Quotas are kept for so many strata of sources; up to that number each source is its own.
STRATA = 4096


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def place(doc_id: str = "doc_id", seed: int = 0) -> Column:
    """A document's place in [0, 1) of its source's permuted order, from 52 bits of a hash."""
    text = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source with its target: weights by code point order, nulls last, repeating.

    A source whose share is above ``most`` times its size stops there and the
    rest is shared again by weight, until none is above. ``sources`` has a row
    (source, source_size, ...) per source; each round is one aggregate of it.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = F.lit([float(w) for w in weights])
    ranked = stage(sources.withColumn("rank", rank).withColumn(
        "weight", F.element_at(kinds, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))),
        "sources")
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * float(most) < F.col("weight") * level
        n, fixed, weight = ranked.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or weight == 0:
            break
        capped, level = n, (total - float(fixed)) / weight
    return ranked.withColumn("target", F.least(F.col("source_size") * float(most), F.col("weight") * level))


def split_quotas(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact quota of each shard for each stratum's blocks.

    A node holds the blocks of a run of shards; its left half draws its share
    of them without replacement, and what remains is the right half's.
    """
    out = np.zeros((len(blocks), shards), dtype=np.int64)
    nodes = [(0, shards, blocks.astype(np.int64))]
    while nodes:
        lo, hi, own = nodes.pop()
        if hi - lo == 1:
            out[:, lo] = own
            continue
        mid = (lo + hi) // 2
        take = int(own.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(own, take, method="marginals") if take else own * 0
        nodes += [(mid, hi, own - left), (lo, mid, left)]
    return out


def mix_plan(docs: DataFrame, shards: int = 64, block_words: int | None = None, seed: int = 0,
             weights=WEIGHTS, most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """(documents, sources) of the mix.

    ``documents``: a staged row (doc_id, source, size, u) per document.
    ``sources``: per source its size, target, whole copies ``base``, end
    ``cut`` of the last part copy, and ``quota``, the running number of its
    stratum's blocks over the shards.

    A source's mix is its permuted order, run through ``base`` times and then
    up to ``cut``, where the running size comes nearest to the target. Running
    sizes come from sums over BINS bins, then over BINS parts of the one bin
    that the end falls in, then over the rows of that part. The order is cut into blocks of about ``block_words`` words
    (by default 64 per shard) whose numbers per shard the splitting tree draws.
    """
    rows = stage(docs.select("doc_id", "source", word_count().alias("size"), place(seed=seed).alias("u")),
                 "mix")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per_source = (per_source.withColumn("base", base.cast("long"))
                  .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")))
    same = F.col("source").eqNullSafe(F.col("s"))
    ends = stage(_ends(rows, per_source, same), "ends")
    total = float(per_source.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    words = block_words or max(1.0, total / (shards * 64))
    stratum = F.pmod(F.col("rank"), F.lit(STRATA)).cast("int")
    planned = (per_source.withColumn("stratum", stratum)
               .join(broadcast_if_small(ends), same, "left").drop("s")
               .withColumn("cut", F.coalesce("cut", F.lit(0.0))))
    counts = (planned.groupBy("stratum")
              .agg(F.greatest(F.lit(1), F.round(F.sum("target") / words)).cast("long").alias("n"))
              .orderBy("stratum").collect())  # no more than STRATA rows
    quota = split_quotas(np.array([r["n"] for r in counts], dtype=np.int64), shards,
                         np.random.default_rng(seed)).cumsum(axis=1)
    spark = docs.sparkSession
    quotas = spark.createDataFrame([(int(r["stratum"]), int(r["n"]), [int(x) for x in q])
                                    for r, q in zip(counts, quota)], "stratum int, blocks long, quota array<long>")
    sources = stage(planned.join(F.broadcast(quotas), "stratum"), "mixplan")
    return rows, sources


def _ends(rows: DataFrame, per_source: DataFrame, same: Column) -> DataFrame:
    """(s, cut) for each source: the part copy takes the documents with u below ``cut``."""
    edge = per_source.where("rest > 0").select(
        F.col("source").alias("s"), "rest", F.lit(0.0).alias("lo"), F.lit(0).cast("long").alias("had"))
    width = 1.0
    for _ in range(LEVELS):
        edge = broadcast_if_small(stage(edge, "edges"))
        bin_of = F.floor((F.col("u") - F.col("lo")) * (BINS / width))
        inside = rows.join(edge, same & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("lo") + width))
        binned = inside.groupBy("s", "rest", "lo", "had", bin_of.alias("bin")).agg(F.sum("size").alias("in_bin"))
        up_to = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        running = binned.withColumn("upto", F.col("had") + F.sum("in_bin").over(up_to))
        width /= BINS
        edge = running.where("upto >= rest AND upto - in_bin < rest").select(
            "s", "rest", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("upto") - F.col("in_bin")).alias("had"))
    edge = broadcast_if_small(stage(edge, "edges"))
    near = rows.join(edge, same & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("lo") + width))
    by_u = near.groupBy("s", "u", "rest", "had").agg(F.sum("size").alias("size"))
    grown = by_u.withColumn("upto", F.col("had") + F.sum("size").over(
        Window.partitionBy("s").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)))
    crossing = grown.where("upto >= rest AND upto - size < rest")
    return crossing.select("s", F.when(
        F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size")),
        F.col("u") + F.lit(1 / (1 << 52))).otherwise(F.col("u")).alias("cut"))


def with_copies(docs: DataFrame, sources: DataFrame, u: Column) -> DataFrame:
    """``docs`` with the plan of its source and ``copies``, how often the mix takes it."""
    plan = sources.select(F.col("source").alias("__source"), "source_size", "target", "base", "cut",
                          "blocks", "quota")
    joined = docs.withColumn("__u", u).join(
        broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return joined.withColumn("copies", (F.col("base") + (F.col("__u") < F.col("cut")).cast("int")).cast("int"))


def shard_of_copy(copy: Column) -> Column:
    """Output shard of one copy: that whose quota holds the block of its place in the mix."""
    x = (copy + F.col("__u")) * F.col("source_size") / F.col("target")
    block = F.least(F.floor(x * F.col("blocks")), F.col("blocks") - 1)
    return F.size(F.filter("quota", lambda q: q <= block)).cast("int")


PLAN_COLUMNS = ["source_size", "target", "base", "cut", "blocks", "quota", "__u", "copies"]


def mix(docs: DataFrame, shards: int = 64, seed: int = 0, **options) -> DataFrame:
    """The mixed corpus: every column of ``docs``, one row per copy, dealt to
    ``shards`` partitions by quota and shuffled inside each.

    Null and empty texts have no words, count for nothing and are taken as
    often as their place says. Rows that share an id share a place. A source
    without any word has the target 0 and is not taken. The columns of the
    plan never reach the result; input columns of those names must be renamed.
    """
    _, sources = mix_plan(docs, shards, seed=seed, **options)
    taken = with_copies(docs, sources, place(seed=seed)).where("copies > 0")
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = copies.withColumn("__shard", shard_of_copy(F.col("__copy")))
    return (dealt.select(*docs.columns, "__copy", "__shard")
            .repartitionById(shards, F.col("__shard"))
            .sortWithinPartitions("__shard", F.xxhash64("doc_id", "__copy", F.lit(seed)))
            .select(*docs.columns))


def mix_digest(docs: DataFrame, shards: int = 64, seed: int = 0) -> DataFrame:
    """How many words of each document the mix takes, and to which shards they go."""
    rows, sources = mix_plan(docs, shards, seed=seed)
    planned = with_copies(rows, sources, F.col("u"))
    where = F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), shard_of_copy)).otherwise(
        F.array().cast("array<int>"))
    return planned.select("doc_id", "size", "source_size", "target",
                          (F.col("size") * F.col("copies")).alias("taken"), "copies", where.alias("shards"))
