"""Minimax contiguous partition of atomic groups into shards, in DataFrame and SQL functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# Ordered places that groups are hashed to; at least a thousand for each shard.
ATOMS = 1 << 16
# Rows of one place that one task may number on its own, or twice the mean if that is more.
PIECE_ROWS = 512


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (none for null) and 16 more for its row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def plan_cuts(sizes: DataFrame, n_shards: int) -> tuple[list[int], list[int]]:
    """Places that fill a shard alone, and the first place of each later shard.

    ``sizes`` has one row (atom, size) per place, a bounded number. A place no
    smaller than an even share of what is left gets a shard of its own. For
    the others the smallest feasible capacity is searched by bisection; each
    trial fills shards greedily in the order of the places. Under that
    capacity the places are cut where an even share ends, as near as the
    capacity and the room left for the rest allow. All in one SQL row; only
    the cuts, fewer than the shards, come back.
    """
    rows = sizes.agg(F.array_sort(F.collect_list(F.struct("atom", "size"))).alias("all"))
    alone = rows.selectExpr(
        "all", f"""aggregate(slice(reverse(array_sort(transform(all, x -> struct(x.size, x.atom)))), 1, {n_shards - 1}),
            named_struct('rest', aggregate(all, 0L, (t, x) -> t + x.size), 'left', {n_shards},
                         'atoms', cast(array() AS array<bigint>)),
            (s, x) -> if(x.size > 0 AND x.size * s.left >= s.rest AND s.left > 1,
                         named_struct('rest', s.rest - x.size, 'left', s.left - 1,
                                      'atoms', concat(s.atoms, array(x.atom))), s)) AS top""")
    others = alone.selectExpr(
        "top.atoms AS alone", "top.left AS left", "top.rest AS rest",
        "filter(all, x -> NOT array_contains(top.atoms, x.atom)) AS line")
    bounds = others.selectExpr(
        "*", "aggregate(line, 0L, (m, x) -> greatest(m, x.size)) AS most")
    found = bounds.selectExpr(
        "*", """aggregate(sequence(1, 64),
            named_struct('lo', greatest(most, (rest + left - 1) div left),
                         'hi', (rest + left - 1) div left + most),
            (s, i) -> if(s.lo >= s.hi, s,
                if(aggregate(line, named_struct('n', 1, 'fill', 0L),
                       (a, x) -> if(a.fill + x.size > (s.lo + s.hi) div 2,
                                    named_struct('n', a.n + 1, 'fill', x.size),
                                    named_struct('n', a.n, 'fill', a.fill + x.size))).n <= left,
                   named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2),
                   named_struct('lo', (s.lo + s.hi) div 2 + 1, 'hi', s.hi)))).lo AS capacity""")
    # how much the last 1, 2, ... shards hold if filled from the end: earlier cuts than these are not feasible
    ended = found.selectExpr(
        "*", """aggregate(reverse(line), named_struct('fill', 0L, 'sum', 0L, 'marks', cast(array() AS array<bigint>)),
            (a, x) -> if(a.fill + x.size > capacity,
                named_struct('fill', x.size, 'sum', a.sum + x.size, 'marks', concat(a.marks, array(a.sum))),
                named_struct('fill', a.fill + x.size, 'sum', a.sum + x.size, 'marks', a.marks))).marks AS marks""")
    cut = ended.selectExpr(
        "alone", """aggregate(line, named_struct('fill', 0L, 'sum', 0L, 'i', 1, 'cuts', cast(array() AS array<bigint>)),
            (a, x) -> if(a.i < left AND (a.fill + x.size > capacity OR (
                    a.sum >= if(left - a.i <= size(marks), rest - element_at(marks, left - a.i), 0L)
                    AND abs(a.sum * left - rest * a.i) <= abs((a.sum + x.size) * left - rest * a.i))),
                named_struct('fill', x.size, 'sum', a.sum + x.size, 'i', a.i + 1, 'cuts', concat(a.cuts, array(x.atom))),
                named_struct('fill', a.fill + x.size, 'sum', a.sum + x.size, 'i', a.i, 'cuts', a.cuts))).cuts AS cuts""").first()
    return list(cut["alone"] or []), list(cut["cuts"] or [])


def _atom(group: list[str], atoms: int) -> Column:
    return F.pmod(F.xxhash64(*group), F.lit(atoms))


def shard(docs: DataFrame, n_shards: int = 40, group: list[str] = ("text",), size: Column | None = None,
          order: list[str] = ("doc_id",), atoms: int = ATOMS) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in the shard).

    Rows equal in ``group`` stay together: their hash gives one of ``atoms``
    ordered places, and shards are runs of places with the smallest possible
    largest size, so a shard differs from an even share by about one place, or
    by a group that is larger than a share itself. A slot is the number of
    rows in the places before it, plus its number among those of its own
    place; a place with very many rows is numbered in pieces dealt by
    ``order``. Null texts form one group, empty ones another; rows that repeat
    in every column get different slots in any order; an empty table gives an
    empty one. Columns named ``shard`` or ``slot`` are replaced.
    """
    group, order = list(group), list(order)
    atoms = max(atoms, 1024 * n_shards)
    size = text_size() if size is None else size
    placed = docs.select(_atom(group, atoms).alias("atom"), size.alias("size"))
    sizes = stage(placed.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("rows")),
                  "atoms")
    alone, cuts = plan_cuts(sizes, n_shards)

    def shard_of(atom: Column) -> Column:
        after = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c <= atom))
        place = F.array_position(F.lit(alone), atom) if alone else F.lit(0)
        return F.when(place > 0, place - 1).otherwise(len(alone) + after).cast("int")

    rows, used = sizes.agg(F.sum("rows"), F.count("*")).first()
    limit = max(PIECE_ROWS, 2 * (rows or 0) // max(used, 1))
    starts = sizes.select(
        "atom", shard_of(F.col("atom")).alias("__shard"),
        F.ceil(F.col("rows") / limit).alias("__pieces"),
        (F.sum("rows").over(Window.partitionBy(shard_of(F.col("atom"))).orderBy("atom")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
         - F.col("rows")).alias("__start"))
    # a row per place, so no more than ``atoms``
    starts = F.broadcast(stage(starts, "starts").withColumnRenamed("atom", "__atom"))
    piece = F.when(F.col("__pieces") > 1, F.pmod(F.xxhash64(*order), F.col("__pieces"))).otherwise(0)
    named = docs.withColumn("__atom", _atom(group, atoms)).drop("shard", "slot")
    dealt = named.join(starts, "__atom").withColumn("__piece", piece)
    if sizes.where(F.col("rows") > limit).isEmpty():
        dealt = dealt.withColumn("__before", F.lit(0))
    else:
        counts = stage(docs.select(_atom(group, atoms).alias("__atom"), *order)
                       .join(starts.where("__pieces > 1"), "__atom")
                       .groupBy("__atom", piece.alias("__piece")).count(), "pieces")
        inside = Window.partitionBy("__atom").orderBy("__piece").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        counts = counts.select("__atom", "__piece",
                               (F.sum("count").over(inside) - F.col("count")).alias("__before"))
        # pieces of crowded places: no more than half as many as places
        dealt = (dealt.join(F.broadcast(counts), ["__atom", "__piece"], "left")
                 .withColumn("__before", F.coalesce("__before", F.lit(0))))
    number = F.row_number().over(Window.partitionBy("__atom", "__piece").orderBy(
        F.xxhash64(*group), *order))
    return (dealt.withColumn("shard", F.col("__shard"))
            .withColumn("slot", (F.col("__start") + F.col("__before") + number - 1).cast("long"))
            .drop("__atom", "__shard", "__pieces", "__start", "__piece", "__before"))


def shard_digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Where every document goes, without its text."""
    kept = docs.select("doc_id", text_size().alias("size"),
                       F.crc32(F.col("text")).cast("long").alias("text_crc32"),
                       F.xxhash64("text").alias("text_hash"),
                       F.col("text").isNull().alias("no_text"))
    return shard(kept, n_shards, group=["text_hash", "no_text"], size=F.col("size"),
                 order=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
