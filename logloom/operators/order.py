"""First-seen order, ranks and ordinals without a global sort."""
from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage

# Rows one task may number on its own.
ROWS_PER_TASK = 200_000
# Parts that a group is cut in before its first rows are taken, if these are many.
PARTS = 64


def first_row(order: str = "seq", columns: list[str] = ()) -> Column:
    """Aggregate: the struct of ``columns`` from the earliest row."""
    return F.min_by(F.struct(*columns), F.col(order))


def group_profile(df: DataFrame, group: str, fields: list[str], order: str = "seq") -> DataFrame:
    """Per group: size, first row, and the most frequent value of each field,
    the first seen on ties.

    One pass over the rows. Both steps combine on the map side, so a group
    with most of the rows reaches the reducers as one row per task and value.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).alias("value"))
                      for i, f in enumerate(fields)])
    counted = (df.select(group, order, F.explode(pairs).alias("p"))
               .groupBy(group, "p.field", "p.value")
               .agg(F.count("*").alias("n"), F.min(order).alias("first")))
    # every row counts once in the first field
    whole = F.col("field") == 0
    return counted.groupBy(group).agg(
        F.sum(F.when(whole, F.col("n"))).alias("count"),
        F.min(F.when(whole, F.col("first"))).alias("first_seq"),
        *[F.max_by("value", F.when(F.col("field") == i, F.struct("n", -F.col("first")))).alias(f)
          for i, f in enumerate(fields)])


def explode_once(df: DataFrame, array: str, place: str | None = None) -> DataFrame:
    """One row per array element, the array computed once.

    A plain explode is planned with a filter on the array below it, which
    computes the array a second time; the outer form is not.
    """
    others = [c for c in df.columns if c != array]
    if place is None:
        out = df.select(*others, F.explode_outer(array).alias(array))
    else:
        out = df.select(*others, F.posexplode_outer(array).alias(place, array))
    return out.where(F.col(array).isNotNull())


def top_in_group(df: DataFrame, group: list[str], ordering: list[Column], n: int,
                 rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group; surplus rows drop before the shuffle.

    Up to its threshold the planner cuts ranks inside the tasks. For a larger
    ``n`` every group is first cut in PARTS parts, each by its own task, so
    that no task meets more of a group than that part or PARTS times ``n``.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
        inside = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*ordering))
        df = (df.withColumn("__part", part).withColumn("__inside", inside)
              .where(F.col("__inside") <= n).drop("__part", "__inside"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*ordering))
    return df.withColumn(rank, place).where(F.col(rank) <= n)


def ranked_in_group(df: DataFrame, group: list[str], ordering: list[Column], rank: str = "rank") -> DataFrame:
    """Every row with its dense rank from 1 in its group, however large that is.

    Rows are dealt to ranges of (group, order) at sampled quantiles and sorted
    there, so a group with most of the rows fills most of the ranges. The
    place in a range follows from the sorted rows; the sizes of a group's
    ranges before, one row per group and range, are added. This is the only
    shuffle of rows. Which of two rows that tie comes first is open.
    """
    keys = [F.col(g) for g in group]
    dealt = (df.repartitionByRange(*keys, *ordering).sortWithinPartitions(*keys, *ordering)
             .withColumn("__at", F.monotonically_increasing_id()))
    rows = stage(dealt, "ranges")
    part = F.shiftright("__at", 33).alias("__part")
    parts = rows.groupBy(*keys, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(g).alias(f"__group{i}") for i, g in enumerate(group)]
    shift = parts.select(*names, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    shift = broadcast_if_small(stage(shift, "shifts"))
    same = F.shiftright(rows["__at"], 33) == shift["__part"]
    for i, g in enumerate(group):
        same &= rows[g].eqNullSafe(shift[f"__group{i}"])
    others = [c for c in df.columns if c != rank]
    return rows.join(shift, same).select(*others, (F.col("__at") + F.col("__shift")).cast("int").alias(rank))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """All rows with a dense number from 0 in this order.

    Rows are dealt to sorted ranges once and numbered inside them; the sizes
    of the ranges before are added.
    """
    return _numbered(stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges"),
                     order, name)


def in_order(df: DataFrame, order: list[Column], name: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same; a table of no more than ``rows_per_task`` rows is numbered by one task."""
    rows = stage(df, "inorder")
    n = rows.count()
    if n <= rows_per_task:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    ranges = ceil(n / rows_per_task)
    cut = rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
    return _numbered(stage(cut, "ranges"), order, name)


def _numbered(cut: DataFrame, order: list[Column], name: str) -> DataFrame:
    sizes = cut.groupBy("__range").count()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    shift = F.broadcast(sizes.select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift")))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return (cut.withColumn("__place", inside).join(shift, "__range")
            .withColumn(name, F.col("__shift") + F.col("__place") - 1).drop("__range", "__place", "__shift"))


def with_ordinal(df: DataFrame, order: str, name: str) -> DataFrame:
    """Dense number from 0 in the order of a unique numeric column.

    Small tables are numbered by one task. Larger ones are cut at sampled
    quantiles of ``order``: rows are numbered inside their range and the
    ranges shifted by the sizes of those before.
    """
    rows = stage(df, "ordinal")
    ranges = ceil(rows.count() / ROWS_PER_TASK)
    if ranges <= 1:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(order)).cast("long") - 1)
    cuts = sorted(set(rows.approxQuantile(
        order, [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    bounds = F.lit([int(c) for c in cuts])
    cut = rows.withColumn("__range", F.size(F.filter(bounds, lambda b: b <= F.col(order))))
    sizes = cut.groupBy("__range").count()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    # at most one row per range
    return (cut.withColumn("__place", inside)
            .join(F.broadcast(shift), "__range")
            .withColumn(name, F.col("__shift") + F.col("__place") - 1)
            .drop("__range", "__place", "__shift"))
