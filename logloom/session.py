"""Session settings, shared scratch tables and size-checked broadcasts."""
from __future__ import annotations

import atexit
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from math import ceil

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after it was measured and found no larger.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Rows that a piece of a spread table may have.
PIECE_ROWS = 200_000


def configure(spark: SparkSession) -> SparkSession:
    """Times are local-free: every operator assumes a UTC session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset (tests on one machine) a temporary folder is used;
    on a cluster a machine-local folder would lose data with its executor, so
    there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_home(spark: SparkSession) -> str:
    """The application's own scratch folder, removed when its Python ends."""
    home = f"{scratch_root(spark)}/logloom/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_remove_at_exit, spark, home)
    return home


_HOMES: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_home(spark)}/{name}-{uuid.uuid4().hex}"
    for opened in _OPEN:
        opened.append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage and freezes order-dependent columns, so lost executors
    re-read files and never recompute a different answer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            remove_path(df.sparkSession, path)


def _remove_at_exit(spark: SparkSession, home: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove_path(spark, home)
    except Exception:  # the session has gone, and with it the way to the folder
        pass


_OPEN: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete everything staged inside the block when it ends.

    Results that are still to be read must be written out within the block.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            remove_path(spark, path)


def stage_all(**tables: DataFrame) -> dict[str, DataFrame]:
    """Stage and measure independent tables at the same time, so that the last
    tasks of one do not leave the cluster idle."""
    spark = next(iter(tables.values())).sparkSession

    @inheritable_thread_target(spark)
    def one(item):
        return broadcast_if_small(stage(item[1], item[0]))

    with ThreadPoolExecutor(len(tables)) as pool:
        return dict(zip(tables, pool.map(one, tables.items())))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast after measuring rows and bytes.

    A larger table is left to a shuffled join, where adaptive execution splits
    hot keys. Give it a staged table: its count comes from the file footers,
    and only a table of few rows is read for its bytes.
    """
    if df.count() > BROADCAST_ROWS:
        return df
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def join_flag(df: DataFrame, flagged: DataFrame, keys: list[str], flag: str,
              staged: bool = False) -> DataFrame:
    """Add boolean ``flag``: whether the row's keys are in ``flagged``.

    Null keys equal null keys. The flagged table is staged and counted, so the
    wide side is not shuffled unless the flagged set is truly large. Pass
    ``staged`` for a staged and measured table whose keys are unique.
    """
    marks = flagged.select(*[F.col(k).alias(f"__{k}") for k in keys])
    marks = marks if staged else broadcast_if_small(stage(marks.distinct(), flag))
    marks = marks.withColumn("__hit", F.lit(True))
    match = None
    for k in keys:
        same = df[k].eqNullSafe(marks[f"__{k}"])
        match = same if match is None else match & same
    return (df.join(marks, match, "left")
              .withColumn(flag, F.coalesce("__hit", F.lit(False)))
              .drop("__hit", *[f"__{k}" for k in keys]))


def spread(scan: DataFrame) -> DataFrame:
    """A table spread evenly over all cores, no piece much above PIECE_ROWS rows.

    For per-row work that outweighs one copy of a table. Give it a plain scan:
    its rows per piece come from the file footers. A file of few row groups is
    cut into many pieces of which most are empty, so pieces alone say little.
    A table whose pieces are even and small enough passes unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in scan.groupBy(F.spark_partition_id().alias("piece")).count().collect()]  # one row per piece
    fullest, rows = max(sizes, default=0), sum(sizes)
    if len(sizes) >= cores and fullest <= PIECE_ROWS and fullest * cores <= 2 * rows:
        return scan
    return scan.repartition(max(cores, ceil(rows / PIECE_ROWS)))
