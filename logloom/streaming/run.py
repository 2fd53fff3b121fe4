"""Running streams: an append table, or a table of the changed groups of an aggregate."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..session import scratch_path
from .store import GroupStore


def read_stream(spark: SparkSession, path: str, schema, form: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(form)
    if form != "text":
        reader = reader.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()


def land(stream: DataFrame, path: str | None = None, checkpoint: str | None = None,
         trigger: dict | None = None) -> DataFrame:
    """Append a stream to a Parquet table, exactly once, and return the table.

    With the default trigger it runs to the end of what is there. A longer
    lived query is started with ``trigger={"processingTime": ...}``; the table
    returned then grows while it runs.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "landed")
    checkpoint = checkpoint or scratch_path(spark, "checkpoint")
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", path).option("checkpointLocation", checkpoint)
             .trigger(**(trigger or {"availableNow": True})).start())
    if trigger is None:
        _finish(query)
    return spark.read.schema(stream.schema).parquet(path)


def keep_updates(aggregated: DataFrame, keys: list[str], path: str | None = None, checkpoint: str | None = None,
                 trigger: dict | None = None) -> str:
    """Run a streaming aggregate and keep every changed group; returns the folder.

    Each batch adds its changed groups, whole numbers so far, to a
    ``GroupStore``, where a repeated batch replaces itself. Groups that a
    watermark has let go of stay in the table: it is complete whatever the
    state still holds.
    """
    spark = aggregated.sparkSession
    path = path or scratch_path(spark, "updates")
    checkpoint = checkpoint or scratch_path(spark, "checkpoint")
    store = GroupStore(spark, path, keys)
    query = (aggregated.writeStream.outputMode("update").foreachBatch(store.write)
             .option("checkpointLocation", checkpoint)
             .trigger(**(trigger or {"availableNow": True})).start())
    if trigger is None:
        _finish(query)
    return path


def current_groups(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The last state of every group in a folder of updates."""
    return GroupStore(spark, path, keys).current(schema)


def run_groups(aggregated: DataFrame, keys: list[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All groups of a streaming aggregate once it has read what is there."""
    path = keep_updates(aggregated, keys, path, checkpoint)
    return current_groups(aggregated.sparkSession, path, StructType(list(aggregated.schema.fields)), keys)


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep the state of ``transformWithState`` operators,
    which only this provider can; a restart reads its own from its checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
