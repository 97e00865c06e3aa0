"""Running a stream over everything that has landed, with a checkpoint in the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Files below ``path`` as a stream with the table's schema."""
    return spark.readStream.schema(like.schema).parquet(path)


def utc_events(events: DataFrame) -> DataFrame:
    """Event time as an instant; the tables hold UTC wall clocks."""
    return events.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def add_to_table(stream: DataFrame, path: str, partition_by: list[str]) -> DataFrame:
    """Drain what has landed since the last call into a partitioned table; each batch counts exactly once."""
    query = (stream.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by)
             .option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain(stream: DataFrame, handle, checkpoint: str) -> None:
    """Drain a stream batch by batch; a later call goes on from the same checkpoint."""
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


#: Keyed state on the executors' disks; a batch commits its changes, not a snapshot of everything.
STATE_SETTINGS = {STATE_PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


PARTITIONS = "spark.sql.shuffle.partitions"


def state_partitions(spark: SparkSession) -> int:
    """Partitions of keyed state: one per core, where the session asks for more.

    Adaptive execution does not join the small partitions of a stream.  Each one of each keyed operator loads and commits a store, and
    starts a Python worker where the operator is one, in every batch, whether it holds a row or not.
    """
    return min(int(spark.conf.get(PARTITIONS)), max(spark.sparkContext.defaultParallelism, 8))


class with_rocksdb:
    """The state settings while the stream is running."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        settings = STATE_SETTINGS | {PARTITIONS: str(state_partitions(self.spark))}
        self.before = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
