"""Running a stream over what has arrived, and the tables read as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tallyroll.tables import BASE_TABLES, Tables

# How much one micro-batch reads, so that a backlog is worked off in pieces.
BYTES_PER_TRIGGER = str(10 * 1024**3)
FAR = "9000-01-01 00:00:00"


class StreamTables(Tables):
    """The same logical tables with every base table read as a stream."""

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES and name not in self._made:
            schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
            reader = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
            # The bracket makes it a pattern, which takes a single file as well as a folder.
            self._made[name] = reader.parquet(f"{self.folder}/{name}.parque[t]")
        return super().__getattr__(name)


def with_clock(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and a second one of clock ticks from ``folder``: rows that hold a time and nothing else.

    A tick moves the watermark on while no data come. Its own windows lie after it and stay open.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/clock")
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{folder}/clock"))


def tick(stream: DataFrame, time: str, folder: str) -> None:
    """A tick after all data: every window and session that is still open ends."""
    spark, kinds = stream.sparkSession, dict(stream.dtypes)
    row = [F.lit(FAR if c == time else None).cast(kinds[c]).alias(c) for c in stream.columns]
    spark.range(1).select(*row).write.mode("append").parquet(f"{folder}/clock")


# Partitions of state for each core; a checkpoint keeps the number it began with.
STORES_PER_CORE = 4
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare_state(stream: DataFrame) -> None:
    """State on local disk with a change log in the checkpoint, so it may outgrow the memory."""
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def to_parquet(stream: DataFrame, folder: str, then: Callable[[], None] | None = None) -> DataFrame:
    """Process what is there, exactly once, and give the written result as a batch frame.

    ``then`` may make more arrive, such as a clock tick, which the same query processes next.
    """
    prepare_state(stream)
    conf = stream.sparkSession.conf
    parts = conf.get("spark.sql.shuffle.partitions")
    # Every batch opens, saves and closes a store per partition and operator, which is most of its time in small ones.
    stores = min(int(parts), STORES_PER_CORE * stream.sparkSession.sparkContext.defaultParallelism)

    def run() -> None:
        conf.set("spark.sql.shuffle.partitions", str(stores))
        try:
            query = (
                stream.writeStream.format("parquet")
                .option("path", f"{folder}/out")
                .option("checkpointLocation", f"{folder}/checkpoint")
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
        finally:
            conf.set("spark.sql.shuffle.partitions", parts)
        query.awaitTermination()

    run()
    if then:
        then()
        run()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def for_each_batch(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process what is there with ``handle(batch, batch_id)``.

    A batch can run again after a failure, so handlers write to a place named by the batch id.
    """
    (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
