"""Sources, sinks and carried state for the streaming jobs."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as a stream; ``ts`` as an instant, so that it can carry a watermark."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def event_path(sf_dir: str) -> str:
    """As a pattern: the stream reader takes a single file only that way, and a folder as well."""
    return os.path.join(sf_dir, "events.parque[t]")


EPOCH_FILE_ROWS = 250_000


def file_epochs(df: DataFrame, part: str, epochs: int, path: str, file_rows: int = EPOCH_FILE_ROWS) -> DataFrame:
    """``df`` as a stream that takes the rows of ``part`` 0, 1 ... one number a trigger.

    The stream takes files in the order they were written, a fixed number a
    trigger. So every epoch is written as the same number of files, enough for
    the largest one; one with too few rows for that gets files without rows.
    """
    spark, rows = df.sparkSession, df.drop(part)
    largest = df.groupBy(part).count().agg(F.max("count")).first()[0] or 0
    files, known = max(1, -(-largest // file_rows)), 0
    nothing = spark.createDataFrame([], rows.schema).coalesce(1)
    for k in range(epochs):  # one after another
        one = df.where(F.col(part) == k).drop(part)
        (one.repartition(files) if files > 1 else one.coalesce(1)).write.mode("append").parquet(path)
        known += files
        while (found := len(spark.read.schema(rows.schema).parquet(path).inputFiles())) < known:
            nothing.write.mode("append").parquet(path)
        if found > known:
            raise RuntimeError(f"{found} files of {known} after epoch {k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ON_DISK = {
    STATE_STORE: ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # or every write reads first
}


def run_on_disk(spark: SparkSession, writer) -> None:
    """Run a query to its end; what its state holds is kept on disk, not in the executors' memory."""
    before = {name: spark.conf.get(name, None) for name in ON_DISK}
    for name, value in ON_DISK.items():
        spark.conf.set(name, value)
    try:
        query = writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()


def drain(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Run an append-mode query until its source is used up; return what it wrote.

    The file sink commits per trigger, so a restart from the checkpoint
    neither loses nor repeats rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", path + "/_state").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(path + "/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(path + "/rows")


def drain_latest(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an update-mode query; return the last row written per key."""
    spark = df.sparkSession
    path = scratch_path(spark, label)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    query = df.writeStream.outputMode("update").option("checkpointLocation", path + "/_state").trigger(availableNow=True)
    query.foreachBatch(write).start().awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("epoch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path + "/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "epoch").alias("r"))
    return last.select(*keys, "r.*")


Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def drain_with_carry(
    stream: DataFrame, label: str, state_schema: str, out_schema: str, step: Step, finish: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Order-dependent streaming with a small carried table.

    A keyed state function would process all rows of a hot session in one
    task. Here each micro-batch is an ordinary distributed job:
    ``step(batch, carried)`` returns output rows and the new carried table
    (one row per key). Both are written under the epoch number with
    overwrite, and epoch n reads the table of epoch n - 1, so a repeated
    epoch after a failure gives the same files. ``finish`` turns what is
    still carried at the end of the stream into output rows.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    last = [-1]

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        if epoch == 0:
            carried = session.createDataFrame([], state_schema)
        else:
            carried = session.read.schema(state_schema).parquet(f"{path}/carry/epoch={epoch - 1}")
        batch.persist()
        try:
            rows, after = step(batch, carried)
            rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
            after.write.mode("overwrite").parquet(f"{path}/carry/epoch={epoch}")
            last[0] = epoch
        finally:
            batch.unpersist()

    query = stream.writeStream.option("checkpointLocation", path + "/_state").trigger(availableNow=True)
    query.foreachBatch(write).start().awaitTermination()
    if last[0] < 0:  # nothing has come
        return spark.createDataFrame([], out_schema)
    rows = spark.read.schema(out_schema).option("recursiveFileLookup", "true").parquet(path + "/rows")
    if finish is None:
        return rows
    return rows.unionByName(finish(spark.read.schema(state_schema).parquet(f"{path}/carry/epoch={last[0]}")))
