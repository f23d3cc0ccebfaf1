"""Append of a stream in files of a stated number of rows.

Rows of an epoch join what the epochs before left over; whole files are
written, the rest is carried on. An epoch owns its folders (rows, remainder,
log) and reads those of the epoch before, so a repeated epoch writes the same
again and changes nothing else. ``close`` writes the last, shorter file.

A batch is read three times (its number of rows, the files, the remainder), which is
cheap for files; a stream that is costly to compute should be persisted before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import digits_for, positions, prefix_of
from ..session import scratch_path

c = F.col
PART_ROWS = 1 << 17  # rows of the files that one task writes
# On a local disk Hadoop starts a process for each file it makes and one for its checksum file; Parquet's pages have checksums
# of their own. Other file systems are not touched by this.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
LOG = "epoch bigint, n_rows bigint, n_files bigint, left_over bigint"


class BufferedAppend:
    """Writes under ``path``; ``order`` is a unique md5-text column that fixes which rows share a file."""

    def __init__(self, path: str, schema, order: str, file_rows: int):
        self.path, self.schema, self.order, self.file_rows = path, schema, order, file_rows

    def _left_over(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/left/epoch={epoch}") if epoch >= 0 else spark.createDataFrame([], self.schema)

    def write(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``."""
        spark = batch.sparkSession
        names = self.schema.names
        rows = self._left_over(spark, epoch - 1).unionByName(batch.select(*names))
        n = rows.count()
        files = n // self.file_rows
        over = n - files * self.file_rows
        if files:
            placed = positions(rows, [], self.order, out="_place", start=0, bucket=prefix_of(self.order, digits_for(n)))
            # a task holds whole files only, in order, so the writer cuts them where they end; a task's files have a folder
            # of their own, which the commit moves as one
            per_task = max(1, PART_ROWS // self.file_rows)
            dealt = placed.withColumn("_file", F.floor(c("_place") / self.file_rows)).where(c("_file") < files)
            dealt = dealt.withColumn("part", F.floor(c("_file") / per_task).cast("int")).repartitionById(-(-files // per_task), "part")
            whole = dealt.sortWithinPartitions("part", "_file").select(*names, "part")
            writer = whole.write.options(**PLAIN_LOCAL).option("maxRecordsPerFile", self.file_rows)
            writer.partitionBy("part").mode("overwrite").parquet(f"{self.path}/rows/epoch={epoch}")
        # the last rows of the order, fewer than a file's
        rows.orderBy(c(self.order).desc()).limit(over).write.mode("overwrite").parquet(f"{self.path}/left/epoch={epoch}")
        entry = spark.createDataFrame([(epoch, n, files, over)], LOG)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/epoch={epoch}")

    def close(self, spark: SparkSession, last_epoch: int) -> DataFrame:
        """Write what is left and return all rows, with ``file``, the file each is in."""
        left = self._left_over(spark, last_epoch)
        left.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rows/epoch={last_epoch + 1}")  # less than one file
        found = spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/rows")
        return found.withColumn("file", F.input_file_name())

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{self.path}/log")


def append_buffered(stream: DataFrame, label: str, order: str, file_rows: int) -> DataFrame:
    """Run a stream to the end of its source; all rows with the ``file`` they are in."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    sink, last = BufferedAppend(path, stream.schema, order, file_rows), [-1]

    def write(batch: DataFrame, epoch: int) -> None:
        sink.write(batch, epoch)
        last[0] = epoch

    stream.writeStream.option("checkpointLocation", path + "/_state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return sink.close(spark, last[0])
