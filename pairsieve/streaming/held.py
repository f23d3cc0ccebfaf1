"""Rows that wait until the watermark has passed them, and jobs over what is released.

Order-dependent checks need a row's predecessors, and those may come epochs
later. Here every row waits in the state of a streaming aggregate until the
watermark has passed its time; then it is released, and its state goes with it.
The group is a time and a bucket of (session, row) hashes, so a hot session's
rows, and the rows of one instant, wait in many tasks. What comes out
of one epoch is complete up to the watermark, and is judged as an ordinary
distributed job together with a small table carried from epoch to epoch.

The carried table is a log: an epoch writes only the keys it changed, and every
``COMPACT``-th epoch writes the whole, without keys that have been silent for
longer than the job keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .base import ROCKSDB, STATE_STORE, run_on_disk  # noqa: F401

c = F.col
BUCKETS = 64
COMPACT = 8


def held(stream: DataFrame, keys: list[str], delay: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``stream``, each once, released when the watermark (latest ``ts`` less ``delay``) has passed its ``ts``.

    Rows that arrive behind the watermark are dropped by the engine and
    counted in its progress metrics (numRowsDroppedByWatermark), and so are
    rows without ts. ``keys`` tell rows apart; their hash deals those of one
    ts to ``buckets``, a number that a restarted query keeps.
    """
    timed = stream.where(c("ts").isNotNull()).withWatermark("ts", delay)
    rows = F.collect_list(F.struct(*[n for n in stream.columns if n != "ts"])).alias("held_rows")
    out = timed.groupBy("ts", F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("held_bucket")).agg(rows)
    return out.select("ts", F.inline("held_rows")).select(*stream.columns)


Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def carried_table(spark, path: str, schema: str, keys: list[str], epoch: int) -> DataFrame:
    """What the epochs before ``epoch`` carry: for each key its latest row since the last whole table."""
    if epoch == 0:
        return spark.createDataFrame([], schema)
    first = (epoch - 1) // COMPACT * COMPACT
    parts = None
    for e in range(first, epoch):
        part = spark.read.schema(schema).parquet(f"{path}/carry/epoch={e}").withColumn("_epoch", F.lit(e))
        parts = part if parts is None else parts.unionByName(part)
    names = [n for n in parts.columns if n not in (*keys, "_epoch")]
    latest = parts.groupBy(*keys).agg(F.max_by(F.struct(*names), "_epoch").alias("_r"))
    return latest.select(*keys, "_r.*")


def drain_released(
    released: DataFrame, label: str, keys: list[str], state_schema: str, out_schema: str, step: Step, keep: Callable[[DataFrame], Column] | None = None
) -> DataFrame:
    """Run ``step(rows, carried)`` on what each epoch releases; returns all output rows.

    ``step`` returns output rows and the carried rows that changed. Both are
    written under the epoch's number with overwrite, and an epoch reads the
    tables of earlier epochs only, so a repeated epoch gives the same files.
    ``keep`` tells, on a whole table, which keys are still carried.

    What is released is written first and read back by the job's own session:
    that of a stream with state plans without adaptive execution.
    """
    spark = released.sparkSession
    path = scratch_path(spark, label)
    seen = [False]

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/released/epoch={epoch}")
        freed = spark.read.schema(batch.schema).parquet(f"{path}/released/epoch={epoch}")
        carried = carried_table(spark, path, state_schema, keys, epoch)
        if freed.isEmpty():
            rows, changed = spark.createDataFrame([], out_schema), spark.createDataFrame([], state_schema)
        else:
            rows, changed = step(freed, carried)
        if epoch % COMPACT == 0:
            names = [n for n in carried.columns if n not in keys]
            old = carried.join(changed.select(*keys), keys, "left_anti")
            changed = old.unionByName(changed.select(*keys, *names))
            changed = changed.where(keep(freed)) if keep is not None else changed
        rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        changed.write.mode("overwrite").parquet(f"{path}/carry/epoch={epoch}")
        seen[0] = True

    query = released.writeStream.option("checkpointLocation", path + "/_state").outputMode("append").trigger(availableNow=True)
    run_on_disk(spark, query.foreachBatch(write))
    if not seen[0]:
        return spark.createDataFrame([], out_schema)
    return spark.read.schema(out_schema).option("recursiveFileLookup", "true").parquet(path + "/rows")
