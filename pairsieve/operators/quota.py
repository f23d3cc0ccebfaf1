"""Generate, filter, repeat until a quota is full; what is kept survives a restart.

Candidates are numbered, and a batch is a range of numbers. Each batch is one
folder of kept rows that Spark commits as a whole, named by its range, so the
folders are both the result and the cursor. The size of a batch follows from
the share kept so far. The result is the kept rows of the least numbers,
however the batches were cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import positions

OVERSAMPLE = 20  # candidates for each wanted row while nothing is known of the yield
MARGIN = 1.1
LEAST_BATCH = 1_000
MOST_ROUNDS = 200


def committed(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Ranges [start, stop) whose batches are complete, in order without gaps."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    if system.exists(folder):
        for status in system.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("batch=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                start, stop = (int(x) for x in name.removeprefix("batch=").split("-"))
                found[start] = stop
    out, at = [], 0
    while at in found:
        out.append((at, found[at]))
        at = found[at]
    return out


def _kept(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/batch={a}-{b}" for a, b in ranges])


def fill_quota(
    spark: SparkSession, generate: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], wanted: int, path: str, number: str = "candidate_id"
) -> DataFrame:
    """The ``wanted`` kept candidates of least number.

    ``generate`` turns rows of numbers (column ``number``) into candidates,
    ``keep`` filters them; both must treat a number the same way whenever it
    comes. A run that finds batches under ``path`` goes on behind them. Raises
    when ``MOST_ROUNDS`` batches don't fill the quota.
    """
    ranges = committed(spark, path)
    have = _kept(spark, path, ranges).count() if ranges else 0
    for _ in range(MOST_ROUNDS):
        if ranges and have >= wanted:
            break
        start = ranges[-1][1] if ranges else 0
        open_ = max(1, wanted - have)
        share = have / start if have else 0.0
        size = math.ceil(open_ * MARGIN / share) if share else max(start, open_ * OVERSAMPLE)
        stop = start + max(LEAST_BATCH, size)
        batch = keep(generate(spark.range(start, stop).withColumnRenamed("id", number)))
        batch.write.mode("overwrite").parquet(f"{path}/batch={start}-{stop}")
        ranges.append((start, stop))
        have += _kept(spark, path, ranges[-1:]).count()
    else:
        raise RuntimeError(f"{have} of {wanted} rows kept from {ranges[-1][1]} candidates")
    rows = _kept(spark, path, ranges)
    return positions(rows, [], number, out="_place").where(F.col("_place") <= wanted).drop("_place")
