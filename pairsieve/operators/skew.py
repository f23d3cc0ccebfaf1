"""Joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


PACKED = 8  # how much larger a table may be in memory than in its files


PART_ROWS = 1 << 20


def in_parts(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many parts as ``rows`` fill with about ``PART_ROWS`` each, and no fewer than there are cores.

    What a task sorts, joins or groups behind it takes the same memory whatever
    the size of the table and the session's number of shuffle partitions.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), *keys)


def understated(per_key: DataFrame, salts: int) -> bool:
    """Whether the optimizer would broadcast ``per_key`` by its estimate, though its repeated rows may be larger than the limit."""
    limit = int(per_key.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = int(per_key._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= limit < size * salts * PACKED


def attach(big: DataFrame, per_key: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = SALTS, rows: int | None = None) -> DataFrame:
    """Join per-key values (unique on ``keys``) to a table in which a key may be hot.

    Rows of the big side are spread over ``salts`` by the ``spread``
    columns; the per-key side is repeated once per salt. Whether it is
    broadcast is left to the size check of the optimizer. With ``rows``, the
    number of the big side's rows, both sides are dealt ``in_parts``.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    if rows is not None:
        left, right = in_parts(left, rows, *keys, "_salt"), in_parts(right, rows, *keys, "_salt")
    if understated(per_key, salts):
        right = right.hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
