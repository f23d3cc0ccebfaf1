"""Noisy pair tables from a table of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import views


def synthetic_pairs(ids: DataFrame, key: str, noise_rate: float) -> DataFrame:
    """Equal bases give equal bits, except that with ``noise_rate`` Bob's bit is
    drawn afresh (so the error rate is half of it). Every column is a digest of
    the id: any partitioning and any retry gives the same table.
    """
    i = F.col(key)
    same = F.col("a_basis") == F.col("b_basis")
    kept = views.byte_of("sn", i) >= int(round(noise_rate * 256))
    return ids.select(
        i, views.coin("sa", i).alias("a_basis"), views.coin("sb", i).alias("b_basis"), views.coin("so", i).alias("a_bit")
    ).withColumn("b_bit", F.when(same & kept, F.col("a_bit")).otherwise(views.coin("sf", i)))
