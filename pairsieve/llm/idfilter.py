"""A bit array over ids: lets all given ids through and few others.

For joins in which only a part of the documents take part, so that the other
texts aren't shuffled. The array has 64 bits or more for each id (``LEAST_BITS``, 1 MB, for few), and at
most ``MOST_BITS`` (16 MB) however many ids there are; with more than that it
lets more through, and the join behind it decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 23, 1 << 27


def id_slot(id_: Column, bits: np.ndarray) -> Column:
    """Place of an id in the array of ``id_filter``."""
    return F.pmod(F.xxhash64(id_), F.lit(len(bits) * 64))


def id_filter(ids: DataFrame, size: int | None = None) -> np.ndarray:
    """Filter of the single column of ``ids``, of ``size`` bits or as many as their number asks for; at most MOST_BITS / 64 rows reach the driver."""
    if size is None:
        wanted, size = 64 * ids.count(), LEAST_BITS
        while size < min(wanted, MOST_BITS):
            size *= 2
    out = np.zeros(size // 64, dtype=np.uint64)
    words = (
        ids.select(id_slot(ids[ids.columns[0]], out).alias("s"))
        .groupBy(F.shiftright("s", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("mask"))
        .toArrow()
    )
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _marked(df: DataFrame, id_: Column, ids: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: whether ``id_`` may be in the single column of ``ids`` (false for null)."""
    bits = id_filter(ids)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_be_in(slots: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, slots.to_numpy()))

    return df.withColumn("_maybe", F.when(id_.isNotNull(), may_be_in(F.coalesce(id_slot(id_, bits), F.lit(0).cast("long")))).otherwise(F.lit(False)))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in the single column of ``ids``; null ids stay.

    Only rows that the filter lets through take part in a join, so the other
    texts aren't shuffled.
    """
    id_ = F.col("doc_id").cast("long")
    marked = _marked(docs, id_, ids)
    clear = marked.where(~F.col("_maybe")).drop("_maybe")
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    looked_up = marked.where("_maybe").join(gone, id_ == F.col("_gone"), "left_anti").drop("_maybe")
    return clear.unionByName(looked_up)
