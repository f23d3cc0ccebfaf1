"""Disclosure ledger: running totals, first breach of the cap, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def entry_bits() -> Column:
    return F.col("syndrome_bits") + F.col("hash_bits") + F.col("retry_bits") + F.col("shortening_bits")


def cumulative(ledger: DataFrame) -> DataFrame:
    return running(ledger, ["session_id"], "entry_id", {"total": ("sum", entry_bits())})


def whole_bits(total: Column) -> Column:
    """Bits rounded up; 1e-9 keeps float noise on a whole number from adding a bit."""
    return F.ceil(total - 1e-9)


def first_breach(ledger: DataFrame, cap: int) -> DataFrame:
    """First entry whose running total is strictly above the cap, per session.

    Totals only grow, so the first breach is the smallest breaching entry:
    a map-side minimum, not a second sort.
    """
    over = cumulative(ledger).where(whole_bits(F.col("total")) > cap)
    return over.groupBy("session_id").agg(
        F.min("entry_id").alias("breach_entry"), F.min(whole_bits(F.col("total"))).alias("breach_total"), F.count(F.lit(1)).alias("n_refused")
    )


def totals(ledger: DataFrame, cap: int) -> DataFrame:
    spent = whole_bits(F.sum(entry_bits()))
    return ledger.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("entries"), spent.alias("total"), (cap - spent).alias("remaining"), (spent <= cap).alias("within_cap")
    )


def disclosure_schedule(rows: DataFrame, pos: str, qber: Column, d: int, rounds: int, start: Column | None = None) -> DataFrame:
    """Iteration at which each of ``d`` positions is disclosed (0 = before the first).

    ``start`` is the first position of iteration 1; by default the number
    disclosed before it, so no slice is skipped.
    """
    from ..functions.rates import initial_disclosure

    initial = initial_disclosure(qber, d, rounds)
    step = max(1, d // rounds)
    begin = initial if start is None else start
    p = F.col(pos)
    it = F.when(p < initial, 0).when(p >= d, F.lit(None)).otherwise(F.floor((p - begin) / step) + 1)
    return rows.withColumn("iteration", F.when(it <= rounds, it))
