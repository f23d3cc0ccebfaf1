"""Finite-size corrections and key lengths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bounds import bounded_storage_entropy, max_bound_entropy
from .channel import as_col, binary_entropy
from .stage import let, staged

EPS_SEC = 1e-10
EPS_COR = 1e-6
EC_EFFICIENCY = 1.16


def finite_size_penalty(n: Column, k: Column, epsilon: float = EPS_SEC) -> Column:
    """Allowance for estimating the error rate of n bits from k test bits."""
    n, k = n.cast("double"), k.cast("double")
    return F.sqrt((n + k) / (n * k) * ((k + 1) / k) * math.log(4.0 / epsilon))


def hoeffding_halfwidth(n: Column, epsilon: float) -> Column:
    return F.sqrt(F.lit(math.log(2.0 / epsilon)) / (2 * n))


def hoeffding_interval(n: Column, p: Column | float, epsilon: float = EPS_SEC) -> tuple[Column, Column]:
    p = as_col(p)
    half = hoeffding_halfwidth(n, epsilon)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def hoeffding_counts(n: Column, p: Column | float, epsilon: float = EPS_SEC) -> tuple[Column, Column]:
    lower, upper = hoeffding_interval(n, p, epsilon)
    return F.floor(lower * n), F.ceil(upper * n)


def samples_for_tolerance(tolerance: Column | float, confidence: float = 0.999) -> Column:
    tolerance = as_col(tolerance)
    return F.ceil(F.lit(math.log(2.0 / (1.0 - confidence))) / (2 * tolerance * tolerance))


def finite_key_length(
    n: Column,
    qber: Column,
    r: Column,
    nu: Column,
    ec: float = EC_EFFICIENCY,
    eps_sec: float = EPS_SEC,
    eps_cor: float = EPS_COR,
    test_fraction: Column | float = 0.05,
) -> Column:
    """Bits of key from n raw bits after estimation, correction and hashing."""
    n = n.cast("double")
    k = F.ceil(n * as_col(test_fraction)).cast("double")
    kept = n - k
    q_adj = F.least(F.lit(0.5), qber + finite_size_penalty(kept, k, eps_sec / 4))
    rate = bounded_storage_entropy(r, nu) - ec * binary_entropy(q_adj)
    cost = math.log2(1 / eps_sec) + math.log2(1 / eps_cor)
    return F.when(kept <= 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), F.floor(kept * rate - cost))
    )


def with_finite_key(
    df: DataFrame,
    n: str,
    qber: str,
    r: str,
    nu: str,
    ec: float = EC_EFFICIENCY,
    eps_sec: float = EPS_SEC,
    eps_cor: float = EPS_COR,
    test_fraction: float = 0.05,
) -> DataFrame:
    """``finite_key_length`` in stages, so no step is computed twice per row.

    Adds test_bits, key_bits, qber_adj, h_adj, h_min and final_length.
    """
    cost = math.log2(1 / eps_sec) + math.log2(1 / eps_cor)
    df = df.withColumn("test_bits", F.ceil(F.col(n) * test_fraction)).withColumn("key_bits", F.col(n) - F.col("test_bits"))
    penalty = finite_size_penalty(F.col("key_bits"), F.col("test_bits"), eps_sec / 4)
    df = staged(df, {"qber_adj": F.least(F.lit(0.5), F.col(qber) + penalty)})
    df = staged(
        df,
        {"h_adj": binary_entropy(F.col("qber_adj")), "h_min": bounded_storage_entropy(F.col(r), F.col(nu))},
    )
    length = F.floor(F.col("key_bits") * (F.col("h_min") - ec * F.col("h_adj")) - cost)
    zero = F.lit(0).cast("bigint")
    return df.withColumn("final_length", F.when(F.col("key_bits") <= 0, zero).otherwise(F.greatest(zero, length)))


def _looped_length(n: Column, qber: Column, entropy: Column, fraction: Column | float) -> Column:
    """``finite_key_length`` for use inside a loop, from the bounded storage entropy, which the loop doesn't change: every part computed once."""
    cost = math.log2(1 / EPS_SEC) + math.log2(1 / EPS_COR)
    zero = F.lit(0).cast("bigint")
    n = n.cast("double")

    def by_test(k: Column) -> Column:
        kept = n - k
        q_adj = F.least(F.lit(0.5), qber + finite_size_penalty(kept, k, EPS_SEC / 4))
        length = let(q_adj, lambda q: F.floor(kept * (entropy - EC_EFFICIENCY * binary_entropy(q)) - cost))
        return F.when(kept <= 0, zero).otherwise(F.greatest(zero, length))

    return let(F.ceil(n * as_col(fraction)).cast("double"), by_test)


FRACTION_STEPS = 50


def optimal_test_fraction(n: Column, qber: Column, r: Column, nu: Column) -> Column:
    """Best of the fractions 0.01, 0.02 ... 0.50 (smallest on a tie), as (len, frac)."""

    def best(entropy: Column) -> Column:
        def better(acc: Column, i: Column) -> Column:
            return let(
                _looped_length(n, qber, entropy, i / 100.0),
                lambda got: F.when(got > acc["len"], F.struct(got.alias("len"), (i / 100.0).alias("frac"))).otherwise(acc),
            )

        start = F.struct(F.lit(-1).cast("bigint").alias("len"), F.lit(0.0).alias("frac"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, better)

    return let(bounded_storage_entropy(r, nu), best)


MIN_N_LOW, MIN_N_HIGH = 100, 10_000_000


def min_n_for_length(target: int, qber: Column, r: Column, nu: Column) -> Column:
    """Least n in [100, 10^7] reaching ``target`` bits: 24 halvings cover the range."""

    def least(entropy: Column) -> Column:
        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2)
            open_ = acc["lo"] < acc["hi"]
            return let(
                _looped_length(mid, qber, entropy, 0.05) >= target,
                lambda hit: F.struct(
                    F.when(open_ & ~hit, mid + 1).otherwise(acc["lo"]).alias("lo"),
                    F.when(open_ & hit, mid).otherwise(acc["hi"]).alias("hi"),
                ),
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.lit(24)),
            F.struct(F.lit(MIN_N_LOW).cast("bigint").alias("lo"), F.lit(MIN_N_HIGH).cast("bigint").alias("hi")),
            halve,
            lambda acc: acc["lo"],
        )

    return let(bounded_storage_entropy(r, nu), least)


def hashing_penalty(eps_sec: float = EPS_SEC) -> float:
    return 2 * math.log2(1 / eps_sec) - 2


def detailed_key_length(n: Column, leak: Column, r: Column, eps_sec: float = EPS_SEC) -> dict[str, Column]:
    penalty = hashing_penalty(eps_sec)
    available = max_bound_entropy(r) * n
    length = F.greatest(F.lit(0).cast("bigint"), F.floor(available - leak - penalty))
    return {
        "entropy_available": available,
        "final_length": length,
        "entropy_consumed": F.when(length > 0, length + penalty).otherwise(available),
        "is_viable": length > 0,
        "efficiency": F.when(n > 0, length / n).otherwise(F.lit(0.0)),
    }


def min_input_length(target: Column | int, r: Column, leak_rate: float = 0.1, eps_sec: float = EPS_SEC) -> Column:
    rate = max_bound_entropy(r) - leak_rate
    return F.when(rate <= 0, F.lit(1_000_000_000).cast("bigint")).otherwise(
        F.ceil((as_col(target) + hashing_penalty(eps_sec)) / rate)
    )


def total_entropy(bits: Column, leak: Column, r: Column) -> Column:
    return F.greatest(F.lit(0.0), max_bound_entropy(r) * bits - leak)


def smooth_rate(qber: Column, gamma: Column | float) -> Column:
    return as_col(gamma) - binary_entropy(qber)


def key_length_bound(n: Column, qber: Column, leak: Column, eps_sec: float = EPS_SEC, gamma: float = 0.0) -> Column:
    """Bits left after leakage and hashing; ``gamma`` 0 stands for the full rate 1."""
    raw = n * smooth_rate(qber, gamma if gamma != 0.0 else 1.0) - leak - 2 * math.log2(1 / eps_sec)
    return F.greatest(F.lit(0).cast("bigint"), F.floor(raw))
