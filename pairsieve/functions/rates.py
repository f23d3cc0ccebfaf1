"""Code-rate choice, shortening, puncturing and leakage caps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .channel import as_col, binary_entropy

# Frame size, mother rate, rate range, efficiency limit, tag bits.
FRAME = 4096
MOTHER_RATE = 0.5
RATE_MIN, RATE_MAX, RATE_STEP = 0.50, 0.95, 0.01
F_CRIT = 1.22
TAG_BITS = 50


def truncate(x: Column) -> Column:
    """Towards zero, as BIGINT."""
    return x.cast("bigint")


def safety_cap(n: Column, qber: Column, epsilon: float = 0.0) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), truncate(n * (1 - binary_entropy(qber) - epsilon)))


def safety_cap_by_entropy(n: Column, h_min: Column, target: Column | int, eps: float = 1e-10) -> Column:
    return F.greatest(
        F.lit(0).cast("bigint"), truncate(n * h_min - as_col(target) - 2 * math.log2(1 / eps))
    )


def blind_safety_cap(
    n: Column, qber: Column, modulation: int, tag_bits: int = TAG_BITS, mother: float = MOTHER_RATE, epsilon: float = 0.0, eps: float = 1e-10
) -> Column:
    entropy = F.when((qber <= 0) | (qber >= 0.5), F.lit(0.0)).otherwise(binary_entropy(qber))
    worst = truncate((1 - mother) * n) + tag_bits + modulation
    return F.greatest(
        F.lit(0).cast("bigint"), truncate(n * (1 - entropy - epsilon) - worst - 2 * math.log2(1 / eps))
    )


def rate_target(qber: Column, f_crit: float = F_CRIT) -> Column:
    return F.greatest(F.lit(0.1), F.least(1 - f_crit * binary_entropy(qber), F.lit(0.9)))


def suggested_rate(qber: Column, margin: float = 0.0) -> Column:
    """Largest feasible rate in [0.50, 0.95]."""
    entropy = binary_entropy(F.least(qber + margin, F.lit(0.499)))
    max_rate = F.greatest(F.lit(0.0), 1 - entropy)
    lower = F.greatest(F.lit(RATE_MIN), F.greatest(F.lit(0.0), 1 - F_CRIT * entropy))
    upper = F.least(F.lit(RATE_MAX), max_rate)
    return (
        F.when(entropy < 1e-10, F.lit(RATE_MAX))
        .when(upper >= lower, upper)
        .when(F.least(max_rate, F.lit(RATE_MAX)) >= RATE_MIN, F.least(max_rate, F.lit(RATE_MAX)))
        .otherwise(F.lit(RATE_MIN))
    )


def narrow_rate(qber: Column, f_crit: float = F_CRIT) -> Column:
    """Target clamped to [0.51, 0.60]; mother rate out of range."""
    return F.when((qber <= 0) | (qber >= 0.5), F.lit(MOTHER_RATE)).otherwise(
        F.greatest(F.lit(0.51), F.least(1 - f_crit * binary_entropy(qber), F.lit(0.60)))
    )


def nearest_rate(target: Column, rates: Column) -> Column:
    """Rate of a fixed, short list next to the target; the lower one on a tie.

    A min over an array literal: no join, so the row is never multiplied.
    """
    best = F.array_min(F.transform(rates, lambda r: F.struct(F.round(F.abs(r - target), 12).alias("d"), r.alias("r"))))
    return best["r"]


def nearest_grid_rate(target: Column) -> Column:
    """``nearest_rate`` on the 0.01 grid in closed form: the two neighbours decide."""

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(RATE_MIN), F.least(F.lit(RATE_MAX), x / 100.0))

    lo, hi = clip(F.floor(target * 100)), clip(F.ceil(target * 100))
    return F.when(F.round(F.abs(hi - target), 12) < F.round(F.abs(lo - target), 12), hi).otherwise(lo)


def selected_rate(qber: Column) -> Column:
    """Rate of the 0.01 grid for an error rate."""
    return (
        F.when(qber <= 0, F.lit(RATE_MAX))
        .when(qber >= 0.5, F.lit(RATE_MIN))
        .otherwise(nearest_grid_rate(rate_target(qber)))
    )


def shortened_bits(payload: Column, frame: int = FRAME) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), frame - payload)


def punctured_bits(target: Column, base: float = MOTHER_RATE, frame: int = FRAME) -> Column:
    count = F.floor((1 - base / target) * frame)
    return F.when(target <= base, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), F.least(count, F.lit(frame - 1).cast("bigint")))
    )


def rate_selection(qber: Column, payload: Column, frame: int = FRAME) -> Column:
    """Struct of rate, shortened, punctured, expected efficiency, syndrome length."""
    rate = selected_rate(qber)
    entropy = binary_entropy(qber)
    return F.struct(
        rate.alias("rate"),
        shortened_bits(payload, frame).alias("n_shortened"),
        punctured_bits(rate, MOTHER_RATE, frame).alias("n_punctured"),
        F.when(entropy > 0, (1 - MOTHER_RATE) / entropy).otherwise(F.lit(1.0)).alias("expected_efficiency"),
        F.lit(int(frame * (1 - MOTHER_RATE))).cast("bigint").alias("syndrome_length"),
    )


def blind_start(qber: Column, frame: int = FRAME, mother: float = MOTHER_RATE) -> Column:
    """Start settings by error-rate tier: shortening, iterations, modulation share."""

    def fraction(target: float) -> int:
        return int((mother - target) / (1 - target) * frame)

    def tier(shorten: int, rounds: int, share: float) -> Column:
        return F.struct(
            F.lit(shorten).cast("bigint").alias("initial_shortening"),
            F.lit(rounds).cast("bigint").alias("max_iterations"),
            F.lit(share).alias("modulation_delta"),
        )

    return (
        F.when(qber <= 0.05, tier(0, 3, 0.10))
        .when(qber <= 0.10, tier(fraction(0.55), 3, 0.15))
        .otherwise(tier(fraction(0.52), 5, 0.20))
    )


def initial_disclosure(qber: Column, d: Column | int, rounds: int) -> Column:
    d = d if isinstance(d, Column) else F.lit(d)
    return F.when(qber > 0.05, F.least(F.floor(d * 0.1), F.floor(d / rounds))).otherwise(F.lit(0).cast("bigint"))


def effective_blind_rate(d: Column, shortened: Column) -> Column:
    return F.when(shortened >= d, F.lit(0.5)).otherwise(0.5 + 0.5 * (shortened / d) * 0.4)


def correction_efficiency(rate: Column, qber: Column) -> Column:
    """f = (1 - R) / h(q)."""
    entropy = binary_entropy(qber)
    return F.when(entropy > 0, (1 - rate) / entropy)


def binomial_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = z * F.sqrt(p * (1 - p) / n)
    return p - half, p + half


def viable_early(cap: Column, n: Column, blocks: Column) -> Column:
    """Cap must hold half a bit per key bit and a 64-bit tag per block."""
    return cap >= n / 2 + 64 * blocks


def partition_length(final: Column, i0: Column, i1: Column) -> Column:
    return F.least(F.floor(final / 2), i0, i1)
