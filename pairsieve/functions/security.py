"""Pass/warn/fail checks as struct columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bounds import extractable_key_rate, max_bound_entropy, storage_capacity_depolar, storage_capacity_mixed
from .channel import QBER_HARD_LIMIT, QBER_WARN_LIMIT, as_col, binary_entropy


def _check(name: str, status: Column, value: Column, threshold: Column, margin: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"),
        status.alias("status"),
        value.alias("value"),
        threshold.alias("threshold"),
        margin.alias("margin"),
    )


def check_qber(q: Column) -> Column:
    status = F.when(q > QBER_HARD_LIMIT, "failed").when(q > QBER_WARN_LIMIT, "warning").otherwise("passed")
    limit = F.when(q > QBER_HARD_LIMIT, F.lit(QBER_HARD_LIMIT)).otherwise(F.lit(QBER_WARN_LIMIT))
    return _check("qber", status, q, limit, limit - q)


def check_storage(r: Column, nu: Column) -> Column:
    return check_used(storage_capacity_mixed(r) * nu)


def check_used(used: Column) -> Column:
    margin = 0.5 - used
    status = F.when(used >= 0.5, "failed").when(margin < 0.1, "warning").otherwise("passed")
    return _check("storage_capacity", status, used, F.lit(0.5), margin)


def check_strictly_less(q: Column, r: Column) -> Column:
    return check_entropies(binary_entropy(q), max_bound_entropy(r))


def check_entropies(h: Column, h_min: Column) -> Column:
    margin = h_min - h
    status = F.when(margin <= 0, "failed").when(margin < 0.05, "warning").otherwise("passed")
    return _check("strictly_less", status, h, h_min, margin)


def check_batch(n: Column, q: Column, r: Column, nu: Column, ec: float = 1.16, eps: float = 1e-10) -> Column:
    rate = extractable_key_rate(r, nu, q, ec)
    return check_expected(expected_bits(n, rate, eps), rate)


def expected_bits(n: Column, rate: Column, eps: float = 1e-10) -> Column:
    return n * rate - 2 * math.log2(1 / eps)


def check_expected(expected: Column, rate: Column) -> Column:
    status = F.when(expected <= 0, "failed").when(rate < 0.01, "warning").otherwise("passed")
    return _check("batch_size", status, expected, F.lit(0.0), expected)


def min_batch_size(q: Column, r: Column, nu: Column, target: int = 128, ec: float = 1.16, eps: float = 1e-10) -> Column:
    """0 stands for 'no batch is large enough'."""
    return min_batch_of(extractable_key_rate(r, nu, q, ec), target, eps)


def min_batch_of(rate: Column, target: int = 128, eps: float = 1e-10) -> Column:
    return F.when(rate <= 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.ceil((target + 2 * math.log2(1 / eps)) / rate))
    )


NARROW_MARGIN = 0.02


def verification(measured: Column, r: Column, nu: Column) -> dict[str, Column]:
    bound = (1 - r) / 2
    margin = bound - measured
    capacity_ok = storage_capacity_depolar(r) * nu < 0.5
    rules = {
        "storage_bound": measured >= bound,
        "hard_limit": measured >= QBER_HARD_LIMIT,
        "warn_limit": measured >= QBER_WARN_LIMIT,
        "storage_capacity": ~capacity_ok,
        "narrow_margin": (margin > 0) & (margin < NARROW_MARGIN),
    }
    return {
        "storage_noise_bound": bound,
        "security_margin": margin,
        "capacity_ok": capacity_ok,
        "is_secure": (measured < bound) & (measured < QBER_HARD_LIMIT) & capacity_ok,
        "warnings": F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])), ","),
    }


def qber_within(measured: Column, expected: Column, tolerance: float = 0.01) -> Column:
    return F.abs(measured - expected) <= tolerance


def wait_long_enough(actual_ns: Column, required_ns: Column, tolerance: float = 0.01) -> Column:
    return actual_ns >= as_col(required_ns) * (1.0 - tolerance)
