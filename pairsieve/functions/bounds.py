"""Entropy bounds of a noisy storage and the key rates that follow from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .channel import QBER_HARD_LIMIT, QBER_WARN_LIMIT, as_col, binary_entropy, qber_additive


def collision_entropy_rate(r: Column, log2: Callable[[Column], Column] = F.log2) -> Column:
    return 1 - log2(1 + 3 * r * r)


def gamma_inverse(x: Column, steps: int = 50) -> Column:
    """x for x >= 1/2, 0 for x <= 0, else the y in (0, 1/2) with h(y) + y - 1 = x.

    h(y) + y - 1 rises on [0, 1/2], so plain bisection finds y.
    """

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        low_side = binary_entropy(mid) + mid - 1 < x
        return F.struct(
            F.when(low_side, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(low_side, acc["hi"]).otherwise(mid).alias("hi"),
        )

    root = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(1e-10).alias("lo"), F.lit(0.5 - 1e-10).alias("hi")),
        halve,
        lambda acc: (acc["lo"] + acc["hi"]) / 2,
    )
    return F.when(x >= 0.5, x).when(x <= 0, F.lit(0.0)).otherwise(root)


def dupuis_konig_bound(r: Column) -> Column:
    return gamma_inverse(collision_entropy_rate(r))


def erasure_bound(r: Column) -> Column:
    return 1 - r


def max_bound_entropy(r: Column, log2: Callable[[Column], Column] = F.log2) -> Column:
    """Larger of the two bounds.

    Where the collision rate is below 1/2 the erasure bound is the larger
    one, so the root finding inside ``dupuis_konig_bound`` never decides
    and this closed form is enough.
    """
    return F.greatest(collision_entropy_rate(r, log2), 1 - r)


def dominant_bound(r: Column) -> Column:
    coll = collision_entropy_rate(r)
    return F.when(coll >= 1 - r, "dupuis_konig").otherwise("lupo")


def rational_bound(r: Column) -> Column:
    return F.least(F.lit(0.5), max_bound_entropy(r))


def bounded_storage_entropy(r: Column, nu: Column) -> Column:
    return bounded_entropy_of(max_bound_entropy(r), nu)


def bounded_entropy_of(h_min: Column, nu: Column) -> Column:
    return (1 - nu) * 0.5 + nu * h_min


def key_rate_of(h_min: Column, nu: Column, h: Column, ec: float = 1.16) -> Column:
    """``extractable_key_rate`` from the entropies of storage and error rate."""
    return bounded_entropy_of(h_min, nu) - ec * h


def storage_capacity_mixed(r: Column, log2: Callable[[Column], Column] = F.log2) -> Column:
    """1 - h((1+r)/2); 0 and 1 at the ends."""
    return F.when((r == 0) | (r == 1), r).otherwise(1 - binary_entropy((1 + r) / 2, log2))


def storage_capacity_depolar(r: Column) -> Column:
    """1 - h(1-r)."""
    return 1 - binary_entropy(1 - r)


def strong_converse_exponent(r: Column, rate: Column, steps: int = 40) -> Column:
    """Largest exponent over alpha in [1.0001, 100].

    In x = 1/alpha the exponent is concave (the log of a p-norm is convex in
    1/p), so 40 ternary steps pin the maximum far below 1e-6.
    """

    def exponent(x: Column) -> Column:
        # (1+r)^alpha is factored out so that large alpha cannot overflow
        log_sum = F.log2(1 + r) + x * F.log2(1 + F.pow((1 - r) / (1 + r), 1 / x))
        return 1 + ((1 - x) * (rate - 1) - log_sum)

    def third(acc: Column, _: Column) -> Column:
        x1 = acc["lo"] + (acc["hi"] - acc["lo"]) / 3
        x2 = acc["hi"] - (acc["hi"] - acc["lo"]) / 3
        up = exponent(x1) < exponent(x2)
        return F.struct(
            F.when(up, x1).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(x2).alias("hi")
        )

    best = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0.01).alias("lo"), F.lit(1 / 1.0001).alias("hi")),
        third,
        lambda acc: exponent((acc["lo"] + acc["hi"]) / 2),
    )
    return F.when(rate <= storage_capacity_mixed(r), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), best))


def extractable_key_rate(r: Column, nu: Column, qber: Column, ec: float = 1.16) -> Column:
    return bounded_storage_entropy(r, nu) - ec * binary_entropy(qber)


def theory_min_n(qber: Column, epsilon: float = 1e-10) -> Column:
    """Smallest useful block, or NULL where no key is possible."""
    rate = 1 - 2 * binary_entropy(qber)
    needed = F.floor(F.pow(F.log(F.lit(4.0 / epsilon)) / rate, 2))
    return (
        F.when(qber >= QBER_WARN_LIMIT, F.lit(None).cast("bigint"))
        .when(qber <= 0, F.lit(100).cast("bigint"))
        .when(rate <= 0, F.lit(None).cast("bigint"))
        .otherwise(F.greatest(F.lit(100), F.least(needed, F.lit(10_000_000))).cast("bigint"))
    )


def theory_efficiency(qber: Column, block: Column, epsilon: float = 1e-10, recon: float = 1.0) -> Column:
    from .finite import finite_size_penalty

    k = F.greatest(F.lit(1), F.floor(block * 0.1)).cast("double")
    n = block - k
    q_eff = qber + finite_size_penalty(n, k, epsilon)
    rate = F.greatest(F.lit(0.0), 1 - 2 * binary_entropy(q_eff)) * recon
    base = 1 - 2 * binary_entropy(F.least(qber, F.lit(0.5)))
    return F.when(
        (qber >= QBER_HARD_LIMIT) | (block <= 0) | (base <= 0) | (n <= 0) | (q_eff >= 0.5), F.lit(0.0)
    ).otherwise(F.least(F.lit(1.0), rate))


ETA_AT_ZERO_KM = 0.8
DB_PER_KM = 0.2


def efficiency_to_distance(eta: Column, eta0: float = ETA_AT_ZERO_KM, db_km: float = DB_PER_KM) -> Column:
    return F.when((eta <= 0) | (eta > eta0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), -10 * F.log10(eta / eta0) / db_km)
    )


def distance_to_efficiency(km: Column, eta0: float = ETA_AT_ZERO_KM, db_km: float = DB_PER_KM) -> Column:
    return F.when(km <= 0, F.lit(eta0)).otherwise(
        F.least(F.lit(1.0), eta0 * F.pow(F.lit(10.0), -db_km * km / 10))
    )


def max_distance_km(p_dark: Column, fidelity: Column | float = 0.99, e_det: Column | float = 0.01) -> Column:
    """Longest fibre below the warning error rate: nine halvings of [0, 500] km (< 1 km)."""
    fidelity, e_det = as_col(fidelity), as_col(e_det)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        good = qber_additive(fidelity, e_det, distance_to_efficiency(mid), p_dark) < QBER_WARN_LIMIT
        return F.struct(
            F.when(good, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(good, acc["hi"]).otherwise(mid).alias("hi"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(9)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(500.0).alias("hi")),
        halve,
        lambda acc: acc["lo"],
    )
