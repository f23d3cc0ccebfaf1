"""Entropy, channel error rates, detection and link formulas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error-rate limits.
QBER_WARN_LIMIT = 0.11
QBER_HARD_LIMIT = 0.22


def as_col(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def binary_entropy(p: Column | float, log2: Callable[[Column], Column] = F.log2) -> Column:
    p = as_col(p)
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(
        -p * log2(p) - (1 - p) * log2(1 - p)
    )


def channel_capacity(q: Column | float) -> Column:
    return 1 - binary_entropy(q)


def qber_additive(fidelity: Column, e_det: Column, eta: Column, p_dark: Column) -> Column:
    """Infidelity, detector and dark-count shares simply added up."""
    return (1 - fidelity) / 2 + e_det + (1 - eta) * p_dark / 2


def qber_expected(fidelity: Column, p_dark: Column | float = 0.0, intrinsic: Column | float = 0.0) -> Column:
    return F.least(F.lit(0.5), (1 - fidelity) / 2 + as_col(intrinsic) + as_col(p_dark) * 0.5)


def qber_simple(fidelity: Column, e_det: Column) -> Column:
    return (1 - fidelity) / 2 + e_det


def click_probability(eta: Column, p_dark: Column) -> Column:
    return eta * (1 - p_dark) + 2 * p_dark * (1 - eta)


def q_channel(fidelity: Column, e_det: Column, eta: Column, p_dark: Column) -> Column:
    """Error share among clicks, clamped to [0, 0.5]."""
    click = click_probability(eta, p_dark)
    wrong = e_det + (1 - e_det) * (1 - fidelity) + p_dark * (1 - eta)
    return F.when(
        click > 1e-12, F.least(F.lit(0.5), F.greatest(F.lit(0.0), wrong / (2 * click)))
    ).otherwise(F.lit(0.5))


def q_storage(r: Column) -> Column:
    return (1 - r) / 2


def detection_probability(eta: Column, p_dark: Column) -> Column:
    return eta + (1 - eta) * p_dark


def qber_conditional_profile(fidelity: Column, e_det: Column, eta: Column, p_dark: Column) -> Column:
    """Conditional error rate where the detector share scales with the photon."""
    seen = detection_probability(eta, p_dark)
    wrong = eta * ((1 - fidelity) / 2 + e_det) + (1 - eta) * p_dark * 0.5
    return F.when(seen <= 0, F.lit(0.5)).otherwise(wrong / seen)


def qber_conditional_params(fidelity: Column, e_det: Column, eta: Column, p_dark: Column) -> Column:
    """Conditional error rate where the detector share applies to every event; at most 0.5."""
    seen = detection_probability(eta, p_dark)
    wrong = e_det + (1 - fidelity) / 2 * eta + p_dark * (1 - eta) * 0.5
    return F.when(seen <= 0, F.lit(0.5)).otherwise(F.least(wrong / seen, F.lit(0.5)))


def signal_to_noise(eta: Column, p_dark: Column) -> Column:
    dark = (1 - eta) * p_dark
    return F.when(dark <= 0, F.lit(float("inf"))).otherwise(eta / dark)


def pair_emission(n: Column | int, mu: Column) -> Column:
    """Probability that a pulse of mean ``mu`` holds ``n`` pairs."""
    n = n if isinstance(n, Column) else F.lit(n)
    half = mu / 2
    return F.when(n < 0, F.lit(0.0)).otherwise(
        (n + 1) * F.pow(half, n) / F.pow(1 + half, n + 2)
    )


def single_pair_share(mu: Column) -> Column:
    """Share of single pairs among the non-empty pulses."""
    p0, p1 = pair_emission(0, mu), pair_emission(1, mu)
    return F.when(p0 >= 1, F.lit(0.0)).otherwise(p1 / (1 - p0))


NOCLICK_TERMS = 20


def no_click(mu: Column, eta: Column, p_dark: Column) -> Column:
    """Probability of no click, first 20 terms of the pair-number sum."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(NOCLICK_TERMS - 1)),
        F.lit(0.0),
        lambda acc, n: acc + pair_emission(n, mu) * F.pow(1 - eta, n) * (1 - p_dark),
    )


def no_click_dishonest(mu: Column, eta: Column, p_dark: Column) -> Column:
    return F.greatest(pair_emission(0, mu), no_click(mu, eta, p_dark) * 0.95)


def fibre_delay_ns(length_km: Column, speed_km_s: float = 200_000.0) -> Column:
    return length_km / speed_km_s * 1e9


def fibre_loss_db(length_km: Column, db_per_km: float = 0.2) -> Column:
    return length_km * db_per_km


def fibre_transmittance(length_km: Column, db_per_km: float = 0.2) -> Column:
    return F.pow(F.lit(10.0), -fibre_loss_db(length_km, db_per_km) / 10)


def storage_fidelity(r: Column) -> Column:
    return (1 + r) / 2


def storage_entropy(r: Column) -> Column:
    return binary_entropy((1 - r) / 2)


def detector_depolarisation(e_det: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * e_det))


def link_model(fidelity: Column, eta: Column, p_dark: Column, e_det: Column, length_km: Column | float = 0.0) -> Column:
    length_km = as_col(length_km)
    return (
        F.when((fidelity == 1) & (eta == 1) & (p_dark == 0) & (e_det == 0), "perfect")
        .when((eta < 1) | (p_dark > 0) | (length_km > 0), "heralded-double-click")
        .otherwise("depolarise")
    )
