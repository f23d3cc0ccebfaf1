"""Contract checks: each returns the ids of the violated rules, rows stay whole.

The rule ids are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def violated(rules: dict[str, Column]) -> Column:
    """Comma-separated ids of rules whose condition does not hold."""
    return F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])), ",")


def sample_range_rules() -> dict[str, Column]:
    c = F.col
    return {
        "storage_noise_r": c("storage_noise_r").between(0.0, 1.0),
        "storage_rate_nu": c("storage_rate_nu").between(0.0, 1.0),
        "wait_time_ns": c("wait_time_ns").between(1e5, 1e11),
        "channel_fidelity": (c("channel_fidelity") > 0.5) & (c("channel_fidelity") <= 1.0),
        "detection_efficiency": (c("detection_efficiency") > 0.0) & (c("detection_efficiency") <= 1.0),
        "detector_error": c("detector_error").between(0.0, 0.1),
        "dark_count_prob": c("dark_count_prob").between(1e-9, 1e-3),
        "num_pairs": c("num_pairs").between(10_000, 1_000_000_000),
    }


def storage_model_rules(r: Column, nu: Column, dim: Column, delta_t: Column, fidelity: Column, eta: Column) -> dict[str, Column]:
    return {
        "INV-NSM-001": r.between(0, 1),
        "INV-NSM-002": nu.between(0, 1),
        "INV-NSM-003": dim == 2,
        "INV-NSM-004": delta_t > 0,
        "INV-NSM-005": (fidelity > 0.5) & (fidelity <= 1),
        "INV-NSM-006": (eta > 0) & (eta <= 1),
    }


def channel_profile_rules(fidelity: Column, eta: Column, e_det: Column, dark: Column, loss: Column) -> dict[str, Column]:
    return {
        "INV-CNP-001": (fidelity > 0.5) & (fidelity <= 1),
        "INV-CNP-002": (eta > 0) & (eta <= 1),
        "INV-CNP-003": e_det.between(0, 0.5),
        "INV-CNP-004": dark.between(0, 1),
        "INV-CNP-005": (loss >= 0) & (loss < 1),
    }


def fibre_rules(length: Column, attenuation: Column, speed: Column, t1: Column, t2: Column, cycle: Column) -> dict[str, Column]:
    return {
        "INV-CH-001": length >= 0,
        "INV-CH-002": attenuation >= 0,
        "INV-CH-003": speed > 0,
        "INV-CH-004": t1 > 0,
        "INV-CH-005": (t2 > 0) & (t2 <= t1),
        "INV-CH-006": cycle > 0,
    }


def measurement_rules(round_id: Column, outcome: Column, basis: Column, timestamp_ns: Column) -> dict[str, Column]:
    return {
        "INV-MEAS-001": round_id >= 0,
        "INV-MEAS-002": outcome.isin(0, 1),
        "INV-MEAS-003": basis.isin(0, 1),
        "INV-MEAS-004": timestamp_ns >= 0,
    }


def generation_rules(outcomes: Column, bases: Column, generated: Column, bad_outcomes: Column, bad_bases: Column) -> dict[str, Column]:
    return {
        "POST-Q-001": outcomes == generated,
        "POST-Q-002": bases == generated,
        "POST-Q-003": bad_outcomes == 0,
        "POST-Q-004": bad_bases == 0,
    }


def sifting_rules(alice_len: Column, bob_len: Column, estimate: Column, penalty: Column, adjusted: Column, limit: float) -> dict[str, Column]:
    return {
        "POST-S-001": alice_len == bob_len,
        "POST-S-002": F.abs(adjusted - (estimate + penalty)) <= 1e-10,
        "POST-S-003": adjusted <= limit,
    }


def correction_rules(disclosed: Column, cap: Column, verified: Column) -> dict[str, Column]:
    return {"POST-R-001": cap.isNull() | (disclosed <= cap), "POST-R-002": verified}


def amplification_rules(length: Column, consumed: Column) -> dict[str, Column]:
    return {"POST-AMP-001": length > 0, "POST-AMP-002": consumed >= length}


def output_rules(n0: Column, n1: Column, nc: Column, is_chosen: Column, length: Column) -> dict[str, Column]:
    """Lengths of both keys and of the receiver's, whether the receiver's equals the chosen one, and the stated length."""
    return {
        "POST-OT-001": (n0 == length) & (n1 == length),
        "POST-OT-002": nc == length,
        "POST-OT-003": is_chosen,
    }


def key_rules(n_bits: Column, length: Column, security: Column, created: Column) -> dict[str, Column]:
    return {
        "INV-KEY-001": n_bits == length,
        "INV-KEY-002": (security > 0) & (security < 1),
        "INV-KEY-003": created >= 0,
    }
