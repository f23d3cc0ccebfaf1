"""The formulas as temporary SQL functions.

A formula is written once, as a column expression. Its SQL function gets the
text of that same expression: ``body`` builds it over the parameters' names and
puts Spark's own rendering into a form that its parser reads. No Python runs
when the functions are called; the optimizer expands them.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import bits, bounds, channel, finite, rates, security

SCALAR = (
    channel.binary_entropy, channel.channel_capacity, channel.qber_additive, channel.qber_expected, channel.qber_simple, channel.click_probability,
    channel.q_channel, channel.q_storage, channel.detection_probability, channel.qber_conditional_profile, channel.qber_conditional_params,
    channel.signal_to_noise, channel.pair_emission, channel.single_pair_share, channel.no_click, channel.no_click_dishonest, channel.fibre_delay_ns,
    channel.fibre_loss_db, channel.fibre_transmittance, channel.storage_fidelity, channel.storage_entropy, channel.detector_depolarisation, channel.link_model,
    bounds.collision_entropy_rate, bounds.gamma_inverse, bounds.dupuis_konig_bound, bounds.erasure_bound, bounds.max_bound_entropy, bounds.dominant_bound,
    bounds.rational_bound, bounds.bounded_storage_entropy, bounds.storage_capacity_mixed, bounds.storage_capacity_depolar, bounds.strong_converse_exponent,
    bounds.extractable_key_rate, bounds.theory_min_n, bounds.theory_efficiency, bounds.efficiency_to_distance, bounds.distance_to_efficiency, bounds.max_distance_km,
    finite.finite_size_penalty, finite.hoeffding_interval, finite.hoeffding_counts, finite.samples_for_tolerance, finite.finite_key_length,
    finite.optimal_test_fraction, finite.detailed_key_length, finite.min_input_length, finite.total_entropy, finite.key_length_bound,
    rates.safety_cap, rates.safety_cap_by_entropy, rates.rate_target, rates.suggested_rate, rates.narrow_rate, rates.nearest_grid_rate, rates.shortened_bits,
    rates.punctured_bits, rates.rate_selection, rates.blind_start, rates.effective_blind_rate, rates.correction_efficiency, rates.binomial_interval,
    rates.viable_early, rates.partition_length, security.check_qber, security.check_storage, security.check_strictly_less, security.check_batch,
    security.min_batch_size, security.verification, security.qber_within, security.wait_long_enough, bits.shortening_bits, bits.channel_llr, bits.basis_label,
)

_KINDS = {"punctured": "BOOLEAN", "basis": "INT", "bit": "INT"}
_OPERATOR = re.compile(r"(?<![\w`'\])])(<=>|<=|>=|<>|!=|==|<|>|=|\+|-|\*|/|%|or|and|not)\(")
_DOUBLE = re.compile(r"(?<![\w.'])(\d+\.\d+(?:E-?\d+)?)(?![\w.'])")

TABLES = {
    "generation_batches": (
        "n BIGINT, size BIGINT", "batch_id BIGINT, start BIGINT, length BIGINT",
        "SELECT b, b * size, least(size, n - b * size) FROM (SELECT explode(CASE WHEN n > 0 THEN sequence(0L, (n - 1) div size) ELSE array() END) AS b)",
    ),
    "disclosure_slices": (
        "d BIGINT, rounds BIGINT, q DOUBLE", "iteration BIGINT, start BIGINT, stop BIGINT",
        """SELECT i, CASE WHEN i = 0 THEN 0L ELSE first + (i - 1) * step END, CASE WHEN i = 0 THEN first ELSE least(first + i * step, d) END FROM (
            SELECT CASE WHEN q > 0.05D THEN least(cast(0.1D * d AS BIGINT), d div rounds) ELSE 0L END AS first, greatest(1L, d div rounds) AS step,
              explode(sequence(0L, rounds)) AS i) WHERE (i = 0 AND first > 0) OR (i > 0 AND first + (i - 1) * step < d)""",
    ),
}


def parameters(formula: Callable) -> dict[str, str]:
    """Names and types of a formula's parameters without defaults."""
    needed = [p.name for p in inspect.signature(formula).parameters.values() if p.default is inspect.Parameter.empty]
    return {n: _KINDS.get(n, "DOUBLE") for n in needed}


def as_one(value) -> Column:
    """A formula's result as one column; several results become a struct."""
    if isinstance(value, dict):
        return F.struct(*[v.alias(k) for k, v in value.items()])
    if isinstance(value, tuple):
        return F.struct(*[v.alias(f"v{k}") for k, v in enumerate(value)])
    return value


def body(value: Column) -> str:
    """SQL text of an expression: operators as the functions of that name, whole doubles as such."""
    text = _DOUBLE.sub(r"\1D", _OPERATOR.sub(r"`\1`(", value._jc.node().sql()))
    return re.sub(r"(?<!['\w])(-?Infinity)(?!['\w])", r"double('\1')", text)


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; returns their names."""
    for formula in SCALAR:
        kinds = parameters(formula)
        value = as_one(formula(*[F.col(n) for n in kinds]))
        empty = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in kinds.items()))
        returned = empty.select(value.alias("v")).schema["v"].dataType.simpleString()
        args = ", ".join(f"{n} {t}" for n, t in kinds.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {formula.__name__}({args}) RETURNS {returned} RETURN {body(value)}")
    for name, (args, returned, text) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({returned}) RETURN {text}")
    return [f.__name__ for f in SCALAR] + list(TABLES)
