"""Shared subqueries and formula texts for the reference SQL.

They restate the views and formulas independently of the Spark code, so
that a slip on one side shows up as a difference.
"""

from __future__ import annotations

import math

from .registry import view


def coin(tag: str, ident: str) -> str:
    return f"CAST(substr(md5('{tag}:' || {ident}), 1, 1) >= '8' AS INTEGER)"


def byte_of(tag: str, ident: str) -> str:
    digits = "'0123456789abcdef'"
    d = f"md5('{tag}:' || {ident})"
    return f"((instr({digits}, substr({d}, 1, 1)) - 1) * 16 + instr({digits}, substr({d}, 2, 1)) - 1)"


def h(p: str) -> str:
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN 0.0 ELSE -({p}) * log2({p}) - (1 - ({p})) * log2(1 - ({p})) END)"


def coll(r: str) -> str:
    return f"(1 - log2(1 + 3 * ({r}) * ({r})))"


def maxb(r: str) -> str:
    return f"greatest({coll(r)}, 1 - ({r}))"


def hbs(r: str, nu: str) -> str:
    return f"((1 - ({nu})) / 2 + ({nu}) * {maxb(r)})"


def mu(n: str, k: str, eps: float) -> str:
    return f"sqrt((CAST({n} AS DOUBLE) + ({k})) / (CAST({n} AS DOUBLE) * ({k})) * (CAST({k} AS DOUBLE) + 1) / ({k}) * {math.log(4.0 / eps)!r})"


def q_add(f: str = "channel_fidelity", e: str = "detector_error", eta: str = "detection_efficiency", d: str = "dark_count_prob") -> str:
    return f"((1 - {f}) / 2 + {e} + (1 - {eta}) * {d} / 2)"


COST = math.log2(1e10) + math.log2(1e6)


def fkl(n: str, q: str, r: str, nu: str, frac: str = "0.05", ec: float = 1.16) -> str:
    k = f"ceil(({n}) * CAST({frac} AS DOUBLE))"
    kept = f"(({n}) - {k})"
    qa = f"least(0.5, ({q}) + {mu(kept, k, 1e-10 / 4)})"
    return (
        f"(CASE WHEN {kept} <= 0 THEN 0 ELSE greatest(0, CAST(floor({kept} * ({hbs(r, nu)} - {ec} * {h(qa)}) - {COST!r}) AS BIGINT)) END)"
    )


view("v_pairs_base", f"""
SELECT user_id AS session_id, event_id AS round_id, ts, event_type <> 'error' AS detected,
       {coin('ab', 'event_id')} AS a_basis, {coin('bb', 'event_id')} AS b_basis,
       {coin('ao', 'event_id')} AS a_bit, {byte_of('n', 'event_id')} AS noise, {coin('bo', 'event_id')} AS free_bit
FROM events""")
view("v_pairs", """
SELECT session_id, round_id, ts, detected, a_basis, b_basis, a_bit,
       CASE WHEN a_basis <> b_basis THEN free_bit WHEN noise >= 13 THEN a_bit ELSE 1 - a_bit END AS b_bit
FROM v_pairs_base""")
view("v_large_base", f"""
SELECT CAST(0 AS BIGINT) AS session_id, round_id,
       {coin('ab', 'round_id')} AS a_basis, {coin('bb', 'round_id')} AS b_basis,
       {coin('ao', 'round_id')} AS a_bit, {byte_of('n', 'round_id')} AS noise, {coin('bo', 'round_id')} AS free_bit
FROM (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS round_id FROM lineitem)""")
view("v_large", """
SELECT session_id, round_id, a_basis, b_basis, a_bit,
       CASE WHEN a_basis <> b_basis THEN free_bit WHEN noise >= 13 THEN a_bit ELSE 1 - a_bit END AS b_bit
FROM v_large_base""")
view("v_samples", """
SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT),
           CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
           CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus)) AS sample_key,
       CASE WHEN l_returnflag <> 'R' THEN 'lhs_warmup' ELSE 'active_learning' END AS phase,
       CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'blind' END AS strategy,
       (l_partkey % 1000) / 1000.0::DOUBLE AS storage_noise_r,
       pow(10::DOUBLE, (l_suppkey % 100) * -3 / 100.0::DOUBLE) AS storage_rate_nu,
       pow(10::DOUBLE, 5 + (l_suppkey % 41) / 10.0::DOUBLE) AS wait_time_ns,
       1 - 2 * l_tax AS channel_fidelity,
       pow(10::DOUBLE, (l_linenumber - 1) / -2.0::DOUBLE) AS detection_efficiency,
       l_discount AS detector_error,
       pow(10::DOUBLE, -3 - (l_quantity - 1) / 10.0::DOUBLE) AS dark_count_prob,
       CAST(round(pow(10::DOUBLE, 4 + (l_orderkey % 201) / 100.0::DOUBLE)) AS BIGINT) AS num_pairs
FROM lineitem""")
view("v_feasible0", """
SELECT *, detection_efficiency * (1 - dark_count_prob) + 2 * dark_count_prob * (1 - detection_efficiency) AS p_click,
       detector_error + (1 - detector_error) * (1 - channel_fidelity) + dark_count_prob * (1 - detection_efficiency) AS p_err,
       (1 - storage_noise_r) / 2 AS q_storage
FROM v_samples""")
view("v_feasible1", """
SELECT * EXCLUDE (p_click, p_err), CASE WHEN p_click > 1e-12 THEN least(0.5, greatest(0.0, p_err / (2 * p_click))) ELSE 0.5 END AS q_channel
FROM v_feasible0""")
view("v_feasible", """
SELECT *, q_storage - q_channel AS margin, (q_storage - q_channel > 1e-6) AND q_channel <= 0.22 AS is_feasible FROM v_feasible1""")
view("v_eval0", """
SELECT *, CAST(ceil(num_pairs * 0.05::DOUBLE) AS BIGINT) AS test_bits, num_pairs - CAST(ceil(num_pairs * 0.05::DOUBLE) AS BIGINT) AS key_bits
FROM v_feasible""")
view("v_eval1", f"""
SELECT *, least(0.5, q_channel + {mu('key_bits', 'test_bits', 1e-10 / 4)}) AS qber_adj, {hbs('storage_noise_r', 'storage_rate_nu')} AS h_min FROM v_eval0""")
view("v_eval2", f"SELECT *, {h('qber_adj')} AS h_adj FROM v_eval1")
view("v_eval", f"""
SELECT *, CASE WHEN key_bits <= 0 THEN 0 ELSE greatest(0, CAST(floor(key_bits * (h_min - 1.16::DOUBLE * h_adj) - {COST!r}) AS BIGINT)) END AS final_length
FROM v_eval2""")
view("v_results", """
SELECT sample_key, phase, strategy, storage_noise_r, storage_rate_nu, wait_time_ns, channel_fidelity, detection_efficiency,
       detector_error, dark_count_prob, num_pairs, q_channel, q_storage, margin,
       CASE WHEN NOT is_feasible THEN 'skipped_infeasible' WHEN final_length > 0 THEN 'success'
            WHEN qber_adj > 0.22 THEN 'failure_qber' ELSE 'failure_security' END AS outcome,
       CASE WHEN is_feasible AND final_length > 0 THEN final_length / num_pairs::DOUBLE ELSE 0.0 END AS net_efficiency,
       CASE WHEN is_feasible THEN key_bits ELSE 0 END AS raw_key_length,
       CASE WHEN is_feasible AND final_length > 0 THEN final_length ELSE 0 END AS final_key_length,
       CASE WHEN is_feasible THEN q_channel END AS qber_measured,
       CASE WHEN is_feasible AND final_length > 0 THEN 1.16::DOUBLE ELSE 0.0 END AS reconciliation_efficiency,
       CASE WHEN is_feasible THEN CAST(floor(key_bits * h_adj * 1.16::DOUBLE) AS BIGINT) ELSE 0 END AS leakage_bits
FROM v_eval""")
view("v_leakage", """
SELECT user_id AS session_id, event_id AS entry_id, ts,
       CASE WHEN event_type = 'click' THEN 32 ELSE 0 END AS syndrome_bits,
       CASE WHEN event_type = 'purchase' THEN 50 ELSE 0 END AS hash_bits,
       least(CAST(floor(value) AS BIGINT), 1000) AS retry_bits,
       CASE WHEN event_type = 'view' AND event_id % 64 > 0 THEN (event_id % 64) * log2(4096.0::DOUBLE / (event_id % 64)) ELSE 0.0 END AS shortening_bits
FROM events""")
view("v_edges", "SELECT DISTINCT l_orderkey AS check_id, l_partkey AS var_id FROM lineitem")
view("v_variables", f"SELECT p_partkey AS var_id, {coin('v', 'p_partkey')} AS bit, {byte_of('punct', 'p_partkey')} < 32 AS punctured FROM part")
view("v_messages", """
SELECT session_id, seq, msg_type, payload, ts, event_id FROM (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
         event_type AS msg_type, props AS payload, ts, event_id FROM events)
WHERE event_id % 97 <> 0""")
