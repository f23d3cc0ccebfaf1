"""Row contracts, encodings and outcome columns (groups B, A5-A8, G1, H50-H52)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, bounds, channel
from ..functions.stage import staged
from ..operators import contracts as rules
from ..operators import sweep
from ..sources import views
from . import oracle as o
from .common import k, out, tidy
from .registry import query
from .scalar import _KM, _TH_EFF

c = F.col


@query("b1_round_flags", """
SELECT session_id, round_id, detected AS is_valid, a_basis = b_basis AS bases_match, a_bit = b_bit AS outcomes_match,
  detected AND a_basis = b_basis AS contributes, detected AND a_basis = b_basis AND a_bit <> b_bit AS has_error FROM v_pairs""")
def b1(spark, sf):
    p = views.pairs(spark, sf)
    match, same = c("a_basis") == c("b_basis"), c("a_bit") == c("b_bit")
    return p.select(
        "session_id", "round_id", c("detected").alias("is_valid"), match.alias("bases_match"), same.alias("outcomes_match"),
        (c("detected") & match).alias("contributes"), (c("detected") & match & ~same).alias("has_error"),
    )


@query("b2_encode_samples", """
SELECT sample_key, storage_noise_r, round(log10(storage_rate_nu), 9) AS log_storage_rate_nu, round(log10(wait_time_ns), 9) AS log_wait_time_ns,
  round(channel_fidelity, 9) AS channel_fidelity, round(log10(detection_efficiency), 9) AS log_detection_efficiency, round(detector_error, 9) AS detector_error,
  round(log10(dark_count_prob), 9) AS log_dark_count_prob, round(log10(num_pairs::DOUBLE), 9) AS log_num_pairs,
  CASE WHEN strategy = 'baseline' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS strategy_code FROM v_samples""")
def b2(spark, sf):
    return tidy(sweep.encode(views.samples(spark, sf)).select("sample_key", *sweep.FEATURES))


@query("b3_decode_features", """
SELECT sample_key, round(storage_rate_nu, 9) AS storage_rate_nu, round(wait_time_ns, 2) AS wait_time_ns, round(detection_efficiency, 9) AS detection_efficiency,
  round(dark_count_prob, 12) AS dark_count_prob, num_pairs, num_pairs AS num_pairs_truncated, strategy FROM v_samples""")
def b3(spark, sf):
    enc = sweep.encode(views.samples(spark, sf)).select("sample_key", *sweep.FEATURES)
    back = sweep.decode(enc)
    cut = F.floor(F.pow(F.lit(10.0), c("log_num_pairs")) + 1e-6)
    return tidy(
        back.select("sample_key", "storage_rate_nu", "wait_time_ns", "detection_efficiency", "dark_count_prob", "num_pairs",
                    cut.alias("num_pairs_truncated"), "strategy"),
        wait_time_ns=2, dark_count_prob=12,
    )


@query("b4_sample_ranges", """
SELECT sample_key, concat_ws(',', CASE WHEN NOT (storage_noise_r BETWEEN 0 AND 1) THEN 'storage_noise_r' END,
  CASE WHEN NOT (storage_rate_nu BETWEEN 0 AND 1) THEN 'storage_rate_nu' END, CASE WHEN NOT (wt BETWEEN 1e5 AND 1e11) THEN 'wait_time_ns' END,
  CASE WHEN NOT (channel_fidelity > 0.5 AND channel_fidelity <= 1) THEN 'channel_fidelity' END,
  CASE WHEN NOT (detection_efficiency > 0 AND detection_efficiency <= 1) THEN 'detection_efficiency' END,
  CASE WHEN NOT (detector_error BETWEEN 0 AND 0.1) THEN 'detector_error' END,
  CASE WHEN NOT (dp BETWEEN 1e-9 AND 1e-3) THEN 'dark_count_prob' END,
  CASE WHEN NOT (num_pairs BETWEEN 10000 AND 1000000000) THEN 'num_pairs' END) AS violations
FROM (SELECT * EXCLUDE (num_pairs), num_pairs - 12000 AS num_pairs, wait_time_ns / 2.5 AS wt, dark_count_prob * 2.1 AS dp FROM v_samples)""")
def b4(spark, sf):
    # shifted values, so that some rows do break a range
    df = views.samples(spark, sf).withColumns(
        {"num_pairs": k.num_pairs - 12000, "wait_time_ns": k.wait_time_ns / 2.5, "dark_count_prob": k.dark_count_prob * 2.1}
    )
    return df.select("sample_key", rules.violated(rules.sample_range_rules()).alias("violations"))


@query("b5_parameter_contracts", """
SELECT sample_key,
  concat_ws(',', CASE WHEN NOT (r BETWEEN 0 AND 1) THEN 'INV-NSM-001' END, CASE WHEN NOT (nu BETWEEN 0 AND 1) THEN 'INV-NSM-002' END,
    CASE WHEN dim <> 2 THEN 'INV-NSM-003' END, CASE WHEN dt <= 0 THEN 'INV-NSM-004' END,
    CASE WHEN NOT (f > 0.5 AND f <= 1) THEN 'INV-NSM-005' END, CASE WHEN NOT (eta > 0 AND eta <= 1) THEN 'INV-NSM-006' END) AS storage_model,
  concat_ws(',', CASE WHEN NOT (f > 0.5 AND f <= 1) THEN 'INV-CNP-001' END, CASE WHEN NOT (eta > 0 AND eta <= 1) THEN 'INV-CNP-002' END,
    CASE WHEN NOT (e BETWEEN 0 AND 0.5) THEN 'INV-CNP-003' END, CASE WHEN NOT (d BETWEEN 0 AND 1) THEN 'INV-CNP-004' END,
    CASE WHEN NOT (loss >= 0 AND loss < 1) THEN 'INV-CNP-005' END) AS channel_profile,
  concat_ws(',', CASE WHEN len < 0 THEN 'INV-CH-001' END, CASE WHEN att < 0 THEN 'INV-CH-002' END, CASE WHEN speed <= 0 THEN 'INV-CH-003' END,
    CASE WHEN t1 <= 0 THEN 'INV-CH-004' END, CASE WHEN NOT (t2 > 0 AND t2 <= t1) THEN 'INV-CH-005' END, CASE WHEN cyc <= 0 THEN 'INV-CH-006' END) AS fibre
FROM (SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS sample_key, l_partkey % 1100 / 1000.0 AS r, l_suppkey % 100 / 90.0 AS nu, 2 + l_orderkey % 50 // 49 AS dim,
  l_orderkey % 20 AS dt, 1 - 8 * l_tax AS f, (l_linenumber - 1) / 5.0 AS eta, l_discount * 6 AS e, l_quantity / 49 AS d, l_discount * 10 AS loss,
  l_partkey % 10 - 1 AS len, l_suppkey % 8 - 1 AS att, l_orderkey % 30 AS speed, l_quantity - 1 AS t1, l_linenumber * 6 - 6 AS t2, l_orderkey % 9 AS cyc FROM lineitem)""")
def b5(spark, sf):
    li = views.read_table(spark, sf, "lineitem")
    df = li.select(
        F.md5(F.concat_ws("|", *[c(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])).alias("sample_key"),
        (c("l_partkey") % 1100 / 1000.0).alias("r"), (c("l_suppkey") % 100 / 90.0).alias("nu"),
        (2 + F.floor(c("l_orderkey") % 50 / 49)).alias("dim"), (c("l_orderkey") % 20).alias("dt"), (1 - 8 * c("l_tax")).alias("f"),
        ((c("l_linenumber") - 1) / 5.0).alias("eta"), (c("l_discount") * 6).alias("e"), (c("l_quantity") / 49).alias("d"),
        (c("l_discount") * 10).alias("loss"), (c("l_partkey") % 10 - 1).alias("len"), (c("l_suppkey") % 8 - 1).alias("att"),
        (c("l_orderkey") % 30).alias("speed"), (c("l_quantity") - 1).alias("t1"), (c("l_linenumber") * 6 - 6).alias("t2"),
        (c("l_orderkey") % 9).alias("cyc"),
    )
    return df.select(
        "sample_key",
        rules.violated(rules.storage_model_rules(k.r, k.nu, k.dim, k.dt, k.f, k.eta)).alias("storage_model"),
        rules.violated(rules.channel_profile_rules(k.f, k.eta, k.e, k.d, k.loss)).alias("channel_profile"),
        rules.violated(rules.fibre_rules(k.len, k.att, k.speed, k.t1, k.t2, k.cyc)).alias("fibre"),
    )


@query("b6_measurement_contracts", """
SELECT round_id, concat_ws(',', CASE WHEN round_id - 500 < 0 THEN 'INV-MEAS-001' END, CASE WHEN o NOT IN (0, 1) THEN 'INV-MEAS-002' END,
  CASE WHEN b NOT IN (0, 1) THEN 'INV-MEAS-003' END, CASE WHEN t < 0 THEN 'INV-MEAS-004' END) AS violations
FROM (SELECT round_id, a_bit + CASE WHEN round_id % 53 = 0 THEN 1 ELSE 0 END AS o, a_basis + CASE WHEN round_id % 71 = 0 THEN 1 ELSE 0 END AS b, round_id % 1000 - 3 AS t FROM v_pairs)""")
def b6(spark, sf):
    p = views.pairs(spark, sf)
    bump = lambda n: F.when(c("round_id") % n == 0, 1).otherwise(0)
    r = rules.measurement_rules(c("round_id") - 500, c("a_bit") + bump(53), c("a_basis") + bump(71), c("round_id") % 1000 - 3)
    return p.select("round_id", rules.violated(r).alias("violations"))


@query("b8_feasibility_filter", """
SELECT sample_key, round(margin, 9) AS margin, CASE WHEN is_feasible THEN 'run' ELSE 'skipped_infeasible' END AS outcome FROM v_feasible""")
def b8(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf))
    return out(df, margin=c("margin"), outcome=F.when(c("is_feasible"), "run").otherwise("skipped_infeasible"))


@query("b9_outcome_classifier", """
SELECT event_id, CASE WHEN err IS NOT NULL THEN (CASE WHEN lower(err) LIKE '%timeout%' THEN 'failure_timeout' WHEN lower(err) LIKE '%qber%' THEN 'failure_qber'
    WHEN lower(err) LIKE '%reconciliation%' OR lower(err) LIKE '%ldpc%' THEN 'failure_reconciliation' WHEN lower(err) LIKE '%security%' THEN 'failure_security' ELSE 'failure_error' END)
  WHEN aborted THEN (CASE WHEN lower(err2) LIKE '%qber%' THEN 'failure_qber' WHEN lower(err2) LIKE '%reconciliation%' THEN 'failure_reconciliation' WHEN lower(err2) LIKE '%security%' THEN 'failure_security' ELSE 'failure_error' END)
  WHEN key_length <= 0 THEN 'failure_security' ELSE 'success' END AS outcome
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN txt END AS err, event_type = 'view' AS aborted, txt AS err2, CAST(floor(value) AS BIGINT) - 2 AS key_length FROM (
  SELECT *, CASE event_id % 6 WHEN 0 THEN 'Socket TIMEOUT while QBER' WHEN 1 THEN 'QBER too high' WHEN 2 THEN 'LDPC failed' WHEN 3 THEN 'Reconciliation failed' WHEN 4 THEN 'security bound' ELSE 'disk full' END AS txt FROM events))""")
def b9(spark, sf):
    ev = views.read_table(spark, sf, "events")
    m = c("event_id") % 6
    txt = (
        F.when(m == 0, "Socket TIMEOUT while QBER").when(m == 1, "QBER too high").when(m == 2, "LDPC failed")
        .when(m == 3, "Reconciliation failed").when(m == 4, "security bound").otherwise("disk full")
    )
    outcome = sweep.classify(
        F.when(c("event_type") == "error", txt), c("event_type") == "view", txt, F.floor("value") - 2
    )
    return ev.select("event_id", outcome.alias("outcome"))


@query("b10_result_rows", """
SELECT sample_key, outcome, round(net_efficiency, 9) AS net_efficiency, raw_key_length, final_key_length, round(qber_measured, 9) AS qber_measured, leakage_bits FROM v_results""")
def b10(spark, sf):
    df = views.results(spark, sf)
    return tidy(df.select("sample_key", "outcome", "net_efficiency", "raw_key_length", "final_key_length", "qber_measured", "leakage_bits"))


@query("b11_link_model", """
SELECT sample_key, CASE WHEN channel_fidelity = 1 AND detection_efficiency = 1 AND d = 0 AND detector_error = 0 THEN 'perfect'
  WHEN detection_efficiency < 1 OR d > 0 THEN 'heralded-double-click' ELSE 'depolarise' END AS link
FROM (SELECT *, CASE WHEN dark_count_prob < 1e-6 THEN 0 ELSE dark_count_prob END AS d FROM v_samples)""")
def b11(spark, sf):
    d = F.when(k.dark_count_prob < 1e-6, F.lit(0.0)).otherwise(k.dark_count_prob)
    return out(views.samples(spark, sf), link=channel.link_model(k.channel_fidelity, k.detection_efficiency, d, k.detector_error))


@query("b12_success_only", "SELECT sample_key, round(net_efficiency, 9) AS net_efficiency FROM v_results WHERE outcome = 'success'")
def b12(spark, sf):
    return out(views.results(spark, sf).where("outcome = 'success'"), net_efficiency=c("net_efficiency"))


@query("b13_strategy_split", "SELECT strategy_code < 0.5 AS is_baseline, count(*) AS n FROM (SELECT CASE WHEN strategy = 'baseline' THEN 0.0 ELSE 1.0 END AS strategy_code FROM v_samples) GROUP BY 1")
def b13(spark, sf):
    return sweep.encode(views.samples(spark, sf)).groupBy((c("strategy_code") < 0.5).alias("is_baseline")).agg(F.count(F.lit(1)).alias("n"))


def report_rows(df):
    """Results with the derived report columns, nothing computed twice."""
    df = staged(df, {"qber": channel.qber_additive(k.channel_fidelity, k.detector_error, k.detection_efficiency, k.dark_count_prob)})
    return staged(
        df,
        {
            "distance_km": bounds.efficiency_to_distance(k.detection_efficiency),
            "is_success": c("net_efficiency") > 0,
            "theoretical_eff": bounds.theory_efficiency(c("qber"), k.num_pairs),
        },
    ).withColumn("eff_gap", c("theoretical_eff") - c("net_efficiency"))


_RQ = f"(SELECT *, {o.q_add()} AS qber FROM v_results)"
V_REPORT = f"""(SELECT *, theoretical_eff - net_efficiency AS eff_gap FROM (SELECT *, {_KM.replace('eta', 'detection_efficiency')} AS distance_km, net_efficiency > 0 AS is_success, {_TH_EFF} AS theoretical_eff
  FROM (SELECT *, qber + {o.mu('(num_pairs - k)', 'k', 1e-10)} AS qe FROM (SELECT *, greatest(1, floor(num_pairs * 0.1::DOUBLE)) AS k FROM {_RQ}))))"""


@query("b14_report_columns", f"""
SELECT sample_key, round(qber, 13) AS qber, round(distance_km, 9) AS distance_km, is_success, round(theoretical_eff, 9) AS theoretical_eff, round(eff_gap, 9) AS eff_gap FROM {V_REPORT}""")
def b14(spark, sf):
    df = report_rows(views.results(spark, sf))
    return tidy(df.select("sample_key", "qber", "distance_km", "is_success", "theoretical_eff", "eff_gap"), qber=13)


@query("h50_labels", """
SELECT round_id, CASE WHEN a_basis = 0 THEN 'Z' ELSE 'X' END AS basis, (round_id % 20) * 5 || '%-' || ((round_id % 20) * 5 + 5) || '%' AS percent FROM v_pairs""")
def h50(spark, sf):
    p = views.pairs(spark, sf)
    lo = c("round_id") % 20 * 0.05
    return p.select("round_id", bits.basis_label(c("a_basis")).alias("basis"), bits.percent_label(lo, lo + 0.05).alias("percent"))


@query("h52_error_text", """
SELECT sample_key, round(margin, 4) AS margin, round(q_channel, 4) AS q_channel, round(q_storage, 4) AS q_storage FROM v_results WHERE outcome = 'skipped_infeasible'""")
def h52(spark, sf):
    df = views.results(spark, sf).where("outcome = 'skipped_infeasible'")
    text = sweep.infeasible_text(c("margin"), c("q_channel"), c("q_storage"))
    got = sweep.parse_infeasible(c("error_message"))
    parsed = df.select("sample_key", text.alias("error_message")).select("sample_key", *[v.alias(n) for n, v in got.items()])
    return tidy(parsed, 4)
