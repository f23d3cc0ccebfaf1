"""Formula columns over the sweep samples (whole table, one output row per sample)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bounds, channel, clib, finite, rates, security, sqlfuncs
from ..functions.stage import staged
from ..session import written
from ..sources import views
from . import oracle as o
from .common import k, out, tidy
from .registry import query

c = F.col


_CAP = f"(CASE WHEN storage_noise_r = 0 OR storage_noise_r = 1 THEN storage_noise_r ELSE 1 - {o.h('(1 + storage_noise_r) / 2')} END)"
_CAP2 = f"(1 - {o.h('1 - storage_noise_r')})"


def q3(df: DataFrame) -> DataFrame:
    return df.withColumn("qber", channel.qber_additive(k.channel_fidelity, k.detector_error, k.detection_efficiency, k.dark_count_prob))


V_Q = f"(SELECT *, {o.q_add()} AS qber FROM v_samples)"


def r9(x: str, n: int = 9) -> str:
    return f"round({x}, {n})"


@query("h1_binary_entropy", f"SELECT sample_key, {r9(o.h('qber'))} AS entropy FROM {V_Q}")
def h1(spark, sf):
    return out(q3(views.samples(spark, sf)), entropy=channel.binary_entropy(c("qber")))


@query("h2_channel_capacity", f"SELECT sample_key, {r9('1 - ' + o.h('least(qber, 0.5)'))} AS capacity FROM {V_Q}")
def h2(spark, sf):
    return out(q3(views.samples(spark, sf)), capacity=channel.channel_capacity(F.least(c("qber"), F.lit(0.5))))


@query("h3_qber_additive", f"SELECT sample_key, {r9(o.q_add(), 13)} AS qber FROM v_samples")
def h3(spark, sf):
    # 13 digits: the sums are short decimals and would tie at fewer
    return out(q3(views.samples(spark, sf)), nd=13, qber=c("qber"))


@query("h4_qber_expected", """SELECT sample_key, round(least(0.5, (1 - channel_fidelity) / 2 + detector_error + dark_count_prob / 2), 9) AS qber FROM v_samples""")
def h4(spark, sf):
    return out(views.samples(spark, sf), qber=channel.qber_expected(k.channel_fidelity, k.dark_count_prob, k.detector_error))


@query("h5_q_channel", "SELECT sample_key, round(q_channel, 9) AS q_channel FROM v_feasible")
def h5(spark, sf):
    return out(views.samples(spark, sf), q_channel=channel.q_channel(k.channel_fidelity, k.detector_error, k.detection_efficiency, k.dark_count_prob))


@query("h6_storage_margin", "SELECT sample_key, round(q_storage, 9) AS q_storage, round(margin, 9) AS margin FROM v_feasible")
def h6(spark, sf):
    return out(views.with_feasibility(views.samples(spark, sf)), q_storage=c("q_storage"), margin=c("margin"))


@query("h7_qber_conditional", """
SELECT sample_key,
  round((eta * ((1 - f) / 2 + e) + (1 - eta) * d * 0.5) / (eta + (1 - eta) * d), 9) AS by_profile,
  round(least((e + (1 - f) / 2 * eta + d * (1 - eta) * 0.5) / (eta + (1 - eta) * d), 0.5), 9) AS by_params
FROM (SELECT sample_key, channel_fidelity f, detector_error e, detection_efficiency eta, dark_count_prob d FROM v_samples)""")
def h7(spark, sf):
    return out(
        views.samples(spark, sf),
        by_profile=channel.qber_conditional_profile(k.channel_fidelity, k.detector_error, k.detection_efficiency, k.dark_count_prob),
        by_params=channel.qber_conditional_params(k.channel_fidelity, k.detector_error, k.detection_efficiency, k.dark_count_prob),
    )


@query("h8_detection_and_margins", f"""
SELECT sample_key, round(eta + (1 - eta) * d, 9) AS p_detect,
  CASE WHEN (1 - eta) * d <= 0 THEN NULL ELSE round(log10(eta / ((1 - eta) * d)), 9) END AS log_snr,
  round(tax + e, 9) AS qber_simple, qber < 0.11 AS is_secure, qber < 0.22 AS is_feasible, round(0.11 - qber, 9) AS margin
FROM (SELECT sample_key, detection_efficiency eta, dark_count_prob d, (1 - channel_fidelity) / 2 AS tax, detector_error e, {o.q_add()} AS qber FROM v_samples)""")
def h8(spark, sf):
    snr = channel.signal_to_noise(k.detection_efficiency, k.dark_count_prob)
    return out(
        q3(views.samples(spark, sf)),
        p_detect=channel.detection_probability(k.detection_efficiency, k.dark_count_prob),
        log_snr=F.when(snr < float("inf"), F.log10(snr)),
        qber_simple=channel.qber_simple(k.channel_fidelity, k.detector_error),
        is_secure=c("qber") < channel.QBER_WARN_LIMIT,
        is_feasible=c("qber") < channel.QBER_HARD_LIMIT,
        margin=channel.QBER_WARN_LIMIT - c("qber"),
    )


@query("h9_finite_size_penalty", f"SELECT sample_key, round({o.mu('key_bits', 'test_bits', 1e-10)}, 9) AS penalty FROM v_eval0")
def h9(spark, sf):
    df = views.samples(spark, sf).withColumn("k", F.ceil(k.num_pairs * 0.05))
    return out(df, penalty=finite.finite_size_penalty(k.num_pairs - c("k"), c("k")))


_PN = "({n} + 1) * pow(mu / 2, {n}) / pow(1 + mu / 2, {n} + 2)"
_NOCLICK = " + ".join(f"{_PN.format(n=i)} * pow(1 - eta, {i}) * (1 - d)" for i in range(20))


@query("h10_pair_emission", f"""
SELECT sample_key, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p1 / (1 - p0), 9) AS single_share,
  round(nc, 9) AS no_click, round(greatest(p0, nc * 0.95), 9) AS no_click_dishonest
FROM (SELECT sample_key, {_PN.format(n=0)} AS p0, {_PN.format(n=1)} AS p1, {_NOCLICK} AS nc
      FROM (SELECT sample_key, 0.01 + storage_noise_r AS mu, detection_efficiency AS eta, dark_count_prob AS d FROM v_samples))""")
def h10(spark, sf):
    df = views.samples(spark, sf).withColumn("mu", 0.01 + k.storage_noise_r)
    return out(
        df,
        p0=channel.pair_emission(0, k.mu),
        p1=channel.pair_emission(1, k.mu),
        single_share=channel.single_pair_share(k.mu),
        no_click=channel.no_click(k.mu, k.detection_efficiency, k.dark_count_prob),
        no_click_dishonest=channel.no_click_dishonest(k.mu, k.detection_efficiency, k.dark_count_prob),
    )


_KM = "(CASE WHEN eta <= 0 OR eta > 0.8 THEN 0.0 ELSE greatest(0.0, -10 * log10(eta / 0.8) / 0.2) END)"


@query("h11_fibre", f"""
SELECT sample_key, round(km / 200000.0 * 1e9, 6) AS delay_ns, round(km * 0.2, 9) AS loss_db, round(pow(10::DOUBLE, -(km * 0.2) / 10), 9) AS transmittance
FROM (SELECT sample_key, {_KM} AS km FROM (SELECT sample_key, detection_efficiency AS eta FROM v_samples))""")
def h11(spark, sf):
    df = views.samples(spark, sf).withColumn("km", bounds.efficiency_to_distance(k.detection_efficiency))
    return out(
        df,
        delay_ns=F.round(channel.fibre_delay_ns(c("km")), 6),
        loss_db=channel.fibre_loss_db(c("km")),
        transmittance=channel.fibre_transmittance(c("km")),
    )


@query("h12_storage_noise", f"""SELECT sample_key, round((1 + storage_noise_r) / 2, 9) AS fidelity, {r9(o.h('(1 - storage_noise_r) / 2'))} AS entropy FROM v_samples""")
def h12(spark, sf):
    return out(views.samples(spark, sf), fidelity=channel.storage_fidelity(k.storage_noise_r), entropy=channel.storage_entropy(k.storage_noise_r))


@query("h13_detector_depolarisation", "SELECT sample_key, round(least(1.0, greatest(0.0, 2 * detector_error)), 9) AS depolar FROM v_samples")
def h13(spark, sf):
    return out(views.samples(spark, sf), depolar=channel.detector_depolarisation(k.detector_error))


@query("h14_collision_entropy", f"SELECT sample_key, {r9(o.coll('storage_noise_r'))} AS collision FROM v_samples")
def h14(spark, sf):
    return out(views.samples(spark, sf), collision=bounds.collision_entropy_rate(k.storage_noise_r))


@query("h15_gamma_inverse")
def h15(spark, sf):
    df = views.samples(spark, sf)
    return out(df, collision=bounds.collision_entropy_rate(k.storage_noise_r), gamma=bounds.dupuis_konig_bound(k.storage_noise_r))


@query("h16_max_bound", f"""
SELECT sample_key, round(1 - storage_noise_r, 9) AS erasure, {r9(o.maxb('storage_noise_r'))} AS max_bound,
  round(least(0.5, {o.maxb('storage_noise_r')}), 9) AS rational,
  CASE WHEN {o.coll('storage_noise_r')} >= 1 - storage_noise_r THEN 'dupuis_konig' ELSE 'lupo' END AS dominant
FROM v_samples""")
def h16(spark, sf):
    return out(
        views.samples(spark, sf),
        erasure=bounds.erasure_bound(k.storage_noise_r),
        max_bound=bounds.max_bound_entropy(k.storage_noise_r),
        rational=bounds.rational_bound(k.storage_noise_r),
        dominant=bounds.dominant_bound(k.storage_noise_r),
    )


@query("h17_bounded_storage_entropy", f"SELECT sample_key, {r9(o.hbs('storage_noise_r', 'storage_rate_nu'))} AS h_min FROM v_samples")
def h17(spark, sf):
    return out(views.samples(spark, sf), h_min=bounds.bounded_storage_entropy(k.storage_noise_r, k.storage_rate_nu))


@query("h18_storage_capacity", f"SELECT sample_key, {r9(_CAP)} AS mixed, {r9(_CAP2)} AS depolar FROM v_samples")
def h18(spark, sf):
    return out(views.samples(spark, sf), mixed=bounds.storage_capacity_mixed(k.storage_noise_r), depolar=bounds.storage_capacity_depolar(k.storage_noise_r))


_EXPO = """1 + ((1 - {x}) * (rate - 1) - (log2(1 + storage_noise_r) + {x} * log2(1 + pow((1 - storage_noise_r) / (1 + storage_noise_r), 1 / {x}))))"""


@query("h19_strong_converse", f"""
WITH RECURSIVE d AS (SELECT DISTINCT storage_noise_r, round(storage_rate_nu, 6) AS rate FROM v_samples),
b AS (SELECT *, 0.01::DOUBLE AS lo, 1 / 1.0001::DOUBLE AS hi, 0 AS i FROM d
  UNION ALL
  SELECT storage_noise_r, rate, CASE WHEN up THEN x1 ELSE lo END, CASE WHEN up THEN hi ELSE x2 END, i + 1 FROM
    (SELECT *, {_EXPO.format(x='x1')} < {_EXPO.format(x='x2')} AS up FROM (SELECT *, lo + (hi - lo) / 3 AS x1, hi - (hi - lo) / 3 AS x2 FROM b WHERE i < 40)))
SELECT round(storage_noise_r, 6) AS storage_noise_r, rate, round(CASE WHEN rate <= {_CAP} THEN 0.0 ELSE greatest(0.0, {_EXPO.format(x='((lo + hi) / 2)')}) END, 6) AS exponent FROM b WHERE i = 40""")
def h19(spark, sf):
    # the exponent depends on (r, rate) only: each distinct pair once
    df = views.samples(spark, sf).select("storage_noise_r", F.round(k.storage_rate_nu, 6).alias("rate")).distinct()
    return tidy(df.withColumn("exponent", bounds.strong_converse_exponent(k.storage_noise_r, k.rate)), 6)


_QH = "least(qber, 0.5)"


@query("h20_extractable_rate", f"SELECT sample_key, {r9(o.hbs('storage_noise_r', 'storage_rate_nu') + ' - 1.16 * ' + o.h(_QH))} AS key_rate FROM {V_Q}")
def h20(spark, sf):
    q = F.least(c("qber"), F.lit(0.5))
    return out(q3(views.samples(spark, sf)), key_rate=bounds.extractable_key_rate(k.storage_noise_r, k.storage_rate_nu, q))


_LOG4 = "23.025850929940457 + 1.3862943611198906"
_MIN_N = f"""(CASE WHEN qber >= 0.11 THEN NULL WHEN qber <= 0 THEN 100 WHEN 1 - 2 * {o.h('qber')} <= 0 THEN NULL
 ELSE CAST(greatest(100, least(floor(pow(({_LOG4}) / (1 - 2 * {o.h('qber')}), 2)), 10000000)) AS BIGINT) END)"""
_TH_EFF = f"""(CASE WHEN qber >= 0.22 OR num_pairs <= 0 OR 1 - 2 * {o.h('least(qber, 0.5)')} <= 0 OR qe >= 0.5 THEN 0.0
 ELSE least(1.0, greatest(0.0, 1 - 2 * {o.h('qe')})) END)"""
V_QE = f"""(SELECT *, qber + {o.mu('(num_pairs - k)', 'k', 1e-10)} AS qe FROM
  (SELECT *, greatest(1, floor(num_pairs * 0.1::DOUBLE)) AS k FROM {V_Q}))"""


@query("h21_theory_limits", f"SELECT sample_key, {_MIN_N} AS min_n, {r9(_TH_EFF)} AS efficiency FROM {V_QE}")
def h21(spark, sf):
    df = q3(views.samples(spark, sf))
    return out(df, min_n=bounds.theory_min_n(c("qber")), efficiency=bounds.theory_efficiency(c("qber"), k.num_pairs))


_MAXD = """
, b AS (SELECT dark_count_prob, 0::DOUBLE AS lo, 500::DOUBLE AS hi, 0 AS i FROM d
  UNION ALL
  SELECT dark_count_prob, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, i + 1 FROM
   (SELECT *, (lo + hi) / 2 AS mid,
      (1 - 0.99::DOUBLE) / 2 + 0.01::DOUBLE + (1 - least(1.0, 0.8::DOUBLE * pow(10::DOUBLE, -0.2::DOUBLE * ((lo + hi) / 2) / 10))) * dark_count_prob / 2 < 0.11 AS ok
    FROM b WHERE i < 9))"""


@query("h22_distance", f"""
WITH RECURSIVE d AS (SELECT DISTINCT dark_count_prob FROM v_samples){_MAXD}
SELECT sample_key, round({_KM}, 9) AS distance_km, round(CASE WHEN {_KM} <= 0 THEN 0.8 ELSE 0.8::DOUBLE * pow(10::DOUBLE, -0.2::DOUBLE * {_KM} / 10) END, 9) AS eta_back, round(b.lo, 9) AS max_km
FROM (SELECT sample_key, detection_efficiency AS eta, dark_count_prob FROM v_samples) s JOIN b ON s.dark_count_prob = b.dark_count_prob AND b.i = 9""")
def h22(spark, sf):
    df = views.samples(spark, sf).withColumn("km", bounds.efficiency_to_distance(k.detection_efficiency))
    return out(
        df, distance_km=c("km"), eta_back=bounds.distance_to_efficiency(c("km")), max_km=bounds.max_distance_km(k.dark_count_prob)
    )


_ZETA = "sqrt(23.718998110500402 / (2 * num_pairs))"


@query("h23_hoeffding", f"""
SELECT sample_key, round(greatest(0.0, eta - {_ZETA}), 9) AS lower, round(least(1.0, eta + {_ZETA}), 9) AS upper,
  CAST(floor(greatest(0.0, eta - {_ZETA}) * num_pairs) AS BIGINT) AS lower_count, CAST(ceil(least(1.0, eta + {_ZETA}) * num_pairs) AS BIGINT) AS upper_count,
  CAST(ceil(7.600902459542082 / (2 * tol * tol)) AS BIGINT) AS needed
FROM (SELECT sample_key, num_pairs, detection_efficiency AS eta, 0.013 + detector_error AS tol FROM v_samples)""")
def h23(spark, sf):
    df = views.samples(spark, sf)
    lo, hi = finite.hoeffding_interval(k.num_pairs, k.detection_efficiency)
    clo, chi = finite.hoeffding_counts(k.num_pairs, k.detection_efficiency)
    return out(df, lower=lo, upper=hi, lower_count=clo, upper_count=chi, needed=finite.samples_for_tolerance(0.013 + k.detector_error))


@query("h24_finite_key_length", "SELECT sample_key, round(qber_adj, 9) AS qber_adj, final_length FROM v_eval")
def h24(spark, sf):
    df = finite.with_finite_key(
        views.with_feasibility(views.samples(spark, sf)), "num_pairs", "q_channel", "storage_noise_r", "storage_rate_nu"
    )
    return out(df, qber_adj=c("qber_adj"), final_length=c("final_length"))


@query("h25_optimal_test_fraction", f"""
SELECT sample_key, max(len) AS best_length, round(min(CASE WHEN len = top THEN frac END), 9) AS best_fraction FROM (
  SELECT *, max(len) OVER (PARTITION BY sample_key, rn) AS top FROM (
    SELECT sample_key, rn, frac, {o.fkl('num_pairs', 'q_channel', 'storage_noise_r', 'storage_rate_nu', 'frac')} AS len
    FROM (SELECT *, row_number() OVER () AS rn FROM v_feasible WHERE is_feasible), (SELECT i / 100.0::DOUBLE AS frac FROM range(1, 51) t(i))))
GROUP BY sample_key, rn""")
def h25(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf)).where("is_feasible")
    best = finite.optimal_test_fraction(k.num_pairs, c("q_channel"), k.storage_noise_r, k.storage_rate_nu)
    return out(df.withColumn("best", best), best_length=c("best.len"), best_fraction=c("best.frac"))


_FKM = o.fkl("mid", "q_channel", "storage_noise_r", "storage_rate_nu")


@query("h26_min_n_for_length", f"""
WITH RECURSIVE d AS (SELECT DISTINCT q_channel, storage_noise_r, storage_rate_nu FROM v_feasible WHERE is_feasible),
b AS (SELECT *, 100::BIGINT AS lo, 10000000::BIGINT AS hi, 0 AS i FROM d
  UNION ALL
  SELECT q_channel, storage_noise_r, storage_rate_nu, CASE WHEN lo < hi AND NOT hit THEN mid + 1 ELSE lo END,
         CASE WHEN lo < hi AND hit THEN mid ELSE hi END, i + 1 FROM
   (SELECT *, {_FKM} >= 1000 AS hit FROM (SELECT *, (lo + hi) // 2 AS mid FROM b WHERE i < 24)))
SELECT round(q_channel, 9) AS q_channel, round(storage_noise_r, 9) AS storage_noise_r, round(storage_rate_nu, 9) AS storage_rate_nu, lo AS min_n FROM b WHERE i = 24""")
def h26(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf)).where("is_feasible")
    # the answer depends on these three columns only: each distinct triple once
    df = df.select("q_channel", "storage_noise_r", "storage_rate_nu").distinct()
    return tidy(df.withColumn("min_n", finite.min_n_for_length(1000, c("q_channel"), k.storage_noise_r, k.storage_rate_nu)))


_PEN = repr(finite.hashing_penalty())


@query("h27_detailed_key_length", f"""
SELECT sample_key, round(avail, 4) AS entropy_available, len AS final_length,
  round(CASE WHEN len > 0 THEN len + {_PEN} ELSE avail END, 4) AS entropy_consumed, len > 0 AS is_viable, round(len / raw_key_length::DOUBLE, 9) AS efficiency,
  CASE WHEN hm - 0.1 <= 0 THEN 1000000000 ELSE CAST(ceil((128 + {_PEN}) / (hm - 0.1)) AS BIGINT) END AS min_input,
  round(greatest(0.0, avail - leakage_bits), 4) AS total_entropy
FROM (SELECT *, greatest(0, CAST(floor(avail - leakage_bits - {_PEN}) AS BIGINT)) AS len FROM
  (SELECT *, hm * raw_key_length AS avail FROM (SELECT *, {o.maxb('storage_noise_r')} AS hm FROM v_results WHERE raw_key_length > 0)))""")
def h27(spark, sf):
    df = views.results(spark, sf).where("raw_key_length > 0")
    d = finite.detailed_key_length(c("raw_key_length"), c("leakage_bits"), k.storage_noise_r)
    return out(
        df,
        entropy_available=F.round(d["entropy_available"], 4),
        final_length=d["final_length"],
        entropy_consumed=F.round(d["entropy_consumed"], 4),
        is_viable=d["is_viable"],
        efficiency=d["efficiency"],
        min_input=finite.min_input_length(128, k.storage_noise_r),
        total_entropy=F.round(finite.total_entropy(c("raw_key_length"), c("leakage_bits"), k.storage_noise_r), 4),
    )


_LAM = repr(2 * 33.21928094887362)


@query("h28_key_length_bound", f"""
SELECT sample_key, round(0.9::DOUBLE - {o.h('q_channel')}, 9) AS smooth_rate,
  greatest(0, CAST(floor(raw_key_length * (1 - {o.h('q_channel')}) - leakage_bits - {_LAM}) AS BIGINT)) AS full_gamma,
  greatest(0, CAST(floor(raw_key_length * (0.9::DOUBLE - {o.h('q_channel')}) - leakage_bits - {_LAM}) AS BIGINT)) AS given_gamma
FROM v_results WHERE raw_key_length > 0""")
def h28(spark, sf):
    df = views.results(spark, sf).where("raw_key_length > 0")
    q = c("q_channel")
    return out(
        df,
        smooth_rate=finite.smooth_rate(q, 0.9),
        full_gamma=finite.key_length_bound(c("raw_key_length"), q, c("leakage_bits")),
        given_gamma=finite.key_length_bound(c("raw_key_length"), q, c("leakage_bits"), gamma=0.9),
    )


_RATE = "(" + o.hbs("storage_noise_r", "storage_rate_nu") + " - 1.16 * " + o.h("q") + ")"
V_CHECKS = f"""(SELECT *, CASE WHEN q > 0.22 THEN 0.22 ELSE 0.11 END AS q_lim, num_pairs * key_rate - {_LAM} AS expected FROM
 (SELECT *, {_CAP} * storage_rate_nu AS used, {o.h('q')} AS hq, {o.maxb('storage_noise_r')} AS hm, {_RATE} AS key_rate FROM
  (SELECT *, least(0.5, (1 - channel_fidelity) / 2 + detector_error + dark_count_prob / 2) AS q FROM v_samples)))"""
SQL_CHECKS = {
    "qber": ("CASE WHEN q > 0.22 THEN 'failed' WHEN q > 0.11 THEN 'warning' ELSE 'passed' END", "q", "q_lim", "q_lim - q"),
    "storage_capacity": ("CASE WHEN used >= 0.5 THEN 'failed' WHEN 0.5 - used < 0.1 THEN 'warning' ELSE 'passed' END", "used", "0.5", "0.5 - used"),
    "strictly_less": ("CASE WHEN hm - hq <= 0 THEN 'failed' WHEN hm - hq < 0.05 THEN 'warning' ELSE 'passed' END", "hq", "hm", "hm - hq"),
    "batch_size": ("CASE WHEN expected <= 0 THEN 'failed' WHEN key_rate < 0.01 THEN 'warning' ELSE 'passed' END", "expected", "0", "expected"),
}
V_CHECK_ROWS = " UNION ALL ".join(
    f"SELECT sample_key, '{n}' AS check_name, {s} AS status, CAST({v} AS DOUBLE) AS value, CAST({t} AS DOUBLE) AS threshold, CAST({m} AS DOUBLE) AS margin FROM {V_CHECKS}"
    for n, (s, v, t, m) in SQL_CHECKS.items()
)


def check_structs(df: DataFrame) -> DataFrame:
    """Samples with q, h, h_min, used, key_rate and their four checks.

    In stages: with every formula written out at each use the generated code
    is too long to be compiled for the machine. Expected bits are differences
    of numbers up to 10^6, so logarithms are the C library's; samples should
    have its powers too.
    """
    df = staged(df, {"q": channel.qber_expected(k.channel_fidelity, k.dark_count_prob, k.detector_error)})
    df = staged(df, {
        "h": channel.binary_entropy(c("q"), clib.log2), "h_min": bounds.max_bound_entropy(k.storage_noise_r, clib.log2),
        "used": bounds.storage_capacity_mixed(k.storage_noise_r, clib.log2) * k.storage_rate_nu,
    })
    df = staged(df, {"key_rate": bounds.key_rate_of(c("h_min"), k.storage_rate_nu, c("h"))})
    df = staged(df, {"expected": security.expected_bits(k.num_pairs, c("key_rate"))})
    return staged(df, {"checks": F.array(
        security.check_qber(c("q")),
        security.check_used(c("used")),
        security.check_entropies(c("h"), c("h_min")),
        security.check_expected(c("expected"), c("key_rate")),
    )})


@query("h29_feasibility_checks", f"SELECT sample_key, check_name, status, round(value, nd) AS value, round(threshold, nd) AS threshold, round(margin, nd) AS margin FROM (SELECT *, CASE check_name WHEN 'batch_size' THEN 4 WHEN 'qber' THEN 13 ELSE 9 END AS nd FROM ({V_CHECK_ROWS}))")
def h29(spark, sf):
    df = check_structs(views.samples(spark, sf, clib.power)).select("sample_key", F.explode("checks").alias("chk"))
    return df.select(
        "sample_key",
        c("chk.check").alias("check_name"),
        c("chk.status").alias("status"),
        *[
            F.when(c("chk.check") == "batch_size", clib.round_half(c(f"chk.{x}"), 4))
            .when(c("chk.check") == "qber", clib.round_half(c(f"chk.{x}"), 13))
            .otherwise(clib.round_half(c(f"chk.{x}"), 9))
            .alias(x)
            for x in ("value", "threshold", "margin")
        ],
    )


@query("d23_preflight_report", f"""
SELECT sample_key, NOT (
  ({SQL_CHECKS['qber'][0]}) = 'failed' OR ({SQL_CHECKS['storage_capacity'][0]}) = 'failed' OR ({SQL_CHECKS['strictly_less'][0]}) = 'failed' OR ({SQL_CHECKS['batch_size'][0]}) = 'failed') AS is_feasible,
  CAST((({SQL_CHECKS['qber'][0]}) = 'warning')::INT + (({SQL_CHECKS['storage_capacity'][0]}) = 'warning')::INT + (({SQL_CHECKS['strictly_less'][0]}) = 'warning')::INT + (({SQL_CHECKS['batch_size'][0]}) = 'warning')::INT AS BIGINT) AS warnings,
  round(least(q_lim - q, 0.5 - used, hm - hq, expected), 6) AS margin, round(key_rate, 9) AS key_rate,
  CASE WHEN key_rate <= 0 THEN 0 ELSE greatest(1, CAST(ceil((128 + {_LAM}) / key_rate) AS BIGINT)) END AS min_batch
FROM {V_CHECKS}""")
def d23(spark, sf):
    # the four checks of a row fold inside the row: no shuffle
    df = check_structs(views.samples(spark, sf, clib.power))
    count = lambda s: F.size(F.filter("checks", lambda x: x["status"] == s))
    return out(
        df,
        is_feasible=count("failed") == 0,
        warnings=count("warning"),
        margin=clib.round_half(F.array_min(F.transform("checks", lambda x: x["margin"])), 6),
        key_rate=clib.round_half(c("key_rate"), 9),
        min_batch=security.min_batch_of(c("key_rate")),
    )


@query("h30_verification", f"""
SELECT sample_key, round(bound, 9) AS storage_noise_bound, round(bound - q_channel, 9) AS security_margin, ok AS capacity_ok,
  q_channel < bound AND q_channel < 0.22 AND ok AS is_secure,
  concat_ws(',', CASE WHEN q_channel >= bound THEN 'storage_bound' END, CASE WHEN q_channel >= 0.22 THEN 'hard_limit' END,
    CASE WHEN q_channel >= 0.11 THEN 'warn_limit' END, CASE WHEN NOT ok THEN 'storage_capacity' END,
    CASE WHEN bound - q_channel > 0 AND bound - q_channel < 0.02 THEN 'narrow_margin' END) AS warnings
FROM (SELECT *, (1 - storage_noise_r) / 2 AS bound, {_CAP2} * storage_rate_nu < 0.5 AS ok FROM v_feasible)""")
def h30(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf))
    return out(df, **security.verification(c("q_channel"), k.storage_noise_r, k.storage_rate_nu))


@query("h31_tolerances", f"""
SELECT sample_key, abs(q_channel - {o.q_add()}) <= 0.01 AS qber_ok, wait_time_ns >= 1e7 * (1.0 - 0.01::DOUBLE) AS wait_ok FROM v_feasible""")
def h31(spark, sf):
    df = q3(views.with_feasibility(views.samples(spark, sf)))
    return out(
        df,
        qber_ok=security.qber_within(c("q_channel"), c("qber")),
        wait_ok=security.wait_long_enough(c("wait_time_ns"), F.lit(1e7)),
    )


@query("h32_leakage_caps", f"""
SELECT sample_key, greatest(0, CAST(trunc(num_pairs * (1 - {o.h('qber')} - 0.01::DOUBLE)) AS BIGINT)) AS cap,
  greatest(0, CAST(trunc(num_pairs * {o.maxb('storage_noise_r')} - 256 - {_LAM}) AS BIGINT)) AS cap_by_entropy,
  greatest(0, CAST(trunc(num_pairs * (1 - (CASE WHEN qber <= 0 OR qber >= 0.5 THEN 0.0 ELSE {o.h('qber')} END)) - (CAST(trunc(0.5::DOUBLE * num_pairs) AS BIGINT) + 50 + 204) - {_LAM}) AS BIGINT)) AS blind_cap
FROM {V_Q}""")
def h32(spark, sf):
    df = q3(views.samples(spark, sf))
    return out(
        df,
        cap=rates.safety_cap(k.num_pairs, c("qber"), 0.01),
        cap_by_entropy=rates.safety_cap_by_entropy(k.num_pairs, bounds.max_bound_entropy(k.storage_noise_r), 256),
        blind_cap=rates.blind_safety_cap(k.num_pairs, c("qber"), 204),
    )


@query("h33_shortening_bits", """
SELECT entry_id, round(shortening_bits, 9) AS shortening, CAST(ceil(syndrome_bits + hash_bits + retry_bits + shortening_bits) AS BIGINT) AS total FROM v_leakage""")
def h33(spark, sf):
    df = views.leakage(spark, sf)
    total = F.ceil(c("syndrome_bits") + c("hash_bits") + c("retry_bits") + c("shortening_bits"))
    return out(df, key="entry_id", shortening=c("shortening_bits"), total=total)


_TGT = f"greatest(0.1, least(1 - 1.22::DOUBLE * {o.h('q_channel')}, 0.9))"
_ENT = o.h("least(q_channel, 0.499)")


@query("h34_rate_target", f"""
SELECT sample_key, {r9(_TGT)} AS target,
  round(CASE WHEN ent < 1e-10 THEN 0.95 WHEN least(0.95, greatest(0.0, 1 - ent)) >= greatest(0.5, greatest(0.0, 1 - 1.22::DOUBLE * ent)) THEN least(0.95, greatest(0.0, 1 - ent))
    WHEN least(greatest(0.0, 1 - ent), 0.95) >= 0.5 THEN least(greatest(0.0, 1 - ent), 0.95) ELSE 0.5 END, 9) AS suggested,
  round(CASE WHEN q_channel <= 0 OR q_channel >= 0.5 THEN 0.5 ELSE greatest(0.51, least(1 - 1.22::DOUBLE * {o.h('q_channel')}, 0.60)) END, 9) AS narrow
FROM (SELECT *, {_ENT} AS ent FROM v_feasible)""")
def h34(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf))
    q = c("q_channel")
    return out(df, target=rates.rate_target(q), suggested=rates.suggested_rate(q), narrow=rates.narrow_rate(q))


_NEAR = f"""(SELECT s.*, CASE WHEN q_channel <= 0 THEN 0.95 WHEN q_channel >= 0.5 THEN 0.5 ELSE near.rate END AS rate FROM
  (SELECT *, {_TGT} AS target FROM v_feasible) s LEFT JOIN
  (SELECT target, arg_min(rate, dist * 1e6 + rate * 1e-9) AS rate FROM (
     SELECT target, rate, round(abs(rate - target), 12) AS dist FROM (SELECT DISTINCT {_TGT} AS target FROM v_feasible), (SELECT i / 100.0::DOUBLE AS rate FROM range(50, 96) t(i)))
   GROUP BY target) near ON s.target = near.target)"""


@query("c7_nearest_rate", f"SELECT sample_key, {r9('target')} AS target, rate FROM {_NEAR}")
def c7(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf))
    return out(df, target=rates.rate_target(c("q_channel")), rate=rates.selected_rate(c("q_channel")))


# Rates of the pattern list.
PATTERN_RATES = (0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)
_PAT = ", ".join(f"({x}::DOUBLE)" for x in PATTERN_RATES)


@query("c8_nearest_pattern", f"""
SELECT sample_key, near.rate AS pattern_rate, near.dist > 0.02 AS is_far FROM (SELECT sample_key, {_TGT} AS target FROM v_feasible) s JOIN
  (SELECT target, arg_min(rate, dist * 1e6 + rate * 1e-9) AS rate, min(dist) AS dist FROM (
     SELECT target, rate, round(abs(rate - target), 12) AS dist FROM (SELECT DISTINCT {_TGT} AS target FROM v_feasible), (VALUES {_PAT}) p(rate))
   GROUP BY target) near ON s.target = near.target""")
def c8(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf)).withColumn("target", rates.rate_target(c("q_channel")))
    pattern = rates.nearest_rate(c("target"), F.array(*[F.lit(x) for x in PATTERN_RATES]))
    df = df.withColumn("pattern_rate", pattern)
    return out(
        df, pattern_rate=c("pattern_rate"), is_far=F.round(F.abs(c("pattern_rate") - c("target")), 12) > 0.02
    )


@query("h35_rate_selection", f"""
SELECT sample_key, rate, greatest(0, 4096 - payload) AS n_shortened,
  CASE WHEN rate <= 0.5 THEN 0 ELSE greatest(0, least(CAST(floor((1 - 0.5::DOUBLE / rate) * 4096) AS BIGINT), 4095)) END AS n_punctured,
  round(CASE WHEN {o.h('q_channel')} > 0 THEN 0.5::DOUBLE / {o.h('q_channel')} ELSE 1.0 END, 6) AS expected_efficiency, CAST(2048 AS BIGINT) AS syndrome_length
FROM (SELECT *, num_pairs % 4096 AS payload FROM {_NEAR})""")
def h35(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf))
    df = df.withColumn("s", rates.rate_selection(c("q_channel"), k.num_pairs % 4096))
    return out(
        df,
        rate=c("s.rate"),
        n_shortened=c("s.n_shortened"),
        n_punctured=c("s.n_punctured"),
        expected_efficiency=F.round(c("s.expected_efficiency"), 6),
        syndrome_length=c("s.syndrome_length"),
    )


@query("h36_blind_start", """
SELECT sample_key, CAST(CASE WHEN q_channel <= 0.05 THEN 0 WHEN q_channel <= 0.10 THEN -455 ELSE -170 END AS BIGINT) AS initial_shortening,
  CAST(CASE WHEN q_channel <= 0.10 THEN 3 ELSE 5 END AS BIGINT) AS max_iterations,
  CASE WHEN q_channel <= 0.05 THEN 0.10 WHEN q_channel <= 0.10 THEN 0.15 ELSE 0.20 END::DOUBLE AS modulation_delta,
  CASE WHEN q_channel > 0.05 THEN least(CAST(floor(204 * 0.1::DOUBLE) AS BIGINT), 204 // 3) ELSE 0 END AS first_disclosure,
  round(CASE WHEN num_pairs % 300 >= 204 THEN 0.5 ELSE 0.5 + 0.5 * ((num_pairs % 300) / 204::DOUBLE) * 0.4::DOUBLE END, 9) AS effective_rate
FROM v_feasible""")
def h36(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf)).withColumn("s", rates.blind_start(c("q_channel")))
    return out(
        df,
        initial_shortening=c("s.initial_shortening"),
        max_iterations=c("s.max_iterations"),
        modulation_delta=c("s.modulation_delta"),
        first_disclosure=rates.initial_disclosure(c("q_channel"), 204, 3),
        effective_rate=rates.effective_blind_rate(F.lit(204), k.num_pairs % 300),
    )


@query("h37_correction_efficiency", f"""
SELECT sample_key, round(CASE WHEN {o.h('q_channel')} > 0 THEN (1 - rate) / {o.h('q_channel')} END, 6) AS efficiency,
  round(q_channel - 1.96::DOUBLE * sqrt(q_channel * (1 - q_channel) / num_pairs), 9) AS lower, round(q_channel + 1.96::DOUBLE * sqrt(q_channel * (1 - q_channel) / num_pairs), 9) AS upper
FROM {_NEAR}""")
def h37(spark, sf):
    df = views.with_feasibility(views.samples(spark, sf))
    q = c("q_channel")
    lo, hi = rates.binomial_interval(q, k.num_pairs)
    return out(
        df, efficiency=F.round(rates.correction_efficiency(rates.selected_rate(q), q), 6), lower=lo, upper=hi
    )


@query("h38_early_viability", f"""
SELECT sample_key, cap >= num_pairs / 2 + 64 * ceil(num_pairs / 4096.0::DOUBLE) AS viable FROM
 (SELECT *, greatest(0, CAST(trunc(num_pairs * (1 - {o.h('qber')})) AS BIGINT)) AS cap FROM {V_Q})""")
def h38(spark, sf):
    df = q3(views.samples(spark, sf))
    return out(df, viable=rates.viable_early(rates.safety_cap(k.num_pairs, c("qber")), k.num_pairs, F.ceil(k.num_pairs / 4096)))


@query("h39_partition_length", "SELECT sample_key, least(final_key_length // 2, raw_key_length // 3, raw_key_length // 5) AS per_partition FROM v_results")
def h39(spark, sf):
    df = views.results(spark, sf)
    raw = c("raw_key_length")
    return out(df, per_partition=rates.partition_length(c("final_key_length"), F.floor(raw / 3), F.floor(raw / 5)))


@query("l_sql_functions", f"""
SELECT sample_key, {r9(o.h('q_channel'))} AS entropy, {r9('q_channel')} AS q, {r9(o.hbs('storage_noise_r', 'storage_rate_nu'))} AS h_min,
  {r9(o.hbs('storage_noise_r', 'storage_rate_nu') + ' - 1.16::DOUBLE * ' + o.h('q_channel'))} AS key_rate FROM v_feasible""")
def l_sql_functions(spark, sf):
    sqlfuncs.register(spark)
    df = views.samples(spark, sf).selectExpr(
        "sample_key", "storage_noise_r AS r", "storage_rate_nu AS nu",
        "q_channel(channel_fidelity, detector_error, detection_efficiency, dark_count_prob) AS q",
    )
    return tidy(
        df.selectExpr("sample_key", "binary_entropy(q) AS entropy", "q", "bounded_storage_entropy(r, nu) AS h_min", "extractable_key_rate(r, nu, q) AS key_rate")
    )


def _arguments() -> dict[str, Column]:
    """Values for the formulas' parameters, from the columns of the samples."""
    return {
        "fidelity": k.channel_fidelity, "e_det": k.detector_error, "eta": k.detection_efficiency, "p_dark": k.dark_count_prob, "r": k.storage_noise_r, "nu": k.storage_rate_nu,
        "p": k.q, "q": k.q, "qber": k.q, "measured": k.q, "expected": k.q + 0.01 * k.storage_noise_r, "mu": 0.1 + k.storage_noise_r, "n": k.num_pairs, "k": F.ceil(k.num_pairs * 0.05),
        "block": k.num_pairs, "km": k.detector_error * 1000, "length_km": k.detector_error * 1000, "rate": 0.3 + 0.5 * k.storage_noise_r, "x": k.storage_noise_r - 0.3,
        "tolerance": 0.01 + k.detector_error, "leak": F.floor(k.num_pairs * 0.2), "target": 0.5 + 0.4 * k.storage_noise_r, "h_min": k.storage_noise_r, "cap": F.floor(k.num_pairs * 0.6),
        "blocks": F.ceil(k.num_pairs / 4096), "final": F.floor(k.num_pairs / 4), "i0": F.floor(k.num_pairs / 3), "i1": F.floor(k.num_pairs / 5), "d": F.lit(400.0), "shortened": F.floor(k.q * 300),
        "payload": 4000 - F.floor(k.q * 1000), "actual_ns": k.wait_time_ns * (0.98 + 0.04 * k.storage_noise_r), "required_ns": k.wait_time_ns, "n_shortened": F.floor(k.q * 300), "frame": F.lit(4096.0),
        "bits": k.num_pairs, "bit": (k.num_pairs % 2).cast("int"), "basis": (k.num_pairs % 2).cast("int"), "punctured": k.num_pairs % 8 == 0, "gamma": k.storage_noise_r,
    }


# every formula once as a column and once as the SQL function made from it
@query("l_all_formulas", "SELECT unnest([" + ", ".join(f"'{f.__name__}'" for f in sqlfuncs.SCALAR) + "]) AS formula, n AS n_rows, n AS n_equal FROM (SELECT count(*) AS n FROM v_samples)")
def l_all(spark, sf):
    sqlfuncs.register(spark)
    df = views.samples(spark, sf)
    df = df.withColumn("q", channel.q_channel(k.channel_fidelity, k.detector_error, k.detection_efficiency, k.dark_count_prob))
    needed = {n: t for f in sqlfuncs.SCALAR for n, t in sqlfuncs.parameters(f).items()}
    values = _arguments()
    rows = written(df.select(*[values[n].cast(t).alias(f"a_{n}") for n, t in needed.items()]), "arguments")
    same = []
    for f in sqlfuncs.SCALAR:
        names = [f"a_{n}" for n in sqlfuncs.parameters(f)]
        as_column = sqlfuncs.as_one(f(*[c(n) for n in names]))
        same.append(F.count_if(as_column.eqNullSafe(F.expr(f"{f.__name__}({', '.join(names)})"))).alias(f.__name__))
    counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), *same)
    return counts.unpivot(["n_rows"], [f.__name__ for f in sqlfuncs.SCALAR], "formula", "n_equal")


@query("l_table_functions", """
SELECT session_id, n AS total, b AS batch_id, b * 16 AS start, least(16, n - b * 16) AS length, (CASE WHEN n > 20 THEN 4 ELSE 3 END)::BIGINT AS slices FROM (
  SELECT session_id, n, unnest(range(0, (n + 15) // 16)) AS b FROM (SELECT session_id, count(*) AS n FROM v_pairs GROUP BY 1))""")
def l_tables(spark, sf):
    sqlfuncs.register(spark)
    views.pairs(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("total")).createOrReplaceTempView("session_sizes")
    return spark.sql("""
        SELECT s.session_id, s.total, b.batch_id, b.start, b.length, i.slices FROM session_sizes s, LATERAL generation_batches(s.total, 16L) b,
          LATERAL (SELECT count(*) AS slices FROM disclosure_slices(20L, 3L, IF(s.total > 20, 0.06D, 0.04D))) i""")
