"""Sweep reports: level and grid joins, aggregates, windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import report
from ..session import written
from ..sources import views
from .common import k, tidy
from .contracts import V_REPORT, report_rows
from .registry import query
from .scalar import _MIN_N

c = F.col


def report_input(spark, sf) -> DataFrame:
    return report_rows(views.results(spark, sf))


def _values(xs) -> str:
    return ", ".join(f"({x!r}::DOUBLE)" for x in xs)


_LEVELS = f"(SELECT * FROM (VALUES {_values(report.QBER_LEVELS)}) t(level))"
_IN_LEVEL = "round(s.qber - (l.level - 0.005::DOUBLE), 9) >= 0 AND round(s.qber - (l.level + 0.005::DOUBLE), 9) < 0"
_RL = f"(SELECT * FROM (VALUES {_values(report.R_LEVELS)}) t(r_level))"
_DL = f"(SELECT * FROM (VALUES {_values([math.log10(d) for d in report.DARK_LEVELS])}) t(d_level))"
_IN_GRID = """round(s.storage_noise_r - (g.r_level - 0.05::DOUBLE), 9) >= 0 AND round(s.storage_noise_r - (g.r_level + 0.05::DOUBLE), 9) < 0
 AND round(log10(s.dark_count_prob) - (g.d_level - 0.5::DOUBLE), 9) >= 0 AND round(log10(s.dark_count_prob) - (g.d_level + 0.5::DOUBLE), 9) < 0"""


@query("c9_qber_levels", f"""
SELECT round(l.level, 9) AS level, count(s.sample_key) AS n FROM {_LEVELS} l LEFT JOIN {V_REPORT} s ON {_IN_LEVEL} GROUP BY 1""")
def c9(spark, sf):
    seen = report.by_qber_level(report_input(spark, sf)).groupBy("level").count()
    every = report.levels_table(spark, level=report.QBER_LEVELS)
    return tidy(every.join(seen, "level", "left").select("level", F.coalesce("count", F.lit(0)).alias("n")))


@query("c10_noise_dark_grid", f"""
SELECT round(r_level, 9) AS r_level, round(d_level, 9) AS log_dark_level, count(s.sample_key) AS n
FROM (SELECT * FROM {_RL}, {_DL}) g LEFT JOIN v_results s ON {_IN_GRID} GROUP BY 1, 2""")
def c10(spark, sf):
    seen = report.by_grid(views.results(spark, sf)).groupBy("r_level", "log_dark_level").count()
    logs = [math.log10(d) for d in report.DARK_LEVELS]
    every = report.levels_table(spark, r_level=report.R_LEVELS, log_dark_level=logs)
    return tidy(every.join(seen, ["r_level", "log_dark_level"], "left").select("r_level", "log_dark_level", F.coalesce("count", F.lit(0)).alias("n")))


# Surface grid, 20 points per axis.
ETA_GRID = [round(0.6 + 0.39 * i / 19, 12) for i in range(20)]
DARK_GRID = [10 ** (-7 + 4 * i / 19) for i in range(20)]


@query("c11_nearest_surface", f"""
SELECT round(gx, 9) AS eta, round(gy, 12) AS p_dark, round(max(CASE WHEN strategy = 'baseline' THEN v END), 9) AS baseline,
  round(max(CASE WHEN strategy = 'blind' THEN v END), 9) AS blind, round(max(CASE WHEN strategy = 'baseline' THEN v END) - max(CASE WHEN strategy = 'blind' THEN v END), 9) AS gap
FROM (SELECT strategy, gx, gy, v FROM (
  SELECT strategy, gx, gy, v, row_number() OVER (PARTITION BY strategy, gx, gy ORDER BY round((x - gx) * (x - gx) + (y - gy) * (y - gy), 15), t) AS rn
  FROM (SELECT strategy, detection_efficiency AS x, dark_count_prob AS y, min(sample_key) AS t, arg_min(net_efficiency, sample_key) AS v FROM v_results GROUP BY 1, 2, 3),
   (VALUES {_values(ETA_GRID)}) a(gx), (VALUES {_values(DARK_GRID)}) b(gy)) WHERE rn = 1)
GROUP BY gx, gy""")
def c11(spark, sf):
    df = views.results(spark, sf).select("strategy", "detection_efficiency", "dark_count_prob", "net_efficiency", "sample_key")
    near = report.nearest_surface(
        df, ETA_GRID, DARK_GRID, "detection_efficiency", "dark_count_prob", "strategy", "net_efficiency", "sample_key"
    )
    one = lambda s: F.max(F.when(c("strategy") == s, c("value")))
    wide = near.groupBy(c("gx").alias("eta"), c("gy").alias("p_dark")).agg(
        one("baseline").alias("baseline"), one("blind").alias("blind"), (one("baseline") - one("blind")).alias("gap")
    )
    return tidy(wide, p_dark=12)


_EDGES = list(zip(report.QBER_BINS[:-1], report.QBER_BINS[1:]))
_BIN = "CASE " + " ".join(f"WHEN qber > {lo!r}::DOUBLE AND qber <= {hi!r}::DOUBLE THEN '{lo:.0%}-{hi:.0%}'" for lo, hi in _EDGES) + " END"


@query("d15_qber_bins", f"""
SELECT qber_bin, round(avg(net_efficiency), 9) AS net_efficiency_mean, round(stddev_samp(net_efficiency), 9) AS net_efficiency_std,
  round(min(net_efficiency), 9) AS net_efficiency_min, round(max(net_efficiency), 9) AS net_efficiency_max, min(num_pairs) AS num_pairs_min,
  CAST(median(num_pairs) AS DOUBLE) AS num_pairs_median, max(num_pairs) AS num_pairs_max, count(*) FILTER (is_success) AS is_success_sum,
  round(avg(is_success::INT), 9) AS is_success_mean, round(avg(distance_km), 6) AS distance_km_mean, round(max(distance_km), 6) AS distance_km_max
FROM (SELECT *, {_BIN} AS qber_bin FROM {V_REPORT}) WHERE qber_bin IS NOT NULL GROUP BY 1""")
def d15(spark, sf):
    # distances are means of sums near 10^6: the ninth digit depends on the order of addition
    return tidy(report.qber_bins(report_input(spark, sf)), distance_km_mean=6, distance_km_max=6)


@query("d16_strategy_aggregate", f"""
SELECT strategy, round(avg(net_efficiency), 9) AS eff_mean, round(stddev_samp(net_efficiency), 9) AS eff_std, round(min(net_efficiency), 9) AS eff_min,
  round(max(net_efficiency), 9) AS eff_max, count(net_efficiency) AS eff_count, round(avg(qber), 9) AS qber_mean, round(stddev_samp(qber), 9) AS qber_std,
  count(*) FILTER (is_success) AS success_sum, round(avg(is_success::INT), 9) AS success_mean FROM {V_REPORT} GROUP BY 1""")
def d16(spark, sf):
    return tidy(report.by_strategy(report_input(spark, sf)))


_DV = f"""
SELECT round(qber * 100, 6) AS qber_percent, {_MIN_N} AS min_n_theoretical, min_n_empirical,
  CASE WHEN n = 0 THEN 'NO DATA' WHEN min_n_empirical IS NULL THEN 'FAIL' ELSE 'OK' END AS state,
  round(min_n_empirical / CAST({_MIN_N} AS DOUBLE), 6) AS safety_factor, CASE WHEN n > 0 THEN round(ok / n::DOUBLE * 100, 6) END AS success_rate_percent
FROM (SELECT l.level AS qber, count(s.sample_key) AS n, count(*) FILTER (s.is_success) AS ok, min(CASE WHEN s.is_success THEN s.num_pairs END) AS min_n_empirical
  FROM {_LEVELS} l LEFT JOIN {V_REPORT} s ON {_IN_LEVEL} GROUP BY 1)"""


@query("d17_death_valley", _DV)
def d17(spark, sf):
    return tidy(report.death_valley(report_input(spark, sf)), 6)


# Without data the distance comes from the formula: a dark count rate up to 0.19
# never reaches the limit, so all nine halvings of [0, 500] km go up.
_FG = f"""
SELECT round(r_level, 6) AS storage_noise_r, round(d_level, 6) AS log_dark_level,
  CASE WHEN r_level >= 0.85::DOUBLE THEN 'Weak' WHEN r_level >= 0.75::DOUBLE THEN 'Moderate' ELSE 'Strong' END AS adversary_strength,
  round(CASE WHEN n = 0 THEN (CASE WHEN pow(10::DOUBLE, d_level) <= 0.19 THEN 500 - 500 / 512::DOUBLE END) WHEN ok = 0 THEN 0.0 ELSE km END, 6) AS max_distance_km,
  CASE WHEN n = 0 THEN 'Theoretical' WHEN ok = 0 THEN 'Always Insecure' WHEN ok = n THEN 'Not Limited' WHEN fq > 0.11 THEN 'QBER Threshold'
    WHEN r_level < 0.8::DOUBLE THEN 'NSM Security Bound' ELSE 'Signal-to-Noise' END AS limiting_factor
FROM (SELECT r_level, d_level, count(s.sample_key) AS n, count(*) FILTER (s.is_success) AS ok, max(CASE WHEN s.is_success THEN s.distance_km END) AS km,
   avg(CASE WHEN NOT s.is_success THEN s.qber END) AS fq FROM (SELECT * FROM {_RL}, {_DL}) g LEFT JOIN {V_REPORT} s ON {_IN_GRID} GROUP BY 1, 2)"""


@query("d18_feasibility_table", _FG)
def d18(spark, sf):
    return tidy(report.feasibility_grid(report_input(spark, sf)), 6)


_SG = f"""
WITH a AS (SELECT
   count(*) FILTER (num_pairs < 5000) AS small_n, avg(net_efficiency) FILTER (num_pairs < 5000 AND strategy = 'baseline') AS sb, avg(net_efficiency) FILTER (num_pairs < 5000 AND strategy = 'blind') AS sd,
   count(*) FILTER (channel_fidelity > 0.98::DOUBLE) AS high_n, avg(net_efficiency) FILTER (channel_fidelity > 0.98::DOUBLE AND strategy = 'baseline') AS hb, avg(net_efficiency) FILTER (channel_fidelity > 0.98::DOUBLE AND strategy = 'blind') AS hd,
   count(*) FILTER (dark_count_prob > 1e-4) AS burst_n, coalesce(avg(is_success::INT) FILTER (dark_count_prob > 1e-4 AND strategy = 'baseline'), 0) AS bb, coalesce(avg(is_success::INT) FILTER (dark_count_prob > 1e-4 AND strategy = 'blind'), 0) AS bd,
   count(*) FILTER (net_efficiency > 0 AND net_efficiency < 0.05 AND strategy = 'baseline') AS tb, count(*) FILTER (net_efficiency > 0 AND net_efficiency < 0.05 AND strategy = 'blind') AS td
 FROM {V_REPORT})
SELECT 'few_pairs_below_5000' AS scenario, CASE WHEN sd > sb THEN 'Blind' ELSE 'Baseline' END AS recommended_strategy, CASE WHEN sd > sb THEN round(CASE WHEN sb > 0 THEN (sd - sb) / sb * 100 ELSE 0 END, 6) END AS expected_gain_percent,
   CASE WHEN sd > sb THEN 'blind_mean_higher' ELSE 'baseline_mean_not_lower' END AS rationale FROM a WHERE small_n > 0
UNION ALL SELECT 'fidelity_above_0.98', CASE WHEN hb >= hd THEN 'Baseline' ELSE 'Blind' END, round(abs(hb - hd) / greatest(hb, hd, 0.001) * 100, 6),
   CASE WHEN hb >= hd THEN 'baseline_mean_not_lower' ELSE 'blind_mean_higher' END FROM a WHERE high_n > 0
UNION ALL SELECT 'dark_counts_above_1e-4', CASE WHEN bd > bb THEN 'Blind' ELSE 'Either' END, NULL, CASE WHEN bd > bb THEN 'blind_succeeds_more_often' ELSE 'blind_not_more_successful' END FROM a WHERE burst_n > 0
UNION ALL SELECT 'efficiency_below_5_percent', CASE WHEN tb > td THEN 'Baseline' ELSE 'Blind' END, NULL, CASE WHEN tb > td THEN 'baseline_rows_more_frequent' ELSE 'blind_rows_not_fewer' END FROM a WHERE tb + td > 0"""


@query("d19_strategy_guideline", _SG)
def d19(spark, sf):
    return tidy(report.strategy_guideline(report_input(spark, sf)), 6)


_SUM_EXPR = (
    "count(*)", "count(*) FILTER (is_success)", "count(*) FILTER (is_success) / count(*)::DOUBLE * 100", "avg(net_efficiency)",
    "avg(net_efficiency) FILTER (is_success)", "max(net_efficiency)", "avg(qber)", "min(qber)", "max(qber)",
    "count(*) FILTER (strategy = 'baseline')", "count(*) FILTER (strategy = 'blind')", "max(distance_km) FILTER (is_success)",
)
_SUM = " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM {V_REPORT}" for n, e in zip(report.SUMMARY, _SUM_EXPR)
)


@query("d20_summary", _SUM)
def d20(spark, sf):
    return tidy(report.summary(report_input(spark, sf)), 6)


@query("d21_campaign_metrics", """
SELECT phase, count(*) AS processed, count(*) FILTER (outcome = 'skipped_infeasible') AS skipped, count(*) FILTER (outcome <> 'skipped_infeasible') AS feasible,
  count(*) FILTER (outcome NOT IN ('skipped_infeasible', 'success')) AS failed, round(count(*) FILTER (outcome <> 'skipped_infeasible') / count(*)::DOUBLE, 9) AS yield_rate,
  round(count(*) FILTER (outcome = 'success') / nullif(count(*) FILTER (outcome <> 'skipped_infeasible'), 0)::DOUBLE, 9) AS success_rate FROM v_results GROUP BY 1""")
def d21(spark, sf):
    return tidy(report.campaign_metrics(views.results(spark, sf), "phase"))


@query("d22_active_metrics", """
SELECT phase, count(*) AS acquired, round(avg((outcome = 'success')::INT), 9) AS success_rate, count(*) FILTER (outcome = 'failure_security') AS cliff_detections,
  count(*) FILTER (outcome IN ('failure_timeout', 'failure_error')) AS protocol_errors, round(min(abs(net_efficiency)) FILTER (net_efficiency < 0.5), 9) AS best_cliff_efficiency
FROM v_results WHERE outcome <> 'skipped_infeasible' GROUP BY 1""")
def d22(spark, sf):
    return tidy(report.active_metrics(views.results(spark, sf).where("outcome <> 'skipped_infeasible'"), "phase"))


@query("e4_recent_efficiency", """
SELECT phase, count(*) AS n, round(avg(net_efficiency), 9) AS recent_efficiency FROM (
  SELECT phase, net_efficiency, row_number() OVER (PARTITION BY phase ORDER BY sample_key DESC) AS rn FROM v_results WHERE outcome = 'success')
WHERE rn <= 100 GROUP BY 1""")
def e4(spark, sf):
    # the rank filter is pushed in front of the shuffle: each task passes on at most 100 rows per phase
    last = Window.partitionBy("phase").orderBy(c("sample_key").desc())
    df = views.results(spark, sf).where("outcome = 'success'").select("phase", "sample_key", "net_efficiency")
    kept = df.withColumn("rn", F.row_number().over(last)).where("rn <= 100")
    return tidy(kept.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg("net_efficiency").alias("recent_efficiency")))


@query("e5_moving_average", """
SELECT pos, round((total - coalesce(lag(total, w) OVER (ORDER BY pos), 0)) / w, 9) AS trend FROM (
  SELECT *, greatest(5, n // 20) AS w FROM (
    SELECT row_number() OVER (ORDER BY sample_key) AS pos, sum(net_efficiency) OVER (ORDER BY sample_key ROWS UNBOUNDED PRECEDING) AS total, count(*) OVER () AS n
    FROM v_results WHERE phase = 'active_learning' AND outcome <> 'skipped_infeasible'))
WHERE n > w QUALIFY pos >= w""")
def e5(spark, sf):
    df = views.results(spark, sf).where("phase = 'active_learning' AND outcome <> 'skipped_infeasible'")
    return tidy(report.moving_average(df, "sample_key", "net_efficiency"))


@query("e6_best_so_far", """
SELECT sample_key, round(best.v, 9) AS best_value, best.k AS best_at FROM (
  SELECT sample_key, min({'a': abs(net_efficiency), 'k': sample_key, 'v': net_efficiency}) OVER (ORDER BY sample_key ROWS UNBOUNDED PRECEDING) AS best
  FROM v_results WHERE outcome = 'success')""")
def e6(spark, sf):
    df = views.results(spark, sf).where("outcome = 'success'").select("sample_key", "net_efficiency")
    return tidy(report.best_so_far(df, "sample_key", "net_efficiency").select("sample_key", "best_value", "best_at"))


@query("j13_binned_surface", f"""
SELECT CAST(floor(qber / 0.01::DOUBLE + 1e-9) AS BIGINT) AS q_cell, CAST(floor(log10(num_pairs::DOUBLE) / 0.1::DOUBLE + 1e-6) AS BIGINT) AS n_cell,
  round(avg(net_efficiency), 9) AS efficiency, count(*) AS n FROM {V_REPORT} GROUP BY 1, 2""")
def j13(spark, sf):
    return tidy(report.binned_surface(report_input(spark, sf)))


def sweep_report(results: DataFrame) -> dict[str, DataFrame]:
    """The four report tables from results; derived once, written once, aggregated four times."""
    cols = ("num_pairs", "channel_fidelity", "dark_count_prob", "storage_noise_r", "strategy", "net_efficiency", "qber", "distance_km", "is_success")
    rows = written(report_rows(results).select(*cols), "report-rows")
    return {
        "death_valley": report.death_valley(rows),
        "feasibility": report.feasibility_grid(rows),
        "strategy": report.strategy_guideline(rows),
        "summary": report.summary(rows),
    }


@query("m2_sweep_report", f"""
SELECT 'death_valley' AS table_name, CAST(round(qber_percent) AS VARCHAR) AS row_name, state AS verdict, success_rate_percent AS value FROM ({_DV})
UNION ALL SELECT 'feasibility', CAST(CAST(round(storage_noise_r * 100) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(round(log_dark_level) AS BIGINT) AS VARCHAR), limiting_factor, max_distance_km FROM ({_FG})
UNION ALL SELECT 'strategy', scenario, recommended_strategy, expected_gain_percent FROM ({_SG})
UNION ALL SELECT 'summary', metric, NULL, value FROM ({_SUM})""".replace("CAST(round(qber_percent) AS VARCHAR)", "CAST(CAST(round(qber_percent) AS BIGINT) AS VARCHAR)"))
def m2(spark, sf):
    t = sweep_report(views.results(spark, sf))
    whole = lambda x: F.round(x).cast("bigint").cast("string")
    parts = [
        t["death_valley"].select(F.lit("death_valley").alias("table_name"), whole(c("qber_percent")).alias("row_name"), c("state").alias("verdict"), c("success_rate_percent").alias("value")),
        t["feasibility"].select(F.lit("feasibility"), F.concat(whole(c("storage_noise_r") * 100), F.lit("/"), whole(c("log_dark_level"))), "limiting_factor", "max_distance_km"),
        t["strategy"].select(F.lit("strategy"), "scenario", "recommended_strategy", "expected_gain_percent"),
        t["summary"].select(F.lit("summary"), "metric", F.lit(None).cast("string"), "value"),
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    return tidy(df, 6)
