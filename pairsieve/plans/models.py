"""Sampling plans, surrogate, guardrail, acquisition, active loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import acquire, guardrail, quota, surrogate, sweep
from ..operators.ordered import equi_depth, positions, prefix_digits, prefix_of, running
from ..session import scratch_path, written
from ..sources import store, views
from . import oracle as o
from .common import k, out, tidy
from .registry import query, view

c = F.col
FIXED_LENGTH, FIXED_NOISE = 2.0, 1e-2

# Given means and deviations: simple formulas of the sample columns, so that
# what is built on them can be checked exactly.
view("v_given", """
SELECT *, channel_fidelity - storage_noise_r * 0.5::DOUBLE - 0.4::DOUBLE AS mu_baseline, channel_fidelity - storage_noise_r * 0.5::DOUBLE - 0.45::DOUBLE + 0.2::DOUBLE * storage_rate_nu AS mu_blind,
  0.02::DOUBLE + detector_error AS sd_baseline, 0.03::DOUBLE + detector_error / 2 AS sd_blind FROM v_samples""")


def given(df: DataFrame) -> DataFrame:
    base = k.channel_fidelity - k.storage_noise_r * 0.5
    return df.withColumns(
        {
            "mu_baseline": base - 0.4, "mu_blind": base - 0.45 + 0.2 * k.storage_rate_nu,
            "sd_baseline": 0.02 + k.detector_error, "sd_blind": 0.03 + k.detector_error / 2,
        }
    )


def training(spark, sf) -> DataFrame:
    """Encoded results that were run, with their efficiency."""
    r = views.results(spark, sf).where("outcome <> 'skipped_infeasible'")
    return sweep.encode(r).select("sample_key", "strategy", *sweep.FEATURES, "net_efficiency", "outcome")


_FEAT = {
    "storage_noise_r": "storage_noise_r", "log_storage_rate_nu": "log10(storage_rate_nu)", "log_wait_time_ns": "log10(wait_time_ns)",
    "channel_fidelity": "channel_fidelity", "log_detection_efficiency": "log10(detection_efficiency)", "detector_error": "detector_error",
    "log_dark_count_prob": "log10(dark_count_prob)", "log_num_pairs": "log10(num_pairs::DOUBLE)", "strategy_code": "CASE WHEN strategy = 'baseline' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END",
}


@query("j1_standardise", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg({_FEAT[n]}), 7) AS mean, round(stddev_pop({_FEAT[n]}), 7) AS std FROM v_samples" for n in surrogate.INPUTS))
def j1(spark, sf):
    return tidy(surrogate.standardisation(sweep.encode(views.samples(spark, sf))), 7)


@query("j2_surrogate_fit")
def j2(spark, sf):
    df = training(spark, sf)
    model = surrogate.fit(df)
    got = surrogate.predict(df, model, ["strategy"], ("mu", "sd"))
    return tidy(surrogate.fit_quality(got, ["strategy"], "net_efficiency", "mu"), 3)


# what any fit by evidence must give: at least the evidence of the fixed kernel, a solution of its equations, no larger error on rows it hasn't seen
@query("j2_kernel_choice", "SELECT strategy, true AS evidence_not_below_fixed, true AS solves_its_equations, true AS held_out_error_not_above_fixed FROM v_results WHERE outcome <> 'skipped_infeasible' GROUP BY 1")
def j2_kernel(spark, sf):
    df = written(training(spark, sf).withColumn("held_out", views.byte_of("hold", k.sample_key) < 51), "training")
    seen, unseen = df.where("NOT held_out"), df.where("held_out")
    model = surrogate.fit(seen)
    fixed = surrogate.fit(seen, length=FIXED_LENGTH, noise=FIXED_NOISE)
    sums = surrogate.summed(seen, model, ["strategy"], "net_efficiency")
    error = lambda m, name: surrogate.fit_quality(surrogate.predict(unseen, m, ["strategy"], ("mu", "sd")), ["strategy"], "net_efficiency", "mu").select("strategy", c("rmse").alias(name))
    facts = []
    for (group,), m in sums.items():
        gram, cross, *_ = surrogate.centred(m)
        rest = gram @ model.weights[group] + model.noise[group] * model.weights[group] - cross
        good = bool(abs(rest).max() <= 1e-6 * max(1.0, abs(cross).max()))
        facts.append((group, bool(model.evidence[group] >= fixed.evidence[group] - 1e-6 * abs(fixed.evidence[group])), good))
    table = spark.createDataFrame(facts, "strategy string, evidence_not_below_fixed boolean, solves_its_equations boolean")
    both = error(model, "rmse").join(error(fixed, "fixed_rmse"), "strategy").join(table, "strategy")
    return both.select("strategy", "evidence_not_below_fixed", "solves_its_equations", (c("rmse") <= c("fixed_rmse") * 1.001 + 1e-9).alias("held_out_error_not_above_fixed"))


@query("j3_divergence", """
SELECT sample_key, round(d, 9) AS divergence, round(s, 9) AS sd_combined, d - 2 * s > 0.1 AS is_cliff FROM (
 SELECT sample_key, abs(mu_baseline - mu_blind) AS d, sqrt(sd_baseline * sd_baseline + sd_blind * sd_blind) AS s FROM v_given)""")
def j3(spark, sf):
    return out(given(views.samples(spark, sf)), **surrogate.divergence())


@query("j4_model_health", """
SELECT *, base_min < -0.1 OR base_max > 1.1 OR blind_min < -0.1 OR blind_max > 1.1 OR mean_divergence > 0.15 OR mean_uncertainty > 0.3 OR NOT all_finite AS is_diverged FROM (
 SELECT round(min(mu_baseline), 9) AS base_min, round(max(mu_baseline), 9) AS base_max, round(min(mu_blind), 9) AS blind_min, round(max(mu_blind), 9) AS blind_max,
  round(avg(abs(mu_baseline - mu_blind)), 9) AS mean_divergence, round((avg(sd_baseline) + avg(sd_blind)) / 2, 9) AS mean_uncertainty, bool_and(isfinite(mu_baseline) AND isfinite(mu_blind)) AS all_finite FROM v_given)""")
def j4(spark, sf):
    return tidy(surrogate.health(given(views.samples(spark, sf))))


@query("j5_guardrail_fit")
def j5(spark, sf):
    df = written(training(spark, sf), "training")
    model = guardrail.fit_guardrail(df)
    got = guardrail.score(df, model).withColumn("failed", c("net_efficiency") <= 0)
    return got.groupBy("failed").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("p_fail") >= 0.5).alias("predicted_failed"), F.count_if(c("p_fail") >= guardrail.SKIP_AT).alias("skipped"))


@query("j6_guardrail_filter")
def j6(spark, sf):
    df = written(training(spark, sf), "training")
    kept = guardrail.split(df, guardrail.fit_guardrail(df))
    return kept.groupBy("guard", "strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("net_efficiency") > 0).alias("n_success"))


_Z = "((0.0 - mu_baseline - 0.01::DOUBLE) / sd_baseline)"
_PDF = f"(0.3989422804014327::DOUBLE * exp(-0.5::DOUBLE * {_Z} * {_Z}))"
_T = f"(1 / (1 + 0.2316419::DOUBLE * abs({_Z})))"
_POLY = f"(0.319381530::DOUBLE + {_T} * (-0.356563782::DOUBLE + {_T} * (1.781477937::DOUBLE + {_T} * (-1.821255978::DOUBLE + {_T} * 1.330274429::DOUBLE))))"
_CDF = f"(CASE WHEN {_Z} < 0 THEN {_PDF} * {_T} * {_POLY} ELSE 1 - {_PDF} * {_T} * {_POLY} END)"


@query("j7_acquisition", f"""
SELECT sample_key, round(1.96::DOUBLE * sd_baseline - abs(mu_baseline), 9) AS straddle, round((0.0 - mu_baseline - 0.01::DOUBLE) * {_CDF} + sd_baseline * {_PDF}, 9) AS ei, round(-mu_baseline + 2.0 * sd_baseline, 9) AS ucb FROM v_given""")
def j7(spark, sf):
    g = given(views.samples(spark, sf))
    return out(g, **{n: fn(c("mu_baseline"), c("sd_baseline")) for n, fn in acquire.SCORES.items()})


def candidates(spark, sf) -> DataFrame:
    g = sweep.encode(given(views.samples(spark, sf)))
    return g.withColumn("score", F.round(acquire.straddle(c("mu_baseline"), c("sd_baseline")), 9)).select("sample_key", *sweep.FEATURES, "score")


@query("f4_best_candidate", "SELECT sample_key, score FROM (SELECT sample_key, round(1.96::DOUBLE * sd_baseline - abs(mu_baseline), 9) AS score FROM v_given) ORDER BY score DESC, sample_key LIMIT 1")
def f4(spark, sf):
    return acquire.top_one(candidates(spark, sf), "score", "sample_key").select("sample_key", "score")


view("v_cand", "SELECT sample_key, round(1.96::DOUBLE * sd_baseline - abs(mu_baseline), 9) AS score, " + ", ".join(f"{e} AS f{i}" for i, e in enumerate(_FEAT.values())) + " FROM v_given")


def _dist(p: str) -> str:
    return "sqrt(" + " + ".join(f"(c.f{i} - {p}.f{i}) * (c.f{i} - {p}.f{i})" for i in range(9)) + ")"


def _pick_sql(kk: int) -> str:
    ctes = []
    for i in range(kk):
        prev = [f"p{j}" for j in range(i)]
        gap = "" if not prev else f" + 0.1::DOUBLE * least({', '.join(_dist(p) for p in prev)})"
        where = "" if not prev else " WHERE c.sample_key NOT IN (" + ", ".join(f"{p}.sample_key" for p in prev) + ")"
        src = "v_cand c" + "".join(f", {p}" for p in prev)
        ctes.append(f"p{i} AS (SELECT {i} AS pick, c.*, round(c.score{gap}, 9) AS pick_score FROM {src}{where} ORDER BY pick_score DESC, c.sample_key LIMIT 1)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT CAST(pick AS BIGINT) AS pick, sample_key, pick_score FROM p{i}" for i in range(kk))


@query("f5_diverse_batch", _pick_sql(4))
def f5(spark, sf):
    cand = written(candidates(spark, sf), "candidates")
    return tidy(acquire.diverse_batch(cand, 4, "score", "sample_key"))


@query("j8_suggest_batch", "SELECT sample_key, score FROM v_cand QUALIFY row_number() OVER (ORDER BY score DESC, sample_key) <= 16")
def j8(spark, sf):
    return candidates(spark, sf).select("sample_key", "score").orderBy(c("score").desc(), c("sample_key")).limit(16)


def _unit(tag: str, ident: str) -> str:
    return f"(CAST('0x' || substr(md5('{tag}:' || {ident}), 1, 12) AS BIGINT) / {float(1 << 48)!r}::DOUBLE)"


@query("f6_random_candidates", "SELECT sample_key, " + ", ".join(
    f"round({lo!r}::DOUBLE + {_unit(f'cand0-{n}', 'sample_key')} * ({hi!r}::DOUBLE - {lo!r}::DOUBLE), 9) AS {n}" for n, (lo, hi) in acquire.BOUNDS.items()) + " FROM v_samples")
def f6(spark, sf):
    return tidy(acquire.random_candidates(views.samples(spark, sf).select("sample_key"), "sample_key"))


def design(spark, sf) -> DataFrame:
    """Latin hypercube with a point for each order, in the order of the keys."""
    orders = written(positions(views.read_table(spark, sf, "orders").select("o_orderkey"), [], "o_orderkey", out="sample_id", start=0), "design-rows")
    return acquire.latin_hypercube(orders, orders.count())


def _stratum(j: int) -> str:
    a, b = acquire.STEPS[j]
    return f"CAST((CAST(sample_id AS HUGEINT) * (CASE WHEN n % {a} <> 0 THEN {a} ELSE {b} END) + {j * 104729} % n) % n AS BIGINT)"


def _design_value(name: str) -> str:
    lo, hi = acquire.BOUNDS[name]
    u = f"((stratum_{name} + {_unit(f'lhs0-{name}', 'sample_id')}) / n)"
    if name == "strategy_code":
        return f"CASE WHEN stratum_{name} < n // 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {name}"
    return f"round({lo!r}::DOUBLE + {f'sqrt({u})' if name == 'channel_fidelity' else u} * ({hi!r}::DOUBLE - {lo!r}::DOUBLE), 9) AS {name}"


@query("f7_latin_hypercube", f"""
SELECT o_orderkey, sample_id, {", ".join(f"stratum_{n}" for n in acquire.BOUNDS)}, {", ".join(_design_value(n) for n in acquire.BOUNDS)} FROM (
 SELECT *, {", ".join(f"{_stratum(j)} AS stratum_{n}" for j, n in enumerate(acquire.BOUNDS))} FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_id, count(*) OVER () AS n FROM orders))""")
def f7(spark, sf):
    return tidy(design(spark, sf))


@query("f7_stratum_uniqueness", " UNION ALL ".join(f"SELECT '{n}' AS dimension, count(*) AS n_points, count(*) AS n_strata, count(*) // 2 AS n_blind FROM orders" for n in acquire.BOUNDS))
def f7_strata(spark, sf):
    d = design(spark, sf)
    rows = d.select("strategy_code", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c(f"stratum_{n}").alias("s")) for n in acquire.BOUNDS])).alias("x"))
    per = rows.groupBy("x.dimension", "x.s").agg(F.count(F.lit(1)).alias("n"), F.sum("strategy_code").alias("b"))
    return per.groupBy("dimension").agg(F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_strata"), F.sum("b").cast("bigint").alias("n_blind"))


@query("f8_feasible_quota", "SELECT sample_key, round(margin, 9) AS margin FROM v_feasible WHERE is_feasible QUALIFY row_number() OVER (ORDER BY sample_key) <= 5000")
def f8(spark, sf):
    ok = views.with_feasibility(views.samples(spark, sf)).where("is_feasible").select("sample_key", "margin")
    return tidy(positions(ok, [], "sample_key", bucket=prefix_of("sample_key", prefix_digits(ok))).where("pos <= 5000").select("sample_key", "margin"))


_CAND = ", ".join(f"{lo!r}::DOUBLE + {_unit(f'cand1-{n}', 'candidate_id')} * ({hi!r}::DOUBLE - {lo!r}::DOUBLE) AS {n}" for n, (lo, hi) in acquire.BOUNDS.items())
_DECODED = "storage_noise_r AS r, channel_fidelity AS f, detector_error AS e, pow(10, log_detection_efficiency) AS eta, pow(10, log_dark_count_prob) AS d"


# a quota of one feasible sample for each order, generated until it is full; the SQL generates far more than are needed
@query("f8_generated_quota", f"""
SELECT candidate_id, round(margin, 9) AS margin FROM (
 SELECT candidate_id, (1 - r) / 2 - q AS margin, q FROM (SELECT *, CASE WHEN click > 1e-12 THEN least(0.5, greatest(0.0, err / (2 * click))) ELSE 0.5 END AS q FROM (
  SELECT *, eta * (1 - d) + 2 * d * (1 - eta) AS click, e + (1 - e) * (1 - f) + d * (1 - eta) AS err FROM (SELECT candidate_id, {_DECODED} FROM (
   SELECT candidate_id, {_CAND} FROM (SELECT unnest(range((SELECT 40 * count(*) FROM orders))) AS candidate_id))))))
WHERE margin > 1e-6 AND q <= 0.22 QUALIFY row_number() OVER (ORDER BY candidate_id) <= (SELECT count(*) FROM orders)""")
def f8_quota(spark, sf):
    def keep(cand: DataFrame) -> DataFrame:
        linear = sweep.decode(cand.select("candidate_id", *sweep.FEATURES))
        return views.with_feasibility(linear).where("is_feasible").select("candidate_id", "margin")

    wanted = views.read_table(spark, sf, "orders").count()
    path = scratch_path(spark, "quota")
    return tidy(quota.fill_quota(spark, lambda ids: acquire.random_candidates(ids, "candidate_id", seed=1), keep, wanted, path))


@query("j9_fit_quality", f"""
SELECT strategy, holdout, count(*) AS n, round(sqrt(avg((net_efficiency - mu) * (net_efficiency - mu))), 9) AS rmse,
  round(CASE WHEN var_pop(net_efficiency) > 0 THEN 1 - sum((net_efficiency - mu) * (net_efficiency - mu)) / (var_pop(net_efficiency) * count(*)) ELSE 0 END, 6) AS r2
FROM (SELECT strategy, net_efficiency, {o.byte_of('hold', 'sample_key')} < 51 AS holdout, channel_fidelity - storage_noise_r * 0.5::DOUBLE - 0.4::DOUBLE AS mu FROM v_results WHERE outcome <> 'skipped_infeasible') GROUP BY 1, 2""")
def j9(spark, sf):
    df = training(spark, sf).withColumn("holdout", views.byte_of("hold", k.sample_key) < 51)
    df = df.withColumn("mu", k.channel_fidelity - k.storage_noise_r * 0.5 - 0.4)
    return tidy(surrogate.fit_quality(df, ["strategy", "holdout"], "net_efficiency", "mu"), r2=6)


@query("j10_cross_validation")
def j10(spark, sf):
    df = training(spark, sf).withColumn("fold", (views.byte_of("fold", k.sample_key) % 5).cast("int"))
    df = written(df, "folds")
    model = surrogate.fit(df, folds="fold")
    got = surrogate.predict(df, model, ["strategy", "fold"], ("mu", "sd"))
    return tidy(surrogate.fit_quality(got, ["strategy", "fold"], "net_efficiency", "mu"), 3)


_ROC = """SELECT score, sum(p)::BIGINT AS p, sum(n)::BIGINT AS n FROM (SELECT d.n_chars AS score, (l.quality = 1)::INT AS p, (l.quality <> 1)::INT AS n FROM labels l JOIN documents d USING (doc_id)) GROUP BY 1"""
view("v_roc", f"SELECT score, sum(p) OVER w / sum(p) OVER ()::DOUBLE AS tpr, sum(n) OVER w / sum(n) OVER ()::DOUBLE AS fpr FROM ({_ROC}) WINDOW w AS (ORDER BY score DESC)".replace("sum(p) OVER ()::DOUBLE", "CAST(sum(p) OVER () AS DOUBLE)").replace("sum(n) OVER ()::DOUBLE", "CAST(sum(n) OVER () AS DOUBLE)"))


def roc_points(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """Cumulative shares over the distinct scores, highest first."""
    per = scored.groupBy(c(score).alias("score")).agg(F.count_if(c(positive)).alias("p"), F.count_if(~c(positive)).alias("n"))
    per = per.withColumn("down", -c("score"))
    per = written(per, "scores")
    totals = per.agg(F.sum("p").alias("P"), F.sum("n").alias("N")).first()
    # outliers don't matter to buckets cut at quantiles
    cut = equi_depth(per, "down")(per)
    got = running(cut, [], "down", {"tp": ("sum", c("p")), "fp": ("sum", c("n"))}, bucket=c("_b"))
    return got.select(
        "score", "down", "p", "n", (c("tp") / F.lit(totals["P"] or 1)).alias("tpr"), (c("fp") / F.lit(totals["N"] or 1)).alias("fpr"),
        (c("p") / F.lit(totals["P"] or 1)).alias("dt"), (c("n") / F.lit(totals["N"] or 1)).alias("df"),
    )


def labelled_scores(spark, sf) -> DataFrame:
    lab, doc = views.read_table(spark, sf, "labels"), views.read_table(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select("n_chars", (c("quality") == 1).alias("positive"))


@query("j11_roc_points", "SELECT score, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM v_roc")
def j11(spark, sf):
    return tidy(roc_points(labelled_scores(spark, sf), "n_chars", "positive").select("score", "tpr", "fpr"))


@query("j11_auc", "SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 9) AS auc FROM (SELECT *, lag(fpr, 1, 0) OVER (ORDER BY score DESC) AS pf, lag(tpr, 1, 0) OVER (ORDER BY score DESC) AS pt FROM v_roc)")
def j11_auc(spark, sf):
    # a step of df ends at tpr and starts dt lower: its trapezoid needs no look back
    r = roc_points(labelled_scores(spark, sf), "n_chars", "positive")
    return tidy(r.agg(F.sum(c("df") * (2 * c("tpr") - c("dt")) / 2).alias("auc")))


@query("j12_slice_sweep")
def j12(spark, sf):
    df = written(training(spark, sf), "training")
    model = surrogate.fit(df)
    centre = df.agg(*[F.avg(n).alias(n) for n in surrogate.INPUTS])
    name, (lo, hi) = "log_dark_count_prob", acquire.BOUNDS["log_dark_count_prob"]
    line = centre.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn(name, lo + c("step") * (hi - lo) / 49)
    got = surrogate.predict_both(line, model).select("step", name, "mu_baseline", "mu_blind", *[v.alias(n) for n, v in surrogate.divergence().items()])
    return tidy(got, 3)


def evaluated_design(df: DataFrame, phase: str) -> DataFrame:
    """Design points decoded to linear columns and evaluated."""
    linear = sweep.decode(df.select(df.columns[0], *sweep.FEATURES))
    return views.evaluate(linear.withColumn("phase", F.lit(phase)))


@query("m3_sweep_plan")
def m3(spark, sf):
    res = evaluated_design(design(spark, sf).drop("o_orderkey"), "lhs_warmup")
    path = store.new_store(spark, "sweep")
    store.append_results(res, path)
    got = store.read_phase(spark, path, "lhs_warmup")
    return tidy(got.groupBy("phase", "outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("net_efficiency").alias("mean_efficiency")), 6)


def active_loop(spark, sf, path: str, rounds: int, batch: int, retrain_every: int = 1) -> DataFrame:
    """Score, guard, choose, evaluate, append, refit.

    Rows move only between tables; the driver sees the picks of a round and
    fixed-size models. Evaluation is the analytic formula.
    """
    model = guard = None
    pool = written(acquire.random_candidates(views.samples(spark, sf).select("sample_key"), "sample_key"), "pool")
    for i in range(rounds):
        seen = store.read_results(spark, path)
        if i % retrain_every == 0 or model is None:
            train = written(sweep.encode(seen.where("outcome <> 'skipped_infeasible'")).select("sample_key", "strategy", *sweep.FEATURES, "net_efficiency"), "train")
            model, guard = surrogate.fit(train), guardrail.fit_guardrail(train)
        left = pool.join(seen.select("sample_key"), "sample_key", "left_anti")
        left = left.withColumn("strategy", F.when(c("strategy_code") < 0.5, "baseline").otherwise("blind"))
        scored = guardrail.split(surrogate.predict(left, model, ["strategy"], ("mu", "sd")), guard).where("guard = 'run'")
        scored = written(scored.withColumn("score", acquire.straddle(c("mu"), c("sd"))), "scored")
        picks = acquire.diverse_batch(scored, batch, "score", "sample_key")
        chosen = scored.join(picks.select("sample_key", "pick"), "sample_key")
        done = evaluated_design(chosen.select("sample_key", *sweep.FEATURES), "active_learning").withColumn("round", F.lit(i))
        store.append_results(done.drop("round"), path)
    return store.read_results(spark, path)


ROUNDS = 2


def picks_of(pool: int) -> int:
    """Picks of a round: one for 10,000 candidates, 3 to 256."""
    return min(256, max(3, pool // 10_000))


def loop_results(spark, sf) -> DataFrame:
    path = store.new_store(spark, "active")
    store.append_results(views.results(spark, sf).where("phase = 'lhs_warmup'"), path)
    return active_loop(spark, sf, path, ROUNDS, picks_of(views.samples(spark, sf).count()))


@query("j14_active_loop")
def j14(spark, sf):
    got = loop_results(spark, sf)
    return got.groupBy("phase", "outcome").agg(F.count(F.lit(1)).alias("n"))


# --- invariants of fitted models: exact counts beside the fits above -----------

_RUN = "FROM v_results WHERE outcome <> 'skipped_infeasible'"


@query("j2_fit_rows", f"SELECT strategy, count(*) AS n, count(*) AS n_finite, count(*) AS n_spread {_RUN} GROUP BY 1")
def j2_rows(spark, sf):
    df = written(training(spark, sf), "training")
    got = surrogate.predict(df, surrogate.fit(df), ["strategy"], ("mu", "sd"))
    finite = ~F.isnan("mu") & (F.abs("mu") < float("inf"))
    return got.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("n_finite"), F.count_if(c("sd") > 0).alias("n_spread"))


@query("j10_fold_rows", f"SELECT strategy, CAST({o.byte_of('fold', 'sample_key')} % 5 AS BIGINT) AS fold, count(*) AS n, count(*) AS n_finite {_RUN} GROUP BY 1, 2")
def j10_rows(spark, sf):
    df = written(training(spark, sf).withColumn("fold", (views.byte_of("fold", k.sample_key) % 5).cast("int")), "folds")
    got = surrogate.predict(df, surrogate.fit(df, folds="fold"), ["strategy", "fold"], ("mu", "sd"))
    finite = ~F.isnan("mu") & (F.abs("mu") < float("inf"))
    return tidy(got.groupBy("strategy", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("n_finite")))


@query("j5_guardrail_classes", f"SELECT net_efficiency <= 0 AS failed, count(*) AS n, count(*) AS n_scored {_RUN} GROUP BY 1")
def j5_classes(spark, sf):
    df = written(training(spark, sf), "training")
    got = guardrail.score(df, guardrail.fit_guardrail(df)).withColumn("failed", c("net_efficiency") <= 0)
    return got.groupBy("failed").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("p_fail").between(0, 1)).alias("n_scored"))


_PICKS = f"{ROUNDS} * least(256, greatest(3, (SELECT count(*) FROM v_samples) // 10000))"


@query("m4_active_phases", f"""
SELECT 'lhs_warmup' AS phase, count(*) AS n, count(DISTINCT sample_key) AS n_keys, count(*) AS n_of_pool, count(*) AS n_of_warmup FROM v_results WHERE phase = 'lhs_warmup'
UNION ALL SELECT 'active_learning', {_PICKS}, {_PICKS}, {_PICKS}, 0""")
def m4(spark, sf):
    # appended keys: each once, from the pool, none evaluated before
    got = written(loop_results(spark, sf).select("phase", "sample_key"), "loop")
    pool = views.samples(spark, sf).select("sample_key").distinct().withColumn("in_pool", F.lit(True))
    warm = views.results(spark, sf).where("phase = 'lhs_warmup'").select("sample_key").distinct().withColumn("in_warmup", F.lit(True))
    known = got.join(pool, "sample_key", "left").join(warm, "sample_key", "left")
    return known.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sample_key").alias("n_keys"), F.count("in_pool").alias("n_of_pool"), F.count("in_warmup").alias("n_of_warmup")
    )
