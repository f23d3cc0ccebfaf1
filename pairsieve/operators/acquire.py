"""Acquisition scores, batch choice, sampling plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import views
from .sweep import FEATURES

c = F.col

# Coefficients of the normal distribution polynomial.
CDF_SLOPE = 0.2316419
CDF_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327


def straddle(mu: Column, sigma: Column, kappa: float = 1.96) -> Column:
    return kappa * sigma - F.abs(mu)


def normal_pdf(z: Column) -> Column:
    return INV_SQRT_2PI * F.exp(-0.5 * z * z)


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + CDF_SLOPE * F.abs(z))
    poly = F.lit(0.0)
    for a in reversed(CDF_TERMS):
        poly = a + t * poly
    upper = 1 - normal_pdf(z) * t * poly
    return F.when(z < 0, 1 - upper).otherwise(upper)


def expected_improvement(mu: Column, sigma: Column, best: float = 0.0, xi: float = 0.01) -> Column:
    gain = best - mu - xi
    z = gain / sigma
    return F.when(sigma <= 1e-12, F.lit(0.0)).otherwise(gain * normal_cdf(z) + sigma * normal_pdf(z))


def confidence_bound(mu: Column, sigma: Column, beta: float = 2.0) -> Column:
    return -mu + beta * sigma


SCORES = {"straddle": straddle, "ei": expected_improvement, "ucb": confidence_bound}


def top_one(df: DataFrame, score: str, tie: str) -> DataFrame:
    return df.orderBy(c(score).desc(), c(tie)).limit(1)


PART_HEAD, HEAD = 1_024, 16_384  # rows that a partition, and all of them, hand on in a pass


def _pick_scores(x: np.ndarray, score: np.ndarray, picks: np.ndarray, weight: float) -> np.ndarray:
    """Score and weighted distance to the nearest pick, rounded to nine places (half up)."""
    total = score
    if len(picks):
        near = np.full(len(score), np.inf)
        for p in picks:
            gap = np.zeros(len(score))
            for j in range(len(p)):
                d = x[:, j] - p[j]
                gap = gap + d * d
            near = np.minimum(near, np.sqrt(gap))
        total = score + weight * near
    return np.copysign(np.floor(np.abs(total) * 1e9 + 0.5) / 1e9, total) + 0.0


def _ahead(rows: pd.DataFrame, tie: str, n: int) -> pd.DataFrame:
    """The first ``n`` rows by (pick_score descending, tie), in that order."""
    if len(rows) > n:
        least = np.partition(rows["pick_score"].to_numpy(), len(rows) - n)[len(rows) - n]
        rows = rows[rows["pick_score"] >= least]
    return rows.sort_values(["pick_score", tie], ascending=[False, True], kind="stable").head(n)


def _heads(df: DataFrame, picks: list[dict], score: str, tie: str, features, weight: float) -> tuple[pd.DataFrame, tuple[float, str] | None]:
    """One pass: the rows of largest pick score, at most ``HEAD``, and a place (score, key) that all other rows come after (None: there are none)."""
    at = np.array([[p[f] for f in features] for p in picks], dtype=float)
    taken, m = {p[tie] for p in picks}, PART_HEAD

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, more = None, False
        for pdf in batches:
            x = pdf[list(features)].to_numpy(float)
            value = _pick_scores(x, pdf[score].to_numpy(float), at, weight)
            rows = pdf.assign(pick_score=value)[np.isfinite(value) & ~pdf[tie].isin(taken).to_numpy()]
            held = rows if held is None else pd.concat([held, rows])
            more = more or len(held) > m
            held = _ahead(held, tie, m)
        if held is not None and len(held):
            last = held.iloc[-1]
            yield held.assign(cut_score=last["pick_score"] if more else np.nan, cut_tie=last[tie] if more else None)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(tie, score, *features).dtypes)
    rows = df.select(tie, score, *features).mapInPandas(best, f"{fields}, pick_score double, cut_score double, cut_tie string")
    got = rows.orderBy(c("pick_score").desc(), c(tie)).limit(HEAD).toPandas()
    # a partition without a row among these ends behind the last of them
    cuts = list(got.loc[got["cut_score"].notna(), ["cut_score", "cut_tie"]].drop_duplicates().itertuples(index=False, name=None))
    if len(got) == HEAD:
        cuts.append((got["pick_score"].iloc[-1], got[tie].iloc[-1]))
    return got, min(cuts, key=lambda x: (-x[0], x[1])) if cuts else None


def diverse_batch(df: DataFrame, k: int, score: str, tie: str, features=FEATURES, weight: float = 0.1) -> DataFrame:
    """Greedy batch of k: score + weight * distance to the nearest pick so far.

    From the second pick on a row's pick score only falls as picks are added.
    So a pass over all rows brings those of largest pick score to the driver
    (at most ``HEAD``) with the place behind which all others are, and picks are
    made among them as long as the best comes before that place; then the next
    pass follows. The picks are those of one pass each. Rows without a finite
    score or feature take no part.
    """
    if not 1 <= k <= 256:
        raise ValueError("k must be in 1..256")
    picks: list[dict] = []
    while len(picks) < k:
        head, cut = _heads(df, picks, score, tie, features, weight)
        if head.empty:
            break
        x, scores, keys = head[list(features)].to_numpy(float), head[score].to_numpy(float), head[tie].to_numpy()
        first, open_, value = len(picks), np.ones(len(head), dtype=bool), head["pick_score"].to_numpy()
        while len(picks) < k and open_.any():
            top = value[open_].max()
            i = min(np.flatnonzero(open_ & (value == top)), key=lambda i: keys[i])
            # the first row of a pass is the best of all rows
            if len(picks) > first and cut is not None and (-top, keys[i]) > (-cut[0], cut[1]):
                break
            picks.append({tie: keys[i], "pick_score": float(top), **dict(zip(features, x[i]))})
            open_ &= keys != keys[i]
            if len(picks) == 1:  # the second pick's scores are higher: they have a distance
                break
            new = _pick_scores(x, scores, np.array([[p[f] for f in features] for p in picks[-1:]]), weight)
            value = np.minimum(value, new)
    rows = [(i, p[tie], p["pick_score"]) for i, p in enumerate(picks)]
    return df.sparkSession.createDataFrame(rows, f"pick int, `{tie}` string, pick_score double")


# Parameter bounds (log10 where the feature is a logarithm).
BOUNDS = {
    "storage_noise_r": (0.0, 1.0),
    "log_storage_rate_nu": (-3.0, 0.0),
    "log_wait_time_ns": (5.0, 9.0),
    "channel_fidelity": (0.501, 1.0),
    "log_detection_efficiency": (-3.0, 0.0),
    "detector_error": (0.0, 0.1),
    "log_dark_count_prob": (-8.0, -3.0),
    "log_num_pairs": (4.0, 6.0),
    "strategy_code": (0.0, 1.0),
}


def unit(tag: str, *ids: Column) -> Column:
    """Uniform number in [0, 1) from 12 hex digits of a digest."""
    return F.conv(F.substring(views.digest(tag, *ids), 1, 12), 16, 10).cast("double") / float(1 << 48)


def random_candidates(ids: DataFrame, key: str, seed: int = 0) -> DataFrame:
    cols = {n: lo + unit(f"cand{seed}-{n}", c(key)) * (hi - lo) for n, (lo, hi) in BOUNDS.items()}
    return ids.select(key, *[v.alias(n) for n, v in cols.items()])


# Multipliers of the design: two primes per dimension, the second for point counts that the first divides.
STEPS = (
    (1_000_003, 1_000_033), (618_041, 618_049), (2_654_447, 2_654_467), (1_414_241, 1_414_261), (1_732_051, 1_732_057),
    (2_236_079, 2_236_081), (2_718_281, 2_718_293), (3_141_601, 3_141_641), (1_324_717, 1_324_721),
)


def latin_hypercube(points: DataFrame, n: int, strategy_ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """A design point for each row of ``points`` (sample_id 0..n-1 and any other columns); each stratum of each dimension is used once.

    Dimension j sends index i to stratum (a_j * i + b_j) mod n with a_j
    coprime to n. That is a permutation, so no shuffle or sort is needed.
    Fidelity follows Beta(2, 1) (inverse: square root); the share of blind
    points is exact.
    """
    steps = [first if n % first else second for first, second in STEPS]
    for j, a in enumerate(steps):
        while math.gcd(a, n) != 1:  # both primes divide n
            a += 2
        steps[j] = a
    df = points
    cols = {}
    for j, (name, (lo, hi)) in enumerate(BOUNDS.items()):
        shift = (seed * 7919 + j * 104729) % n
        stratum = ((c("sample_id").cast("decimal(19,0)") * steps[j] + shift) % n).cast("bigint")
        cols[f"stratum_{name}"] = stratum
        if name == "strategy_code":
            cols[name] = F.when(stratum < int(n * strategy_ratio), F.lit(1.0)).otherwise(F.lit(0.0))
            continue
        u = (stratum + unit(f"lhs{seed}-{name}", c("sample_id"))) / n
        cols[name] = lo + (F.sqrt(u) if name == "channel_fidelity" else u) * (hi - lo)
    return df.select(*points.columns, *[v.alias(k) for k, v in cols.items()])
