"""Regression with uncertainty on sweep tables, and the scores built on it.

The model is Bayesian linear regression on random Fourier features of a
Matern-5/2 kernel. Fitting is one pass: every partition sends its sums of
outer products (a fixed D x D block per group), Spark adds them up, and
only the D x D system is solved on the driver. Prediction is a batch map
with the fixed-size weights. The rows never leave the executors.

The kernel's length is the one of ``LENGTHS`` with the largest evidence over
``KERNEL_SAMPLE`` rows (those of least hash); the noise of each model maximises
the evidence of its own sums over all rows. Both need one eigen-decomposition
for a set of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .sweep import FEATURES

c = F.col
INPUTS = FEATURES[:8]
DIMENSION = 64
LENGTHS = (0.5, 1.0, 2.0, 4.0, 8.0)
NOISES = np.geomspace(1e-10, 10.0, 45)
KERNEL_SAMPLE = 20_000


@dataclass
class Landscape:
    """Per group: weights and posterior; shared: scaling and feature draw."""

    mean: np.ndarray
    std: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    length: float
    noise: dict = field(default_factory=dict)
    evidence: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)
    cover: dict = field(default_factory=dict)
    offset: dict = field(default_factory=dict)
    inputs: tuple[str, ...] = INPUTS

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.omega + self.phase)


def standardisation(df: DataFrame, inputs=INPUTS) -> DataFrame:
    """feature, mean and population standard deviation; one aggregate, unpivoted."""
    aggs = [F.struct(F.lit(n).alias("feature"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")) for n in inputs]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def _draw(df: DataFrame, inputs, dimension: int, length: float, seed: int) -> Landscape:
    scale = {r["feature"]: (r["mean"], r["std"]) for r in standardisation(df, inputs).collect()}  # one row per feature
    mean = np.array([scale[n][0] for n in inputs])
    std = np.array([scale[n][1] or 1.0 for n in inputs])
    rng = np.random.default_rng(seed)
    dof = 5.0  # spectral density of Matern 5/2: multivariate t with 5 degrees of freedom
    normal = rng.standard_normal((len(inputs), dimension)) / length
    omega = normal * np.sqrt(dof / rng.chisquare(dof, dimension))
    return Landscape(mean, std, omega, rng.uniform(0, 2 * np.pi, dimension), length, inputs=tuple(inputs))


def moments(df: DataFrame, model: Landscape, group: list[str], y: str) -> DataFrame:
    """Sums of outer products (features and target) per group: (group, i, j, value)."""
    inputs, size = list(model.inputs), len(model.phase) + 2

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(group):
                phi = model.features(part[inputs].to_numpy(float))
                row = np.column_stack([phi, part[y].to_numpy(float), np.ones(len(part))])
                acc[key] = acc.get(key, 0.0) + row.T @ row
        i, j = np.triu_indices(size)
        for key, m in acc.items():
            key = key if isinstance(key, tuple) else (key,)
            yield pd.DataFrame({**dict(zip(group, key)), "i": i.astype(np.int32), "j": j.astype(np.int32), "value": m[i, j]})

    types = dict(df.dtypes)
    schema = ", ".join(f"`{g}` {types[g]}" for g in group) + ", i int, j int, value double"
    rows = df.select(*group, *inputs, y).mapInPandas(partial, schema)
    return rows.groupBy(*group, "i", "j").agg(F.sum("value").alias("value"))


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Gram matrix, cross sums and square sum of the centred target, its mean, and the number of rows, from summed outer products."""
    d = len(m) - 2
    n, sum_y = m[d + 1, d + 1], m[d, d + 1]
    mean_y = sum_y / n if n else 0.0
    return m[:d, :d], m[:d, d] - m[:d, d + 1] * mean_y, max(0.0, m[d, d] - sum_y * mean_y), mean_y, n


class Evidence:
    """Logarithm of the evidence of sums as a function of the noise, from one eigen-decomposition."""

    def __init__(self, m: np.ndarray):
        gram, cross, self.square, _, self.n = centred(m)
        values, vectors = np.linalg.eigh(gram)
        self.values, self.along = np.maximum(values, 0.0), (vectors.T @ cross) ** 2

    def __call__(self, noise: float) -> float:
        fit_ = (self.square - np.sum(self.along / (self.values + noise))) / noise
        return float(-0.5 * (self.n * np.log(2 * np.pi * noise) + np.sum(np.log1p(self.values / noise)) + fit_))

    def best(self) -> tuple[float, float]:
        """(noise, evidence): the best of a grid, then narrowed down by thirds of its neighbourhood on a logarithmic scale."""
        grid = [self(x) for x in NOISES]
        k = int(np.argmax(grid))
        lo, hi = np.log(NOISES[max(0, k - 1)]), np.log(NOISES[min(len(NOISES) - 1, k + 1)])
        for _ in range(60):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            if self(np.exp(a)) < self(np.exp(b)):
                lo = a
            else:
                hi = b
        noise = float(np.exp((lo + hi) / 2))
        return (noise, self(noise)) if self(noise) >= grid[k] else (float(NOISES[k]), grid[k])


def _solve(model: Landscape, key, m: np.ndarray, noise: float | None) -> None:
    evidence = Evidence(m)
    noise, value = evidence.best() if noise is None else (noise, evidence(noise))
    gram, cross, _, mean_y, _ = centred(m)
    model.noise[key], model.evidence[key] = noise, value
    model.cover[key] = np.linalg.inv(gram / noise + np.eye(len(gram)))
    model.weights[key] = model.cover[key] @ cross / noise
    model.offset[key] = mean_y


def summed(df: DataFrame, model: Landscape, keys: list[str], y: str) -> dict[tuple, np.ndarray]:
    """The sums of outer products of each group as a matrix."""
    size = len(model.phase) + 2
    sums: dict = {}
    for r in moments(df, model, keys, y).toLocalIterator():  # fixed (D+2)^2 / 2 rows per group
        m = sums.setdefault(tuple(r[k] for k in keys), np.zeros((size, size)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
    return sums


def chosen_length(df: DataFrame, y: str, group: str, inputs, dimension: int, seed: int, lengths=LENGTHS, sample_rows: int = KERNEL_SAMPLE) -> float:
    """The kernel length of largest evidence, added up over the groups, on a sample of bounded size."""
    mark = F.xxhash64(*inputs, y, group)
    sample = written(df.select(group, *inputs, y).orderBy(mark, *inputs, y, group).limit(sample_rows), "kernel-sample")
    total = {}
    for length in lengths:
        sums = summed(sample, _draw(sample, inputs, dimension, length, seed), [group], y)
        total[length] = sum(Evidence(m).best()[1] for m in sums.values())
    return max(total, key=lambda x: (total[x], -abs(np.log(x / 2.0))))


def fit(
    df: DataFrame, y: str = "net_efficiency", group: str = "strategy", inputs=INPUTS, dimension: int = DIMENSION, length: float | None = None,
    noise: float | None = None, seed: int = 7, folds: str | None = None,
) -> Landscape:
    """One model per group, or with ``folds`` one per (group, fold) trained on the other folds.

    ``length`` and ``noise`` are chosen by evidence where they aren't given.
    Cross-validation costs no extra pass: the sums of a training set are the
    total less the sums of its held-out fold.
    """
    if length is None:
        length = chosen_length(df, y, group, inputs, dimension, seed)
    model = _draw(df, inputs, dimension, length, seed)
    sums = summed(df, model, [group] + ([folds] if folds else []), y)
    for key, m in sums.items():
        if folds:
            total = sum(v for k, v in sums.items() if k[0] == key[0])
            _solve(model, key, total - m, noise)
        else:
            _solve(model, key[0], m, noise)
    return model


def predict(df: DataFrame, model: Landscape, keys, out: tuple[str, str]) -> DataFrame:
    """Add mean and standard deviation.

    ``keys`` is the name of one group for all rows, or a list of columns
    that choose the model of each row. A group without training rows gets
    the prior: mean of all groups' offsets, unit deviation.
    """
    inputs = list(model.inputs)
    by_row = isinstance(keys, list)

    def apply(x: np.ndarray, key) -> tuple[np.ndarray, np.ndarray]:
        if key not in model.weights:
            known = list(model.offset.values())
            return np.full(len(x), float(np.mean(known)) if known else 0.0), np.ones(len(x))
        phi = model.features(x)
        mu = phi @ model.weights[key] + model.offset[key]
        var = model.noise[key] + np.einsum("ij,jk,ik->i", phi, model.cover[key], phi)
        return mu, np.sqrt(var)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mu, sd = np.zeros(len(pdf)), np.zeros(len(pdf))
            if by_row:
                for key, idx in pdf.groupby(keys).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    mu[idx], sd[idx] = apply(pdf[inputs].to_numpy(float)[idx], key if len(keys) > 1 else key[0])
            elif len(pdf):
                mu, sd = apply(pdf[inputs].to_numpy(float), keys)
            yield pdf.assign(**{out[0]: mu, out[1]: sd})

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out[0]}` double, `{out[1]}` double"
    return df.mapInPandas(run, schema)


def predict_both(df: DataFrame, model: Landscape) -> DataFrame:
    one = predict(df, model, "baseline", ("mu_baseline", "sd_baseline"))
    return predict(one, model, "blind", ("mu_blind", "sd_blind"))


def divergence(threshold: float = 0.1, confidence: float = 2.0) -> dict[str, Column]:
    gap = F.abs(c("mu_baseline") - c("mu_blind"))
    sd = F.sqrt(c("sd_baseline") * c("sd_baseline") + c("sd_blind") * c("sd_blind"))
    return {"divergence": gap, "sd_combined": sd, "is_cliff": gap - confidence * sd > threshold}


def health(df: DataFrame, max_divergence: float = 0.15, max_uncertainty: float = 0.3) -> DataFrame:
    gap = F.abs(c("mu_baseline") - c("mu_blind"))
    finite = F.lit(True)
    for n in ("mu_baseline", "mu_blind", "sd_baseline", "sd_blind"):
        finite = finite & ~F.isnan(n) & (F.abs(c(n)) < float("inf"))
    g = df.agg(
        F.min("mu_baseline").alias("base_min"), F.max("mu_baseline").alias("base_max"), F.min("mu_blind").alias("blind_min"),
        F.max("mu_blind").alias("blind_max"), F.avg(gap).alias("mean_divergence"),
        ((F.avg("sd_baseline") + F.avg("sd_blind")) / 2).alias("mean_uncertainty"), F.bool_and(finite).alias("all_finite"),
    )
    bad = (
        (c("base_min") < -0.1) | (c("base_max") > 1.1) | (c("blind_min") < -0.1) | (c("blind_max") > 1.1)
        | (c("mean_divergence") > max_divergence) | (c("mean_uncertainty") > max_uncertainty) | ~c("all_finite")
    )
    return g.withColumn("is_diverged", bad)


def fit_quality(df: DataFrame, keys: list[str], y: str, predicted: str) -> DataFrame:
    """R2 and RMSE per group from one pass of sums around the group mean."""
    miss = c(y) - c(predicted)
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.when(total > 0, 1 - F.sum(miss * miss) / total).otherwise(F.lit(0.0)).alias("r2"),
    )
