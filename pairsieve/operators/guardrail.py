"""Failure guardrail: a balanced random forest that skips hopeless samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest
from .sweep import FEATURES

c = F.col
MIN_ROWS = 50
SKIP_AT = 0.95


def fit_guardrail(df: DataFrame, y: str = "net_efficiency", trees: int = 100, depth: int = 8, seed: int = 42):
    """Trained model, or None with under 50 rows or a single class (then everything passes)."""
    labelled = df.select(*FEATURES, (c(y) > 0).cast("double").alias("label"))
    n, ok = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n < MIN_ROWS or ok in (0, n):
        return None
    return forest.fit(labelled, list(FEATURES), "label", (n / (2 * (n - ok)), n / (2 * ok)), trees, depth, seed)


def score(df: DataFrame, model) -> DataFrame:
    """Add p_fail; 0 where no model could be trained."""
    if model is None:
        return df.withColumn("p_fail", F.lit(0.0))
    return df.withColumn("p_fail", model.p_fail())


def split(df: DataFrame, model, skip_at: float = SKIP_AT) -> DataFrame:
    """All rows, with outcome ``skipped_predicted_failure`` or ``run``."""
    return score(df, model).withColumn("guard", F.when(c("p_fail") >= skip_at, "skipped_predicted_failure").otherwise("run"))
