"""Projections over sweep samples and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_COLUMNS = ("storage_rate_nu", "wait_time_ns", "detection_efficiency", "dark_count_prob", "num_pairs")
FEATURES = (
    "storage_noise_r",
    "log_storage_rate_nu",
    "log_wait_time_ns",
    "channel_fidelity",
    "log_detection_efficiency",
    "detector_error",
    "log_dark_count_prob",
    "log_num_pairs",
    "strategy_code",
)


def encode(df: DataFrame) -> DataFrame:
    """Add the nine feature columns (log10 for the five wide-range parameters)."""
    return df.withColumns(
        {
            **{f"log_{n}": F.log10(F.col(n).cast("double")) for n in LOG_COLUMNS},
            "strategy_code": F.when(F.col("strategy") == "baseline", F.lit(0.0)).otherwise(F.lit(1.0)),
        }
    )


def decode(df: DataFrame, truncate_pairs: bool = False) -> DataFrame:
    """Back to linear columns; pair counts round half-even, or truncate as the report does."""
    pairs = F.pow(F.lit(10.0), F.col("log_num_pairs"))
    return df.select(
        *[c for c in df.columns if c not in LOG_COLUMNS and c != "strategy"],
        *[F.pow(F.lit(10.0), F.col(f"log_{n}")).alias(n) for n in LOG_COLUMNS[:-1]],
        (F.floor(pairs + 1e-6) if truncate_pairs else F.bround(pairs)).cast("bigint").alias("num_pairs"),
        F.when(F.col("strategy_code") < 0.5, "baseline").otherwise("blind").alias("strategy"),
    )


def classify(error: Column, aborted: Column, reason: Column, key_length: Column) -> Column:
    """Outcome from error text, abort reason or key length; earlier rules win."""
    err, why = F.lower(error), F.lower(reason)
    return (
        F.when(
            error.isNotNull(),
            F.when(err.contains("timeout"), "failure_timeout")
            .when(err.contains("qber"), "failure_qber")
            .when(err.contains("reconciliation") | err.contains("ldpc"), "failure_reconciliation")
            .when(err.contains("security"), "failure_security")
            .otherwise("failure_error"),
        )
        .when(
            aborted,
            F.when(why.contains("qber"), "failure_qber")
            .when(why.contains("reconciliation"), "failure_reconciliation")
            .when(why.contains("security"), "failure_security")
            .otherwise("failure_error"),
        )
        .when(key_length <= 0, "failure_security")
        .otherwise("success")
    )


def net_efficiency(final_length: Column, num_pairs: Column) -> Column:
    return F.when(final_length > 0, final_length / num_pairs).otherwise(F.lit(0.0))


def infeasible_text(margin: Column, q_channel: Column, q_storage: Column) -> Column:
    return F.format_string("Infeasible: margin=%.4f; q_channel=%.4f; q_storage=%.4f", margin, q_channel, q_storage)


def parse_infeasible(text: Column) -> dict[str, Column]:
    return {
        n: F.regexp_extract(text, rf"{n}=(-?[0-9]+\.[0-9]+)", 1).try_cast("double") for n in ("margin", "q_channel", "q_storage")
    }
