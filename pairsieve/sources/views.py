"""Views that turn the plain input tables into measurement, sweep and graph tables.

Random-looking columns come from md5 digits of row ids, so a value never
depends on partitioning, task order or retries. Every view keeps all rows
of its table.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, channel, finite
from ..functions.stage import staged
from ..operators.ordered import positions
from ..operators.skew import in_parts


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def digest(tag: str, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(tag), *[i.cast("string") for i in ids]))


def coin(tag: str, *ids: Column) -> Column:
    """Fair bit from the first hex digit."""
    return (F.substring(digest(tag, *ids), 1, 1) >= "8").cast("int")


def byte_of(tag: str, *ids: Column) -> Column:
    """Number 0..255 from the first two hex digits."""
    return F.conv(F.substring(digest(tag, *ids), 1, 2), 16, 10).cast("int")


NOISE_OF_256 = 13


def pair_columns(rid: Column) -> dict[str, Column]:
    same = F.col("a_basis") == F.col("b_basis")
    return {
        "b_bit": F.when(same & (byte_of("n", rid) >= NOISE_OF_256), F.col("a_bit"))
        .when(same, 1 - F.col("a_bit"))
        .otherwise(coin("bo", rid)),
    }


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parties' rounds: one row per event, one session per user."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    rid = F.col("event_id")
    return (
        events.select(
            F.col("user_id").alias("session_id"),
            rid.alias("round_id"),
            "ts",
            (F.col("event_type") != "error").alias("detected"),
            coin("ab", rid).alias("a_basis"),
            coin("bb", rid).alias("b_basis"),
            coin("ao", rid).alias("a_bit"),
        )
        .withColumns(pair_columns(F.col("round_id")))
    )


def alice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("session_id", "round_id", "ts", "detected", F.col("a_basis").alias("basis"), F.col("a_bit").alias("outcome"))


def bob(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("session_id", "round_id", "ts", "detected", F.col("b_basis").alias("basis"), F.col("b_bit").alias("outcome"))


def pairs_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One very large session: a round per distinct (order, line)."""
    rid = F.col("round_id")
    return (
        read_table(spark, sf_dir, "lineitem")
        .select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("round_id"))
        .distinct()
        .select(
            F.lit(0).cast("bigint").alias("session_id"),
            rid,
            coin("ab", rid).alias("a_basis"),
            coin("bb", rid).alias("b_basis"),
            coin("ao", rid).alias("a_bit"),
        )
        .withColumns(pair_columns(rid))
    )


def samples(spark: SparkSession, sf_dir: str, power: Callable[[Column, Column], Column] = F.pow) -> DataFrame:
    """Parameter-sweep samples: one per line item. ``power`` is for those who need another last bit than Java's."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    ten = F.lit(10.0)
    return li.select(
        F.md5(
            F.concat_ws(
                "|",
                F.col("l_orderkey").cast("string"),
                F.col("l_partkey").cast("string"),
                F.col("l_suppkey").cast("string"),
                F.col("l_linenumber").cast("string"),
                F.col("l_quantity").cast("bigint").cast("string"),
                F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
                F.round(F.col("l_discount") * 100).cast("bigint").cast("string"),
                F.round(F.col("l_tax") * 100).cast("bigint").cast("string"),
                F.col("l_returnflag"),
                F.col("l_linestatus"),
            )
        ).alias("sample_key"),
        F.when(F.col("l_returnflag") != "R", "lhs_warmup").otherwise("active_learning").alias("phase"),
        F.when(F.col("l_linestatus") == "F", "baseline").otherwise("blind").alias("strategy"),
        ((F.col("l_partkey") % 1000) / F.lit(1000.0)).alias("storage_noise_r"),
        power(ten, (F.col("l_suppkey") % 100) * -3 / F.lit(100.0)).alias("storage_rate_nu"),
        F.pow(ten, 5 + (F.col("l_suppkey") % 41) / F.lit(10.0)).alias("wait_time_ns"),
        (1 - 2 * F.col("l_tax")).alias("channel_fidelity"),
        F.pow(ten, (F.col("l_linenumber") - 1) / F.lit(-2.0)).alias("detection_efficiency"),
        F.col("l_discount").alias("detector_error"),
        power(ten, -3 - (F.col("l_quantity") - 1) / F.lit(10.0)).alias("dark_count_prob"),
        F.round(F.pow(ten, 4 + (F.col("l_orderkey") % 201) / F.lit(100.0))).cast("bigint").alias("num_pairs"),
    )


MARGIN_FLOOR = 1e-6


def with_feasibility(df: DataFrame) -> DataFrame:
    q = channel.q_channel(
        F.col("channel_fidelity"), F.col("detector_error"), F.col("detection_efficiency"), F.col("dark_count_prob")
    )
    df = staged(df, {"q_channel": q, "q_storage": channel.q_storage(F.col("storage_noise_r"))})
    return df.withColumn("margin", F.col("q_storage") - F.col("q_channel")).withColumn(
        "is_feasible", (F.col("margin") > MARGIN_FLOOR) & (F.col("q_channel") <= channel.QBER_HARD_LIMIT)
    )


def evaluate(df: DataFrame) -> DataFrame:
    """Analytic evaluation of samples: outcome, key lengths and leakage per row."""
    staged = finite.with_finite_key(
        with_feasibility(df), "num_pairs", "q_channel", "storage_noise_r", "storage_rate_nu"
    )
    good = F.col("is_feasible")
    success = good & (F.col("final_length") > 0)
    zero = F.lit(0).cast("bigint")
    return staged.select(
        *df.columns,
        "q_channel",
        "q_storage",
        "margin",
        F.when(~good, "skipped_infeasible")
        .when(success, "success")
        .when(F.col("qber_adj") > channel.QBER_HARD_LIMIT, "failure_qber")
        .otherwise("failure_security")
        .alias("outcome"),
        F.when(success, F.col("final_length") / F.col("num_pairs")).otherwise(F.lit(0.0)).alias("net_efficiency"),
        F.when(good, F.col("key_bits")).otherwise(zero).alias("raw_key_length"),
        F.when(success, F.col("final_length")).otherwise(zero).alias("final_key_length"),
        F.when(good, F.col("q_channel")).alias("qber_measured"),
        F.when(success, F.lit(finite.EC_EFFICIENCY)).otherwise(F.lit(0.0)).alias("reconciliation_efficiency"),
        F.when(good, F.floor(F.col("key_bits") * F.col("h_adj") * finite.EC_EFFICIENCY)).otherwise(zero).alias("leakage_bits"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(samples(spark, sf_dir))


HASH_BITS = 50
LEDGER_CAP = 7000


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosure ledger: one entry per event."""
    ev = read_table(spark, sf_dir, "events")
    shortened = F.when(F.col("event_type") == "view", F.col("event_id") % 64).otherwise(F.lit(0))
    return ev.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("entry_id"),
        "ts",
        F.when(F.col("event_type") == "click", F.lit(32)).otherwise(F.lit(0)).cast("bigint").alias("syndrome_bits"),
        F.when(F.col("event_type") == "purchase", F.lit(HASH_BITS)).otherwise(F.lit(0)).cast("bigint").alias("hash_bits"),
        F.least(F.floor(F.col("value")), F.lit(1000).cast("bigint")).alias("retry_bits"),
        bits.shortening_bits(shortened, 4096).alias("shortening_bits"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite graph: orders are checks, parts are variables."""
    lines = read_table(spark, sf_dir, "lineitem")
    ends = lines.select(F.col("l_orderkey").alias("check_id"), F.col("l_partkey").alias("var_id"))
    return in_parts(ends, lines.count(), "check_id", "var_id").distinct()


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    v = F.col("p_partkey")
    return part.select(
        v.alias("var_id"),
        coin("v", v).alias("bit"),
        # about one variable in eight is punctured
        (byte_of("punct", v) < 32).alias("punctured"),
    )


MESSAGE_KINDS = ("click", "view", "purchase", "signup", "error")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered messages per session; every 97th event is lost after numbering."""
    ev = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id"), "ts", "event_type", "props"
    )
    numbered = positions(ev, ["session_id"], "event_id", out="seq", start=0)
    return numbered.where(F.col("event_id") % 97 != 0).select(
        "session_id", "seq", F.col("event_type").alias("msg_type"), F.col("props").alias("payload"), "ts", "event_id"
    )
