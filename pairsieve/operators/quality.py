"""Randomness checks on bit columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import previous

c = F.col


def bit_chi_square(bits: DataFrame, key: str) -> DataFrame:
    n, ones = F.count(F.lit(1)), F.sum("bit")
    half = n / 2
    stat = ((n - ones - half) * (n - ones - half) + (ones - half) * (ones - half)) / half
    return bits.groupBy(key).agg(n.alias("n"), ones.alias("ones"), stat.alias("chi2"))


def byte_chi_square(bits: DataFrame, key: str) -> DataFrame:
    """Over all 256 byte values; values that never occur add their expected count each."""
    packed = bits.groupBy(key, F.floor(c("pos") / 8).alias("byte_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c("bit") * F.pow(F.lit(2), 7 - c("pos") % 8)).cast("int").alias("value")
    )
    hist = packed.where("n = 8").groupBy(key, "value").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k")
    expected = total / 256
    # sum (k - e)^2 / e over the seen values plus e for each unseen one = sum k^2 / e - total
    return hist.groupBy(key).agg(total.alias("n_bytes"), (F.sum(c("k").cast("double") * c("k")) / expected - total).alias("chi2"))


def with_previous(bits: DataFrame, key: str) -> DataFrame:
    return previous(bits, [key], "pos", {"prev": c("bit")})


def serial_correlation(bits: DataFrame, key: str) -> DataFrame:
    pairs = with_previous(bits, key).where("prev IS NOT NULL")
    centred = (c("bit") - 0.5) * (c("prev") - 0.5)
    return pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pairs"), (F.sum(centred) / F.count(F.lit(1)) / 0.25).alias("lag1"),
        F.corr(c("bit").cast("double"), c("prev").cast("double")).alias("pearson"),
    )


def runs_test(bits: DataFrame, key: str) -> DataFrame:
    rows = with_previous(bits, key)
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bit").alias("n1"), F.count_if(c("prev").isNull() | (c("prev") != c("bit"))).alias("runs")
    ).withColumn("n0", c("n") - c("n1")).where("n0 > 0 AND n1 > 0")
    n, n0, n1 = (c(x).cast("double") for x in ("n", "n0", "n1"))  # cubes of counts do not fit BIGINT
    expected = 2 * n0 * n1 / n + 1
    variance = 2 * n0 * n1 * (2 * n0 * n1 - n) / (n * n * (n - 1))
    return g.withColumn("expected", expected).withColumn("variance", variance).withColumn(
        "z", F.when(c("variance") > 0, (c("runs") - c("expected")) / F.sqrt("variance"))
    )
