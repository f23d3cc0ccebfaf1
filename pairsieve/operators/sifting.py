"""Alignment, sifting, test subset and error estimate for all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, finite
from ..functions.channel import QBER_HARD_LIMIT, QBER_WARN_LIMIT
from ..session import written
from .ordered import mark_smallest, positions, positions_in

ROUND_KEY = ["session_id", "round_id"]


def align(alice: DataFrame, bob: DataFrame, how: str = "inner") -> DataFrame:
    """Rounds of both parties side by side.

    The key (session, round) is unique on either side, so a hot session
    still spreads over all partitions. Tables written with
    ``sources.store.write_bucketed`` join without a shuffle.
    """
    a = alice.select(*ROUND_KEY, F.col("basis").alias("a_basis"), F.col("outcome").alias("a_bit"))
    b = bob.select(*ROUND_KEY, F.col("basis").alias("b_basis"), F.col("outcome").alias("b_bit"))
    return a.join(b, ROUND_KEY, how)


def sift(pairs: DataFrame) -> DataFrame:
    """Rounds with equal bases; ``basis`` 0 is partition I0, 1 is I1."""
    return pairs.where(F.col("a_basis") == F.col("b_basis")).select(
        "session_id", "round_id", F.col("a_basis").alias("basis"), "a_bit", "b_bit"
    )


def test_size(n: Column, fraction: float, minimum: int = 1) -> Column:
    """min(max(minimum, int(n * fraction)), n // 2)."""
    return F.least(F.greatest(F.lit(minimum), F.floor(n * fraction)), F.floor(n / 2)).cast("bigint")


def assign_roles(sifted: DataFrame, fraction: float, minimum: int = 1) -> DataFrame:
    """Sifted rows with ``is_test``: an exact-size random subset per session, fixed by the md5 of the round."""
    marked = sifted.withColumn("_digest", F.md5(F.concat(F.lit("test:"), F.col("round_id").cast("string"))))
    chosen = mark_smallest(marked, ["session_id"], "_digest", lambda n: test_size(n, fraction, minimum), "is_test")
    return chosen.drop("_digest")


def test_part(roles: DataFrame) -> DataFrame:
    return roles.where("is_test").drop("is_test")


def key_part(roles: DataFrame) -> DataFrame:
    return roles.where("NOT is_test").drop("is_test")


def key_rows(sifted: DataFrame, tested: DataFrame) -> DataFrame:
    """Matching rounds without the test rounds, when the two come as separate tables."""
    return sifted.join(tested.select(*ROUND_KEY), ROUND_KEY, "left_anti")


def error_estimate(roles: DataFrame, epsilon: float = finite.EPS_SEC) -> DataFrame:
    """Observed error rate, allowance and verdict per session; one map-side-combined pass.

    A session over the hard limit is flagged, not raised: one bad session
    must not stop the others.
    """
    c = F.col
    seen = roles.groupBy("session_id").agg(
        F.count_if(c("is_test")).alias("n_test"),
        F.count_if(~c("is_test")).alias("n_key"),
        F.count_if(c("is_test") & (c("a_bit") != c("b_bit"))).alias("n_errors"),
        F.count_if(~c("is_test") & (c("basis") == 0)).alias("i0"),
        F.count_if(~c("is_test") & (c("basis") == 1)).alias("i1"),
    )
    return (
        seen.where("n_key > 0 AND n_test > 0")
        .withColumn("observed", c("n_errors") / c("n_test"))
        .withColumn("penalty", finite.finite_size_penalty(c("n_key"), c("n_test"), epsilon))
        .withColumn("adjusted", c("observed") + c("penalty"))
        .withColumn(
            "verdict",
            F.when(c("adjusted") > QBER_HARD_LIMIT, "hard_limit").when(c("adjusted") > QBER_WARN_LIMIT, "warning").otherwise("pass"),
        )
    )


def partition_positions(sifted: DataFrame) -> DataFrame:
    """Position of each round in the matching list and inside its own partition."""
    basis = F.col("basis")
    placed = positions_in(sifted, ["session_id"], "round_id", {"pos": F.lit(True), "_p0": basis == 0, "_p1": basis == 1})
    return placed.withColumn("partition_pos", F.coalesce("_p0", "_p1")).drop("_p0", "_p1")


def blocks_of(rows: DataFrame, frame: int) -> DataFrame:
    """Number the rows of a session and cut them in frames; the last is shorter."""
    placed = positions(rows, ["session_id"], "round_id", out="pos", start=0)
    return placed.withColumn("block_id", F.floor(F.col("pos") / frame)).withColumn("offset", F.col("pos") % frame)


def block_errors(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("session_id", "block_id").agg(
        F.count(F.lit(1)).alias("n_bits"), F.count_if(F.col("a_bit") != F.col("b_bit")).alias("n_errors")
    )


def block_text(blocked: DataFrame, bit: str) -> DataFrame:
    """0/1 text of each block. A block is at most one frame, so the list is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.col(bit).cast("string").alias("b"))))
    return blocked.groupBy("session_id", "block_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("text"))


def packed_words(rows: DataFrame, keys: list[str], pos: str, *bit_columns: str) -> DataFrame:
    """64 rows to one row: little-endian words per bit column."""
    return rows.groupBy(*keys, bits.word_index(F.col(pos)).alias("word")).agg(
        F.count(F.lit(1)).alias("n_bits"), *[bits.packed_word(F.col(b), F.col(pos)).alias(b) for b in bit_columns]
    )


def keep_verified(blocked: DataFrame) -> DataFrame:
    """Rows of blocks without errors, renumbered without gaps; a block is at most one frame, so its window is bounded."""
    block = Window.partitionBy("session_id", "block_id")
    wrong = F.sum((F.col("a_bit") != F.col("b_bit")).cast("int")).over(block)
    judged = written(blocked.drop("pos").withColumn("_verified", wrong == 0), "judged-blocks")
    return positions_in(judged, ["session_id"], "round_id", {"pos": F.col("_verified")}).where("pos IS NOT NULL").drop("_verified")


def detection_report(pairs: DataFrame, expected: float, tolerance: float = 0.05, confidence: float = 0.999) -> DataFrame:
    """Detection rate and basis balance per session against their Hoeffding bounds."""
    delta = 1.0 - confidence
    c = F.col
    grouped = pairs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("detected").alias("detections"), F.count_if(c("a_basis") == 0).alias("n_basis0")
    )
    return (
        grouped.withColumn("rate", c("detections") / c("attempts"))
        .withColumn("basis0", c("n_basis0") / c("attempts"))
        .withColumn("allowed", finite.hoeffding_halfwidth(c("attempts"), delta))
        .withColumn("deviation", F.abs(c("rate") - expected))
        .withColumn(
            "tail",
            F.when(c("deviation") > 0, 2 * F.exp(-2 * c("attempts") * c("deviation") * c("deviation"))).otherwise(F.lit(1.0)),
        )
        .withColumn("detection_ok", (c("deviation") <= tolerance) & (c("deviation") <= c("allowed")))
        .withColumn("basis_ok", F.abs(c("basis0") - 0.5) <= c("allowed"))
        .withColumn(
            "message",
            F.when(c("detection_ok") & c("basis_ok"), "passed").otherwise(
                F.concat_ws("; ", F.when(~c("detection_ok"), "detection rate"), F.when(~c("basis_ok"), "basis imbalance"))
            ),
        )
    )


def generation_batches(sessions: DataFrame, total: str, size: int) -> DataFrame:
    """One row per batch: id, start, length; the last batch is shorter."""
    n = F.col(total)
    last = F.ceil(n / size) - 1
    return sessions.where(n > 0).withColumn("batch_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        *sessions.columns, "batch_id", (F.col("batch_id") * size).alias("start"), F.least(F.lit(size).cast("bigint"), n - F.col("batch_id") * size).alias("length")
    )


POISSON_STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count from a uniform number, by its distribution function."""
    w = F.lit(0)
    for step in POISSON_STEPS:
        w = w + F.when(u >= step, 1).otherwise(0)
    return w


def bootstrap_interval(df: DataFrame, group: str, row_key: str, value: str, replicates: int = 50) -> DataFrame:
    """Percentile interval of a mean. Every row draws a Poisson(1) weight per
    replicate from its digest; sums combine map-side, so the shuffle carries
    ``replicates`` rows per group and task.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col(row_key))), 1, 4), 16, 10).cast("double") / 65536
    drawn = df.select(group, row_key, value).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", poisson_weight(u))
    means = drawn.groupBy(group, "rep").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.groupBy(group).agg(
        F.count("m").alias("replicates"), F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper")
    )
