"""Sessions: alignment, sifting, estimates, blocks, ledger (groups C1-C6, D1-D8, D13-D14, D28-D31, E1-E3, E7-E9, F, G, A12-A13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rates
from ..operators import contracts as rules
from ..operators import ledger, sifting
from ..operators.ordered import positions, prefix_digits, prefix_of, previous, running
from ..operators.skew import attach
from ..session import written
from ..sources import store, views
from . import oracle as o
from .common import k, tidy
from .registry import query, view

c = F.col
FRACTION_SMALL, FRACTION_LARGE = 0.3, 0.1

view("v_sifted", "SELECT session_id, round_id, a_basis AS basis, a_bit, b_bit FROM v_pairs WHERE a_basis = b_basis")
view("v_large_sifted", "SELECT session_id, round_id, a_basis AS basis, a_bit, b_bit FROM v_large WHERE a_basis = b_basis")


def _tested(src: str, f: float) -> str:
    return f"""
SELECT session_id, round_id, basis, a_bit, b_bit FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY md5('test:' || round_id)) AS rk, count(*) OVER (PARTITION BY session_id) AS n FROM {src})
WHERE rk <= least(greatest(1, CAST(floor(n * {f}::DOUBLE) AS BIGINT)), n // 2)"""


view("v_tested", _tested("v_sifted", FRACTION_SMALL))
view("v_large_tested", _tested("v_large_sifted", FRACTION_LARGE))
view("v_large_tested3", _tested("v_large_sifted", 0.3))
view("v_key", "SELECT s.* FROM v_sifted s ANTI JOIN v_tested t ON s.session_id = t.session_id AND s.round_id = t.round_id")
view("v_large_key", "SELECT s.* FROM v_large_sifted s ANTI JOIN v_large_tested t ON s.session_id = t.session_id AND s.round_id = t.round_id")


def sifted(spark, sf) -> DataFrame:
    return sifting.sift(views.pairs(spark, sf))


def large_sifted(spark, sf) -> DataFrame:
    return sifting.sift(views.pairs_large(spark, sf))


@query("c1_align_parties", """
SELECT session_id, count(*) FILTER (in_b) AS matched, count(*) FILTER (NOT in_b) AS alice_only, CAST(0 AS BIGINT) AS bob_only
FROM (SELECT session_id, detected AS in_b FROM v_pairs) GROUP BY 1""")
def c1(spark, sf):
    # Bob has no row for rounds he did not detect
    a, b = views.alice(spark, sf), views.bob(spark, sf).where("detected")
    both = sifting.align(a, b, "full_outer")
    return both.groupBy("session_id").agg(
        F.count_if(c("a_bit").isNotNull() & c("b_bit").isNotNull()).alias("matched"),
        F.count_if(c("b_bit").isNull()).alias("alice_only"),
        F.count_if(c("a_bit").isNull()).alias("bob_only"),
    )


BUCKETS = 16  # of the stored tables; a deployment takes about one per 256 MB


@query("c1_stored_alignment", "SELECT session_id, round_id, a_basis::BIGINT AS a_basis, a_bit::BIGINT AS a_bit, b_basis::BIGINT AS b_basis, b_bit::BIGINT AS b_bit FROM v_pairs WHERE detected")
def c1_stored(spark, sf):
    # both sides are stored in the same buckets; the join reads them bucket by bucket
    a = store.write_bucketed(views.alice(spark, sf), "alice", sifting.ROUND_KEY, BUCKETS)
    b = store.write_bucketed(views.bob(spark, sf).where("detected"), "bob", sifting.ROUND_KEY, BUCKETS)
    return tidy(sifting.align(spark.table(a).hint("merge"), spark.table(b)))


@query("c2_sift", "SELECT session_id, round_id, CAST(basis AS BIGINT) AS basis, CAST(a_bit AS BIGINT) AS a_bit, CAST(b_bit AS BIGINT) AS b_bit FROM v_sifted")
def c2(spark, sf):
    return tidy(sifting.sift(sifting.align(views.alice(spark, sf), views.bob(spark, sf))))


@query("c3_partition_positions", """
SELECT session_id, round_id, CAST(basis AS BIGINT) AS basis, CAST(a_bit AS BIGINT) AS a_bit, row_number() OVER (PARTITION BY session_id ORDER BY round_id) - 1 AS pos,
  row_number() OVER (PARTITION BY session_id, basis ORDER BY round_id) - 1 AS partition_pos FROM v_sifted""")
def c3(spark, sf):
    return tidy(sifting.partition_positions(sifted(spark, sf)).select("session_id", "round_id", "basis", "a_bit", "pos", "partition_pos"))


@query("c4_i0_in_key", "SELECT session_id, round_id FROM v_sifted i WHERE basis = 0 AND EXISTS (SELECT 1 FROM v_key x WHERE x.session_id = i.session_id AND x.round_id = i.round_id)")
def c4(spark, sf):
    s = sifted(spark, sf)
    key = sifting.key_part(sifting.assign_roles(s, FRACTION_SMALL))
    return s.where("basis = 0").select("session_id", "round_id").join(key.select("session_id", "round_id"), ["session_id", "round_id"], "left_semi")


@query("c5_key_rounds", "SELECT session_id, round_id FROM v_key")
def c5(spark, sf):
    s = sifted(spark, sf)
    return sifting.key_rows(s, sifting.test_part(sifting.assign_roles(s, FRACTION_SMALL))).select("session_id", "round_id")


@query("f2_test_subset", "SELECT session_id, round_id FROM v_tested")
def f2(spark, sf):
    return sifting.test_part(sifting.assign_roles(sifted(spark, sf), FRACTION_SMALL)).select("session_id", "round_id")


@query("f2_test_subset_large", "SELECT round_id FROM v_large_tested")
def f2_large(spark, sf):
    return sifting.test_part(sifting.assign_roles(large_sifted(spark, sf), FRACTION_LARGE)).select("round_id")


@query("d1_match_counts", "SELECT session_id, count(*) AS total, count(*) FILTER (basis = 0) AS i0, count(*) FILTER (basis = 1) AS i1 FROM v_sifted GROUP BY 1")
def d1(spark, sf):
    return sifted(spark, sf).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c("basis") == 0).alias("i0"), F.count_if(c("basis") == 1).alias("i1")
    )


@query("d2_match_rate", "SELECT session_id, round(coalesce(avg((a_basis = b_basis)::INT), 0), 9) AS match_rate FROM v_pairs GROUP BY 1")
def d2(spark, sf):
    same = (c("a_basis") == c("b_basis")).cast("int")
    return tidy(views.pairs(spark, sf).groupBy("session_id").agg(F.coalesce(F.avg(same), F.lit(0.0)).alias("match_rate")))


@query("d3_observed_error", "SELECT session_id, count(*) AS n_test, round(sum((a_bit <> b_bit)::INT) / count(*)::DOUBLE, 9) AS observed FROM v_tested GROUP BY 1")
def d3(spark, sf):
    t = sifting.test_part(sifting.assign_roles(sifted(spark, sf), FRACTION_SMALL))
    wrong = (c("a_bit") != c("b_bit")).cast("int")
    return tidy(t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_test"), (F.sum(wrong) / F.count(F.lit(1))).alias("observed")))


def _estimate(src: str, tst: str, eps: float) -> str:
    return f"""
SELECT session_id, n_key, n_test, n_errors, round(observed, 9) AS observed, round(penalty, 9) AS penalty, round(observed + penalty, 9) AS adjusted,
  CASE WHEN observed + penalty > 0.22 THEN 'hard_limit' WHEN observed + penalty > 0.11 THEN 'warning' ELSE 'pass' END AS verdict
FROM (SELECT *, n_errors / n_test::DOUBLE AS observed, {o.mu('n_key', 'n_test', eps)} AS penalty FROM (
  SELECT session_id, n - n_test AS n_key, n_test, n_errors FROM (SELECT session_id, count(*) AS n FROM {src} GROUP BY 1)
   JOIN (SELECT session_id, count(*) AS n_test, count(*) FILTER (a_bit <> b_bit) AS n_errors FROM {tst} GROUP BY 1) USING (session_id)) WHERE n_key > 0)"""


_EST_COLS = ("session_id", "n_key", "n_test", "n_errors", "observed", "penalty", "adjusted", "verdict")


@query("d4_error_estimate", _estimate("v_sifted", "v_tested", 1e-10))
def d4(spark, sf):
    s = sifting.sift(sifting.align(views.alice(spark, sf), views.bob(spark, sf)))
    return tidy(sifting.error_estimate(sifting.assign_roles(s, FRACTION_SMALL)).select(*_EST_COLS))


@query("d4_error_estimate_large", _estimate("v_large_sifted", "v_large_tested", 1e-10))
def d4_large(spark, sf):
    s = large_sifted(spark, sf)
    return tidy(sifting.error_estimate(sifting.assign_roles(s, FRACTION_LARGE)).select(*_EST_COLS))


@query("d4_error_estimate_loose", _estimate("v_large_sifted", "v_large_tested3", 1e-3))
def d4_loose(spark, sf):
    s = large_sifted(spark, sf)
    return tidy(sifting.error_estimate(sifting.assign_roles(s, 0.3), 1e-3).select(*_EST_COLS))


_ALLOW = "sqrt(7.600902459542082 / (2 * attempts))"


@query("d5_detection_validation", f"""
SELECT session_id, attempts, round(rate, 9) AS rate, round(abs(rate - 0.8::DOUBLE), 9) AS deviation, round(CASE WHEN abs(rate - 0.8::DOUBLE) > 0 THEN 2 * exp(-2 * attempts * abs(rate - 0.8::DOUBLE) * abs(rate - 0.8::DOUBLE)) ELSE 1.0 END, 9) AS tail,
  det AS detection_ok, bas AS basis_ok, CASE WHEN det AND bas THEN 'passed' ELSE concat_ws('; ', CASE WHEN NOT det THEN 'detection rate' END, CASE WHEN NOT bas THEN 'basis imbalance' END) END AS message
FROM (SELECT *, abs(rate - 0.8::DOUBLE) <= 0.05::DOUBLE AND abs(rate - 0.8::DOUBLE) <= {_ALLOW} AS det, abs(b0 - 0.5::DOUBLE) <= {_ALLOW} AS bas FROM (
  SELECT session_id, count(*) AS attempts, count(*) FILTER (detected) / count(*)::DOUBLE AS rate, count(*) FILTER (a_basis = 0) / count(*)::DOUBLE AS b0 FROM v_pairs GROUP BY 1))""")
def d5(spark, sf):
    r = sifting.detection_report(views.pairs(spark, sf), 0.8)
    return tidy(r.select("session_id", "attempts", "rate", "deviation", "tail", "detection_ok", "basis_ok", "message"))


BATCH = 16


@query("d6_batch_rollup", """
SELECT session_id, count(DISTINCT batch_id) AS batches, count(*) AS pairs, sum(a_bit)::BIGINT AS ones FROM (
 SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY round_id) - 1) // 16 AS batch_id FROM v_pairs) GROUP BY 1""")
def d6(spark, sf):
    b = positions(views.pairs(spark, sf), ["session_id"], "round_id", out="pos", start=0).withColumn("batch_id", F.floor(c("pos") / BATCH))
    per = b.groupBy("session_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("a_bit").alias("ones"))
    return per.groupBy("session_id").agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("pairs"), F.sum("ones").alias("ones"))


@query("a13_generation_batches", """
SELECT session_id, n AS total, b AS batch_id, b * 16 AS start, least(16, n - b * 16) AS length FROM (
  SELECT session_id, n, unnest(range(0, (n + 15) // 16)) AS b FROM (SELECT session_id, count(*) AS n FROM v_pairs GROUP BY 1))""")
def a13(spark, sf):
    per = views.pairs(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    return tidy(sifting.generation_batches(per, "total", BATCH))


FRAME = 16

view("v_blocked", "SELECT *, pos // 16 AS block_id, pos % 16 AS offs FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round_id) - 1 AS pos FROM v_key)")
view("v_block", "SELECT session_id, block_id, count(*) AS n_bits, count(*) FILTER (a_bit <> b_bit) AS n_errors FROM v_blocked GROUP BY 1, 2")
view("v_large_blocked", "SELECT *, pos // 4096 AS block_id, pos % 4096 AS offs FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round_id) - 1 AS pos FROM v_large_key)")


def roles_of(sifted_rows: DataFrame, fraction: float) -> DataFrame:
    """Sifted rows with their roles, written: the rows are read once for the histogram and once for the ranks, and not again."""
    return written(sifting.assign_roles(sifted_rows, fraction), "roles")


def key_blocks(spark, sf, frame: int = FRAME, roles: DataFrame | None = None) -> DataFrame:
    roles = roles if roles is not None else roles_of(sifted(spark, sf), FRACTION_SMALL)
    return sifting.blocks_of(sifting.key_part(roles), frame)


def large_key_blocks(spark, sf, frame: int = rates.FRAME) -> DataFrame:
    return sifting.blocks_of(sifting.key_part(roles_of(large_sifted(spark, sf), FRACTION_LARGE)), frame)


view("v_frames", """
SELECT session_id, round_id, pos // 4096 AS block_id, pos % 4096 AS offs, a_bit, b_bit FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round_id) - 1 AS pos FROM (
 SELECT session_id, round_id, a_bit, b_bit FROM v_key UNION ALL SELECT CAST(-1 AS BIGINT), round_id, a_bit, b_bit FROM v_large_key))""")
FRAME_KEYS = ["session_id", "block_id"]


def frames_of(spark, sf) -> DataFrame:
    """Key bits of all sessions in frames of 4,096, the large session under id -1; a session's last frame is shorter."""
    cols = ("session_id", "round_id", "block_id", "offset", "a_bit", "b_bit")
    large = large_key_blocks(spark, sf).withColumn("session_id", F.lit(-1).cast("bigint"))
    both = key_blocks(spark, sf, rates.FRAME).select(*cols).unionByName(large.select(*cols))
    return written(both, "frames")


@query("d7_block_partition", "SELECT session_id, round_id, block_id, offs AS \"offset\" FROM v_blocked")
def d7(spark, sf):
    return key_blocks(spark, sf).select("session_id", "round_id", "block_id", "offset")


@query("d8_block_errors", "SELECT session_id, block_id, n_bits, n_errors, round(n_errors / n_bits::DOUBLE, 9) AS rate FROM v_block")
def d8(spark, sf):
    return tidy(sifting.block_errors(key_blocks(spark, sf)).withColumn("rate", c("n_errors") / c("n_bits")))


@query("d8_block_errors_large", "SELECT block_id, count(*) AS n_bits, count(*) FILTER (a_bit <> b_bit) AS n_errors FROM v_large_blocked GROUP BY 1")
def d8_large(spark, sf):
    return sifting.block_errors(large_key_blocks(spark, sf)).select("block_id", "n_bits", "n_errors")


@query("c6_verified_gather", """
SELECT session_id, round_id, row_number() OVER (PARTITION BY session_id ORDER BY round_id) - 1 AS pos FROM v_blocked SEMI JOIN (SELECT * FROM v_block WHERE n_errors = 0) USING (session_id, block_id)""")
def c6(spark, sf):
    return sifting.keep_verified(key_blocks(spark, sf)).select("session_id", "round_id", "pos")


@query("d14_block_rollup", """
SELECT session_id, count(*) FILTER (n_errors = 0) AS blocks_ok, count(*) FILTER (n_errors > 0) AS blocks_failed, coalesce(sum(n_bits) FILTER (n_errors = 0), 0)::BIGINT AS verified_bits,
  coalesce(sum((n_bits + 1) // 2 + 50) FILTER (n_errors = 0), 0)::BIGINT AS leakage,
  round(1 - coalesce(sum((n_bits + 1) // 2) FILTER (n_errors = 0), 0) / nullif(sum(n_bits) FILTER (n_errors = 0), 0)::DOUBLE, 9) AS effective_rate FROM v_block GROUP BY 1""")
def d14(spark, sf):
    b = sifting.block_errors(key_blocks(spark, sf)).withColumn("ok", c("n_errors") == 0).withColumn("syndrome", F.ceil(c("n_bits") / 2))
    good = lambda x: F.coalesce(F.sum(F.when(c("ok"), x)), F.lit(0))
    return tidy(
        b.groupBy("session_id").agg(
            F.count_if("ok").alias("blocks_ok"), F.count_if(~c("ok")).alias("blocks_failed"), good(c("n_bits")).alias("verified_bits"),
            good(c("syndrome") + rates.TAG_BITS).alias("leakage"),
            (1 - good(c("syndrome")) / F.sum(F.when(c("ok"), c("n_bits")))).alias("effective_rate"),
        )
    )


@query("d13_leakage_totals", """
SELECT session_id, count(*) AS entries, CAST(ceil(sum(syndrome_bits + hash_bits + retry_bits + shortening_bits) - 1e-9) AS BIGINT) AS total,
  7000 - CAST(ceil(sum(syndrome_bits + hash_bits + retry_bits + shortening_bits) - 1e-9) AS BIGINT) AS remaining, ceil(sum(syndrome_bits + hash_bits + retry_bits + shortening_bits) - 1e-9) <= 7000 AS within_cap
FROM v_leakage GROUP BY 1""")
def d13(spark, sf):
    return ledger.totals(views.leakage(spark, sf), views.LEDGER_CAP)


view("v_running", """SELECT session_id, entry_id, sum(syndrome_bits + hash_bits + retry_bits + shortening_bits) OVER (PARTITION BY session_id ORDER BY entry_id ROWS UNBOUNDED PRECEDING) AS total FROM v_leakage""")


@query("e2_cumulative_leakage", "SELECT session_id, entry_id, round(total, 6) AS total FROM v_running")
def e2(spark, sf):
    return tidy(ledger.cumulative(views.leakage(spark, sf)).select("session_id", "entry_id", "total"), 6)


@query("e3_first_breach", """
SELECT session_id, min(entry_id) AS breach_entry, CAST(min(ceil(total - 1e-9)) AS BIGINT) AS breach_total, count(*) AS n_refused FROM v_running WHERE ceil(total - 1e-9) > 7000 GROUP BY 1""")
def e3(spark, sf):
    return ledger.first_breach(views.leakage(spark, sf), views.LEDGER_CAP)


@query("e1_dense_position", "SELECT session_id, round_id, row_number() OVER (PARTITION BY session_id ORDER BY round_id) AS pos FROM v_sifted")
def e1(spark, sf):
    return positions(sifted(spark, sf), ["session_id"], "round_id").select("session_id", "round_id", "pos")


@query("e1_dense_position_large", "SELECT round_id, row_number() OVER (ORDER BY round_id) AS pos FROM v_large_sifted")
def e1_large(spark, sf):
    return positions(large_sifted(spark, sf), ["session_id"], "round_id").select("round_id", "pos")


@query("e7_sequence_gap", """
SELECT session_id, seq, prev_seq, seq - prev_seq - 1 AS missing FROM (SELECT *, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS prev_seq FROM v_messages) WHERE seq <> coalesce(prev_seq, -1) + 1""")
def e7(spark, sf):
    p = previous(views.messages(spark, sf), ["session_id"], "seq", {"prev_seq": c("seq")})
    return p.where(c("seq") != F.coalesce(c("prev_seq"), F.lit(-1)) + 1).select("session_id", "seq", "prev_seq", (c("seq") - c("prev_seq") - 1).alias("missing"))


@query("e8_disclosure_schedule", """
SELECT session_id, iteration, count(*) AS disclosed, sum(count(*)) OVER (PARTITION BY session_id ORDER BY iteration)::BIGINT AS cumulative FROM (
  SELECT session_id, CASE WHEN it <= 3 THEN it END AS iteration FROM (
   SELECT *, CASE WHEN pos < ini THEN 0 WHEN pos >= 20 THEN NULL ELSE (pos - ini) // 6 + 1 END AS it FROM (
    SELECT b.session_id, b.pos, CASE WHEN q > 0.05 THEN 2 ELSE 0 END AS ini FROM v_blocked b JOIN
     (SELECT session_id, avg((a_bit <> b_bit)::INT) AS q FROM v_tested GROUP BY 1) USING (session_id)))) WHERE iteration IS NOT NULL GROUP BY 1, 2""")
def e8(spark, sf):
    from pyspark.sql import Window

    roles = roles_of(sifted(spark, sf), FRACTION_SMALL)
    q = sifting.test_part(roles).groupBy("session_id").agg(F.avg((c("a_bit") != c("b_bit")).cast("int")).alias("q"))
    rows = attach(key_blocks(spark, sf, roles=roles), q, ["session_id"], ["round_id"])
    sched = ledger.disclosure_schedule(rows, "pos", c("q"), d=20, rounds=3).where("iteration IS NOT NULL")
    # at most rounds + 1 rows per session reach the window
    per = sched.groupBy("session_id", "iteration").agg(F.count(F.lit(1)).alias("disclosed"))
    upto = Window.partitionBy("session_id").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return tidy(per.withColumn("cumulative", F.sum("disclosed").over(upto)))


@query("e9_barrier_elapsed", """
SELECT session_id, event_id, CASE WHEN t0 IS NULL OR ts < t0 THEN 'no_barrier' WHEN epoch_us(ts) - epoch_us(t0) < 3600000000 THEN 'too_early' ELSE 'ok' END AS state
FROM (SELECT user_id AS session_id, event_id, event_type, ts, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS t0 FROM events) WHERE event_type = 'click'""")
def e9(spark, sf):
    # 'purchase' marks the barrier, 'click' is a reveal; the first marker is a map-side minimum per session
    ev = views.read_table(spark, sf, "events").select(c("user_id").alias("session_id"), "event_id", "event_type", "ts")
    first = ev.where("event_type = 'purchase'").groupBy("session_id").agg(F.min("ts").alias("t0"))
    reveals = attach(ev.where("event_type = 'click'"), first, ["session_id"], ["event_id"], "left")
    micros = lambda x: F.unix_micros(c(x).cast("timestamp"))
    waited = micros("ts") - micros("t0")
    state = F.when(c("t0").isNull() | (c("ts") < c("t0")), "no_barrier").when(waited < 3_600_000_000, "too_early").otherwise("ok")
    return reveals.select("session_id", "event_id", state.alias("state"))


@query("f1_order_by_batch", """
SELECT batch_id, first_round, n FROM (SELECT round_id // 64 AS batch_id, min(round_id) AS first_round, count(*) AS n FROM v_pairs GROUP BY 1) ORDER BY batch_id""")
def f1(spark, sf):
    b = views.pairs(spark, sf).groupBy(F.floor(c("round_id") / 64).alias("batch_id"))
    return b.agg(F.min("round_id").alias("first_round"), F.count(F.lit(1)).alias("n")).orderBy("batch_id")


@query("f3_shuffle_rows", "SELECT round_id, row_number() OVER (ORDER BY md5('mix:' || round_id)) AS place FROM v_pairs")
def f3(spark, sf):
    mixed = views.pairs(spark, sf).select("round_id", F.md5(F.concat(F.lit("mix:"), c("round_id").cast("string"))).alias("d"))
    return positions(mixed, [], "d", out="place", bucket=prefix_of("d", prefix_digits(mixed))).select("round_id", "place")


@query("f9_biased_choice", f"SELECT event_id, CAST({o.byte_of('bias', 'event_id')} < 77 AS INTEGER) AS basis, {o.coin('fair', 'event_id')} AS fair FROM events")
def f9(spark, sf):
    e = c("event_id")
    return views.read_table(spark, sf, "events").select("event_id", (views.byte_of("bias", e) < 77).cast("int").alias("basis"), views.coin("fair", e).alias("fair"))


@query("f10_fold_split", f"SELECT sample_key, {o.byte_of('fold', 'sample_key')}::BIGINT % 5 AS fold, {o.byte_of('hold', 'sample_key')} < 51 AS holdout FROM v_samples")
def f10(spark, sf):
    s = views.samples(spark, sf)
    return tidy(s.select("sample_key", (views.byte_of("fold", k.sample_key) % 5).alias("fold"), (views.byte_of("hold", k.sample_key) < 51).alias("holdout")))


@query("g1_union_phases", "SELECT phase, count(*) AS n FROM v_results GROUP BY 1")
def g1(spark, sf):
    r = views.results(spark, sf)
    both = r.where("phase = 'lhs_warmup'").unionByName(r.where("phase = 'active_learning'"))
    return both.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("g2_intersect", "SELECT session_id, round_id FROM v_sifted WHERE basis = 0 INTERSECT SELECT session_id, round_id FROM v_key")
def g2(spark, sf):
    s = sifted(spark, sf)
    key = sifting.key_part(sifting.assign_roles(s, FRACTION_SMALL)).select("session_id", "round_id")
    return s.where("basis = 0").select("session_id", "round_id").intersect(key)


@query("g3_except", "SELECT session_id, round_id FROM v_sifted EXCEPT SELECT session_id, round_id FROM v_tested")
def g3(spark, sf):
    s = sifted(spark, sf)
    t = sifting.test_part(sifting.assign_roles(s, FRACTION_SMALL))
    return s.select("session_id", "round_id").subtract(t.select("session_id", "round_id"))


@query("a12_synthetic_pairs", f"""
SELECT event_id AS round_id, a_basis, b_basis, a_bit, CASE WHEN a_basis = b_basis AND noise >= 26 THEN a_bit ELSE b_free END AS b_bit FROM (
 SELECT event_id, {o.coin('sa', 'event_id')} AS a_basis, {o.coin('sb', 'event_id')} AS b_basis, {o.coin('so', 'event_id')} AS a_bit, {o.byte_of('sn', 'event_id')} AS noise, {o.coin('sf', 'event_id')} AS b_free FROM events)""")
def a12(spark, sf):
    from ..sources.synth import synthetic_pairs

    ids = views.read_table(spark, sf, "events").select(c("event_id").alias("round_id"))
    return synthetic_pairs(ids, "round_id", 26 / 256)


@query("d28_batch_bias", """
SELECT session_id, batch_id, round(m, 9) AS batch_mean, round(g, 9) AS session_mean, abs(m - g) < 0.10 AS ok FROM (
 SELECT session_id, batch_id, avg(a_bit) AS m FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY round_id) - 1) // 16 AS batch_id FROM v_pairs) GROUP BY 1, 2)
 JOIN (SELECT session_id, avg(a_bit) AS g FROM v_pairs GROUP BY 1) USING (session_id)""")
def d28(spark, sf):
    p = positions(views.pairs(spark, sf), ["session_id"], "round_id", out="pos", start=0)
    per = p.groupBy("session_id", F.floor(c("pos") / BATCH).alias("batch_id")).agg(F.sum("a_bit").alias("ones"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("session_id").agg((F.sum("ones") / F.sum("n")).alias("session_mean"))
    both = attach(per.withColumn("batch_mean", c("ones") / c("n")), whole, ["session_id"], ["batch_id"])
    return tidy(both.select("session_id", "batch_id", "batch_mean", "session_mean", (F.abs(c("batch_mean") - c("session_mean")) < 0.10).alias("ok")))


@query("d29_running_error_counts", """
SELECT session_id, batch_id, sum(e) OVER w::BIGINT AS errors, sum(n) OVER w::BIGINT AS tests FROM (
 SELECT session_id, round_id // 1000 AS batch_id, count(*) FILTER (a_bit <> b_bit) AS e, count(*) AS n FROM v_tested GROUP BY 1, 2) WINDOW w AS (PARTITION BY session_id ORDER BY batch_id)""".replace("sum(e) OVER w::BIGINT", "CAST(sum(e) OVER w AS BIGINT)").replace("sum(n) OVER w::BIGINT", "CAST(sum(n) OVER w AS BIGINT)"))
def d29(spark, sf):
    t = sifting.test_part(sifting.assign_roles(sifted(spark, sf), FRACTION_SMALL))
    per = t.groupBy("session_id", F.floor(c("round_id") / 1000).alias("batch_id")).agg(
        F.count_if(c("a_bit") != c("b_bit")).alias("e"), F.count(F.lit(1)).alias("n")
    )
    return running(per, ["session_id"], "batch_id", {"errors": ("sum", c("e")), "tests": ("sum", c("n"))}).select("session_id", "batch_id", "errors", "tests")


@query("d30_error_interval", """
SELECT session_id, round(p, 9) AS p, round(p - 1.96::DOUBLE * sqrt(p * (1 - p) / n), 9) AS lower, round(p + 1.96::DOUBLE * sqrt(p * (1 - p) / n), 9) AS upper
FROM (SELECT session_id, avg((a_bit <> b_bit)::INT) AS p, count(*) AS n FROM v_tested GROUP BY 1)""")
def d30(spark, sf):
    t = sifting.test_part(sifting.assign_roles(sifted(spark, sf), FRACTION_SMALL))
    g = t.groupBy("session_id").agg(F.avg((c("a_bit") != c("b_bit")).cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    lo, hi = rates.binomial_interval(c("p"), c("n"))
    return tidy(g.select("session_id", "p", lo.alias("lower"), hi.alias("upper")))


_PW = " + ".join(f"CASE WHEN u >= {s!r} THEN 1 ELSE 0 END" for s in sifting.POISSON_STEPS)


@query("d31_bootstrap_interval", f"""
SELECT strategy, count(m) AS replicates, round(avg(m), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS lower, round(quantile_cont(m, 0.975), 9) AS upper FROM (
 SELECT strategy, rep, sum(w * net_efficiency) / sum(w) AS m FROM (
  SELECT *, {_PW} AS w FROM (SELECT strategy, rep, net_efficiency, ('0x' || substr(md5(rep || ':' || sample_key), 1, 4))::INTEGER / 65536.0::DOUBLE AS u
   FROM (SELECT * FROM v_results WHERE outcome = 'success'), range(1, 51) t(rep))) GROUP BY 1, 2) GROUP BY 1""")
def d31(spark, sf):
    df = views.results(spark, sf).where("outcome = 'success'")
    return tidy(sifting.bootstrap_interval(df, "strategy", "sample_key", "net_efficiency"))


@query("b7_session_contracts", f"""
SELECT session_id, concat_ws(',', CASE WHEN n_a <> n THEN 'POST-Q-001' END, CASE WHEN adjusted > 0.22 THEN 'POST-S-003' END, CASE WHEN leaked > cap THEN 'POST-R-001' END, CASE WHEN failed > 0 THEN 'POST-R-002' END) AS violations
FROM (SELECT e.session_id, p.n, p.n_a, e.adjusted, b.leaked, b.failed, greatest(0, CAST(trunc(e.n_key * (1 - {o.h('least(e.adjusted, 1)')})) AS BIGINT)) AS cap
 FROM ({_estimate('v_sifted', 'v_tested', 1e-2)}) e JOIN (SELECT session_id, count(*) AS n, count(*) FILTER (detected) AS n_a FROM v_pairs GROUP BY 1) p USING (session_id)
 JOIN (SELECT session_id, sum((n_bits + 1) // 2) AS leaked, count(*) FILTER (n_errors > 0) AS failed FROM v_block GROUP BY 1) b USING (session_id))""")
def b7(spark, sf):
    s = sifted(spark, sf)
    est = sifting.error_estimate(sifting.assign_roles(s, FRACTION_SMALL), 1e-2)
    gen = views.pairs(spark, sf).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("n_a"),
        F.count_if(~c("a_bit").isin(0, 1)).alias("bad_o"), F.count_if(~c("a_basis").isin(0, 1)).alias("bad_b"),
    )
    blk = sifting.block_errors(key_blocks(spark, sf)).groupBy("session_id").agg(
        F.sum(F.ceil(c("n_bits") / 2)).alias("leaked"), F.count_if(c("n_errors") > 0).alias("failed")
    )
    both = est.join(gen, "session_id").join(blk, "session_id")
    cap = rates.safety_cap(c("n_key"), F.least(c("adjusted"), F.lit(1.0)))
    checks = {
        **rules.generation_rules(c("n_a"), c("n"), c("n"), c("bad_o"), c("bad_b")),
        **rules.sifting_rules(c("n_key"), c("n_key"), c("observed"), c("penalty"), c("adjusted"), 0.22),
        **rules.correction_rules(c("leaked"), cap, c("failed") == 0),
    }
    return both.select("session_id", rules.violated(checks).alias("violations"))


@query("b7_result_contracts", """
SELECT sample_key, concat_ws(',', CASE WHEN final_key_length <= 0 THEN 'POST-AMP-001' END, CASE WHEN leakage_bits < final_key_length THEN 'POST-AMP-002' END) AS violations FROM v_results WHERE outcome <> 'skipped_infeasible'""")
def b7_results(spark, sf):
    r = views.results(spark, sf).where("outcome <> 'skipped_infeasible'")
    return r.select("sample_key", rules.violated(rules.amplification_rules(c("final_key_length"), c("leakage_bits"))).alias("violations"))
