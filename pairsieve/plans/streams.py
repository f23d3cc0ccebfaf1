"""Streaming jobs run to the end of their source, with batch SQL as reference.

Every source comes in ``EPOCHS`` files, one a trigger, cut along time; rows
shortly before a cut come one epoch late, within the delay of the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from ..session import scratch_path, written
from ..sources import store, views
from ..streaming import base, jobs
from . import oracle as o
from .common import tidy
from .registry import query, view

c = F.col


EPOCHS = 5
LATE, LATE_LONG = 9, 330  # minutes; the delays of the jobs are 10 minutes and 6 hours
LONG_DELAY = "6 hours"


def in_epochs(spark, df: DataFrame, label: str, late_minutes: int = LATE) -> DataFrame:
    """``df`` as a stream of files, one a trigger, cut by ``ts``; every other row of the last minutes before a cut comes an epoch late."""
    path = scratch_path(spark, label)
    first, last = df.agg(F.min(F.unix_micros(c("ts").cast("timestamp"))), F.max(F.unix_micros(c("ts").cast("timestamp")))).first()
    step = max(1, ((last or 0) - (first or 0)) // EPOCHS + 1)
    at = F.unix_micros(c("ts").cast("timestamp")) - F.lit(first or 0)
    part = F.floor(at / step)
    late = ((part + 1) * step - at <= late_minutes * 60_000_000) & (F.pmod(F.xxhash64(*[c(n) for n in df.columns]), F.lit(2)) == 0)
    cut = written(df.withColumn("_part", F.least(part + late.cast("int"), F.lit(EPOCHS - 1))), "epochs", by="_part")
    return base.file_epochs(cut, "_part", EPOCHS, path)


def events_in_epochs(spark, sf, late_minutes: int = LATE) -> DataFrame:
    ev = views.read_table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    return in_epochs(spark, ev, "events", late_minutes)


def rounds(spark, sf, events: DataFrame | None = None) -> DataFrame:
    """Pair rounds as a stream (same columns as the batch view)."""
    ev = events if events is not None else events_in_epochs(spark, sf)
    rid = c("event_id")
    return ev.select(
        c("user_id").alias("session_id"), rid.alias("round_id"), "ts", (c("event_type") != "error").alias("detected"),
        views.coin("ab", rid).alias("a_basis"), views.coin("bb", rid).alias("b_basis"), views.coin("ao", rid).alias("a_bit"),
    ).withColumns(views.pair_columns(c("round_id")))


def tests(spark, sf) -> DataFrame:
    """A streaming session has no end, so test rounds are drawn by digest share (77 of 256)."""
    return rounds(spark, sf).where((c("a_basis") == c("b_basis")) & (views.byte_of("stest", c("round_id")) < 77))


view("v_stream_tests", f"SELECT * FROM v_pairs WHERE a_basis = b_basis AND {o.byte_of('stest', 'round_id')} < 77")
view("v_mark", "SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events")
view("v_test_mark", "SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM v_stream_tests")


@query("k1_detection_monitor", """
SELECT CAST(epoch(ws) AS BIGINT) AS window_start, n AS attempts, round(r, 9) AS rate, abs(r - 0.8::DOUBLE) <= sqrt(7.600902459542082 / (2 * n)) AS rate_ok, abs(b - 0.5::DOUBLE) <= sqrt(7.600902459542082 / (2 * n)) AS basis_ok FROM (
 SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ws, count(*) AS n, count(*) FILTER (detected) / count(*)::DOUBLE AS r, count(*) FILTER (a_basis = 0) / count(*)::DOUBLE AS b FROM v_pairs GROUP BY 1)
WHERE ws + INTERVAL 6 HOUR <= (SELECT w FROM v_mark)""")
def k1(spark, sf):
    got = base.drain(jobs.detection_windows(rounds(spark, sf), 0.8), "detection")
    return tidy(got.withColumn("window_start", c("window_start").cast("bigint")))


@query("k2_running_error", "SELECT session_id, count(*) FILTER (a_bit <> b_bit) AS errors, count(*) AS tests, round(count(*) FILTER (a_bit <> b_bit) / count(*)::DOUBLE, 9) AS rate FROM v_stream_tests GROUP BY 1")
def k2(spark, sf):
    got = base.drain_latest(jobs.running_error(tests(spark, sf)), "error", ["session_id"])
    return tidy(got.withColumn("rate", c("errors") / c("tests")))


@query("k3_sliding_error", """
SELECT CAST(epoch(ws) AS BIGINT) AS window_start, count(*) FILTER (a_bit <> b_bit) AS errors, count(*) AS tests FROM (
 SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * i AS ws FROM v_stream_tests, range(0, 2) t(i)) GROUP BY ws HAVING ws + INTERVAL 12 HOUR <= (SELECT w FROM v_test_mark)""")
def k3(spark, sf):
    got = base.drain(jobs.sliding_error(tests(spark, sf)), "sliding")
    return tidy(got.withColumn("window_start", c("window_start").cast("bigint")))


@query("k4_stream_alignment", "SELECT session_id, round_id, a_basis::BIGINT AS a_basis, a_bit::BIGINT AS a_bit, b_basis::BIGINT AS b_basis, b_bit::BIGINT AS b_bit FROM v_pairs WHERE detected")
def k4(spark, sf):
    ev = events_in_epochs(spark, sf)
    a = rounds(spark, sf, ev).select("session_id", "round_id", "ts", c("a_basis").alias("basis"), c("a_bit").alias("outcome"))
    # Bob sees a round two minutes later, and only if he detected it
    b = rounds(spark, sf, ev).where("detected").select(
        "session_id", "round_id", (c("ts") + F.expr("INTERVAL 2 minutes")).alias("ts"), c("b_basis").alias("basis"), c("b_bit").alias("outcome")
    )
    return tidy(base.drain(jobs.align_streams(a, b), "aligned"))


def message_stream(spark, sf) -> DataFrame:
    """Messages numbered by the sender (batch view), read back as a stream."""
    return in_epochs(spark, views.messages(spark, sf).withColumn("allowed", c("msg_type") != "error").withColumn("ts", c("ts").cast("timestamp")), "messages")


@query("k5_sequence_validator", """
SELECT session_id, seq, CASE WHEN seq <> coalesce(p, -1) + 1 THEN 'out_of_order' ELSE 'wrong_type' END AS violation FROM (SELECT *, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM v_messages)
WHERE seq <> coalesce(p, -1) + 1 OR msg_type = 'error'""")
def k5(spark, sf):
    return jobs.sequence_check(message_stream(spark, sf))


# the log of a link: each message, then its acknowledgements; some are of another session, wrong, repeated or missing
view("v_link", """
SELECT *, user_id AS link_id, user_id AS link_session, 4 * event_id AS n, CASE WHEN event_id % 101 = 5 THEN user_id + 1 ELSE user_id END AS session_id, false AS is_ack,
 CAST(NULL AS BIGINT) AS ack_seq, CAST(NULL AS VARCHAR) AS ack_type FROM v_numbered
UNION ALL SELECT v_numbered.*, user_id, user_id, 4 * event_id + 1 + r, CASE WHEN event_id % 103 = 7 THEN user_id + 1 ELSE user_id END, true,
 CASE WHEN event_id % 17 = 3 THEN seq + 1 ELSE seq END, CASE WHEN event_id % 23 = 6 THEN 'other' ELSE event_type END
FROM v_numbered, (SELECT unnest(range(2)) AS r) WHERE event_id % 13 <> 0 AND (r = 0 OR event_id % 19 = 4)""")
view("v_numbered", "SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events QUALIFY event_id % 97 <> 0")
view("v_long_mark", "SELECT max(ts) - INTERVAL 6 HOUR AS w FROM events")


def link_rows(spark, sf) -> DataFrame:
    ev = views.read_table(spark, sf, "events").select(c("user_id").alias("link_id"), "event_id", "event_type", c("ts").cast("timestamp").alias("ts"))
    numbered = positions(ev, ["link_id"], "event_id", out="seq", start=0).where("event_id % 97 <> 0")
    foreign = lambda m, r: F.when(c("event_id") % m == r, c("link_id") + 1).otherwise(c("link_id"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    base = ("link_id", c("link_id").alias("link_session"), "ts", "seq", c("event_type").alias("msg_type"), (c("event_type") != "error").alias("allowed"))
    sent = numbered.select(*base, (4 * c("event_id")).alias("n"), foreign(101, 5).alias("session_id"), F.lit(False).alias("is_ack"), number.alias("ack_seq"), text.alias("ack_type"))
    again = numbered.where("event_id % 13 <> 0").withColumn("r", F.explode(F.when(c("event_id") % 19 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    acks = again.select(
        *base, (4 * c("event_id") + 1 + c("r")).alias("n"), foreign(103, 7).alias("session_id"), F.lit(True).alias("is_ack"),
        F.when(c("event_id") % 17 == 3, c("seq") + 1).otherwise(c("seq")).alias("ack_seq"), F.when(c("event_id") % 23 == 6, "other").otherwise(c("event_type")).alias("ack_type"),
    )
    return sent.unionByName(acks)


@query("k5_link_validator", """
SELECT link_id, n, violation FROM (SELECT link_id, n, CASE WHEN session_id <> link_session THEN 'session_mismatch'
  WHEN is_ack THEN CASE WHEN NOT good OR coalesce(before, 0) = 0 THEN 'ack_mismatch' END
  WHEN seq <> coalesce(last_seq, -1) + 1 THEN 'out_of_order' WHEN event_type = 'error' THEN 'wrong_type' WHEN coalesce(before, 0) = 1 THEN 'not_acknowledged' END AS violation FROM (
 SELECT *, last_value(CASE WHEN own AND NOT is_ack THEN 1 WHEN good THEN 0 END IGNORE NULLS) OVER w AS before FROM (
  SELECT *, coalesce(own AND is_ack AND ack_seq = last_seq AND ack_type = last_type, false) AS good FROM (
   SELECT *, session_id = link_session AS own, last_value(CASE WHEN session_id = link_session AND NOT is_ack THEN seq END IGNORE NULLS) OVER w AS last_seq,
    last_value(CASE WHEN session_id = link_session AND NOT is_ack THEN event_type END IGNORE NULLS) OVER w AS last_type
   FROM v_link WHERE ts <= (SELECT w FROM v_long_mark) WINDOW w AS (PARTITION BY link_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
 WINDOW w AS (PARTITION BY link_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) WHERE violation IS NOT NULL""")
def k5_link(spark, sf):
    return jobs.link_check(in_epochs(spark, link_rows(spark, sf), "links", LATE_LONG), LONG_DELAY)


@query("k6_ack_timeout", """
SELECT user_id AS session_id, event_id FROM events WHERE (event_id % 13 = 0 OR event_id % 17 = 0) AND ts + INTERVAL 1 HOUR < (SELECT w FROM v_mark)""")
def k6(spark, sf):
    ev = events_in_epochs(spark, sf)
    sends = ev.select(c("user_id").alias("session_id"), "event_id", "ts")
    # one message in 13 is never acknowledged, one in 17 two hours late
    late = F.when(c("event_id") % 17 == 0, F.expr("INTERVAL 2 hours")).otherwise(F.expr("INTERVAL 10 seconds"))
    acks = ev.where("event_id % 13 <> 0").select(
        c("user_id").alias("ack_session"), c("event_id").alias("ack_id"), (c("ts") + late).alias("ack_ts")
    )
    return base.drain(jobs.ack_timeouts(sends, acks), "acks")


# rows are judged once the watermark has passed them; at the end of the source that is six hours before its latest row
@query("k7_barrier", """
SELECT session_id, event_id, CASE WHEN t0 IS NULL OR ts < t0 THEN 'no_barrier' WHEN epoch_us(ts) - epoch_us(t0) < 3600000000 THEN 'too_early' ELSE 'ok' END AS state
FROM (SELECT user_id AS session_id, event_id, event_type, ts, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS t0 FROM events) WHERE event_type = 'click' AND ts <= (SELECT w FROM v_long_mark)""")
def k7(spark, sf):
    ev = events_in_epochs(spark, sf, LATE_LONG).select(
        c("user_id").alias("session_id"), "event_id", "ts", (c("event_type") == "purchase").alias("is_mark"), (c("event_type") == "click").alias("is_reveal")
    )
    return jobs.barrier_check(ev, 3_600_000_000, LONG_DELAY)


@query("k8_leakage_budget", "SELECT session_id, entry_id, round(total, 6) AS total, ceil(total - 1e-9) <= 7000 AS accepted FROM v_running JOIN v_leakage USING (session_id, entry_id) WHERE ts <= (SELECT w FROM v_long_mark)")
def k8(spark, sf):
    batch = views.leakage(spark, sf).withColumn("ts", c("ts").cast("timestamp"))
    return tidy(jobs.budget_check(in_epochs(spark, batch, "ledger", LATE_LONG), views.LEDGER_CAP, LONG_DELAY), 6)


@query("k9_phase_order", """
SELECT session_id, event_id, phase FROM (SELECT *, min(CASE WHEN phase IN ('DONE', 'FAILED') THEN event_id END) OVER (PARTITION BY session_id) AS ended FROM (
 SELECT user_id AS session_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' ELSE 'DECODING' END AS phase FROM events)) WHERE event_id > ended AND phase <> 'DONE' AND ts <= (SELECT w FROM v_long_mark)""")
def k9(spark, sf):
    phase = F.when(c("event_type") == "purchase", "DONE").when(c("event_type") == "error", "FAILED").otherwise("DECODING")
    ev = events_in_epochs(spark, sf, LATE_LONG).select(c("user_id").alias("session_id"), "event_id", "ts", phase.alias("phase"))
    return jobs.phase_check(ev, LONG_DELAY)


@query("k10_session_closeout", """
SELECT session_id, epoch_us(min(ts)) // 1000000 AS opened, count(*) AS tests, count(*) FILTER (a_bit <> b_bit) AS errors FROM (
 SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM v_stream_tests))
GROUP BY session_id, part HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT w FROM v_test_mark)""")
def k10(spark, sf):
    got = base.drain(jobs.session_closeout(tests(spark, sf)), "closeout")
    return tidy(got.withColumn("opened", c("opened").cast("bigint")))


@query("k11_results_ingest", "SELECT phase, outcome, count(DISTINCT sample_key) AS n FROM v_results GROUP BY 1, 2")
def k11(spark, sf):
    r = store.conform(views.results(spark, sf)).withColumn("ts", F.timestamp_seconds(1_704_067_200 + c("num_pairs") % 1000))
    path, target = scratch_path(spark, "arrivals"), store.new_store(spark, "ingest")
    cut = written(r.withColumn("_part", F.pmod(F.xxhash64("sample_key"), F.lit(EPOCHS))), "arrivals", by="_part")
    again = cut.where("outcome = 'success'").withColumn("_part", F.lit(EPOCHS))  # some evaluations arrive twice
    jobs.ingest_results(base.file_epochs(cut.unionByName(again), "_part", EPOCHS + 1, path), target)
    return store.read_results(spark, target).groupBy("phase", "outcome").agg(F.count(F.lit(1)).alias("n"))
