"""The streaming jobs: monitors, alignment, protocol checks, budget, ingest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import entry_bits, whole_bits
from ..operators.ordered import previous, running
from ..operators.skew import attach
from ..session import cut_lineage
from ..sources import store
from .base import drain_with_carry, run_on_disk
from .held import drain_released, held

c = F.col
DELAY = "10 minutes"


def detection_windows(rounds: DataFrame, expected: float, width: str = "6 hours", confidence: float = 0.999) -> DataFrame:
    """Detection rate per tumbling window against its Hoeffding bound.

    Rows older than the watermark are dropped by the engine and counted in
    the progress metrics (numRowsDroppedByWatermark).
    """
    g = rounds.withWatermark("ts", DELAY).groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(c("detected")).alias("detections"), F.count_if(c("a_basis") == 0).alias("n_basis0")
    )
    rate = c("detections") / c("attempts")
    allowed = F.sqrt(F.lit(math.log(2 / (1 - confidence))) / (2 * c("attempts")))
    return g.select(
        c("window.start").alias("window_start"), "attempts", rate.alias("rate"), (F.abs(rate - expected) <= allowed).alias("rate_ok"),
        (F.abs(c("n_basis0") / c("attempts") - 0.5) <= allowed).alias("basis_ok"),
    )


def running_error(tests: DataFrame) -> DataFrame:
    return tests.groupBy("session_id").agg(
        F.count_if(c("a_bit") != c("b_bit")).alias("errors"), F.count(F.lit(1)).alias("tests")
    )


def sliding_error(tests: DataFrame, width: str = "12 hours", slide: str = "6 hours") -> DataFrame:
    g = tests.withWatermark("ts", DELAY).groupBy(F.window("ts", width, slide)).agg(
        F.count_if(c("a_bit") != c("b_bit")).alias("errors"), F.count(F.lit(1)).alias("tests")
    )
    return g.select(c("window.start").alias("window_start"), "errors", "tests")


def align_streams(alice: DataFrame, bob: DataFrame, slack: str = "5 minutes") -> DataFrame:
    """Match rounds as they arrive; the time bound lets old state expire."""
    a = alice.withWatermark("ts", DELAY).alias("a")
    b = bob.withWatermark("ts", DELAY).alias("b")
    near = F.expr(f"a.ts BETWEEN b.ts - INTERVAL {slack} AND b.ts + INTERVAL {slack}")
    same = (c("a.session_id") == c("b.session_id")) & (c("a.round_id") == c("b.round_id"))
    return a.join(b, same & near).select(
        c("a.session_id").alias("session_id"), c("a.round_id").alias("round_id"),
        c("a.basis").alias("a_basis"), c("a.outcome").alias("a_bit"), c("b.basis").alias("b_basis"), c("b.outcome").alias("b_bit"),
    )


def ack_timeouts(sends: DataFrame, acks: DataFrame, limit: str = "1 hour") -> DataFrame:
    """Messages without an acknowledgement in time: the unmatched side of a stream-stream join."""
    s = sends.withWatermark("ts", DELAY).alias("s")
    a = acks.withWatermark("ack_ts", DELAY).alias("a")
    near = F.expr(f"a.ack_ts BETWEEN s.ts AND s.ts + INTERVAL {limit}")
    same = (c("s.session_id") == c("a.ack_session")) & (c("s.event_id") == c("a.ack_id"))
    return s.join(a, same & near, "left_outer").where("a.ack_id IS NULL").select(c("s.session_id").alias("session_id"), c("s.event_id").alias("event_id"))


def session_closeout(tests: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Error counts of a session once it has been silent for ``gap``."""
    g = tests.withWatermark("ts", DELAY).groupBy("session_id", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(c("a_bit") != c("b_bit")).alias("errors")
    )
    return g.select("session_id", c("session_window.start").alias("opened"), "tests", "errors")


SEQUENCE_STATE = "session_id bigint, seq bigint, allowed boolean, ts timestamp, settled boolean"


def sequence_check(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows that break the numbering (seq = previous + 1) or carry a type that is not allowed.

    Messages have session_id, seq, allowed, ts. A gap is judged once the
    watermark (latest time seen less ``delay``) has passed the row behind it;
    until then that row and those after it wait for the missing ones. A row
    whose number is already settled is out of order. The carried table holds
    the last settled number of each session, the waiting rows, and in a row
    without session the latest time.
    """

    def judge(fresh: DataFrame, carried: DataFrame, mark: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        settled = carried.where("settled AND session_id IS NOT NULL").select("session_id", c("seq").alias("last_seq"))
        waiting = carried.where("NOT settled").select("session_id", "seq", "allowed", "ts")
        rows = waiting.unionByName(fresh.select("session_id", "seq", "allowed", "ts"))
        rows = attach(rows, settled, ["session_id"], ["seq"], "left")
        stale = rows.where(c("seq") <= c("last_seq"))
        open_ = rows.where(c("last_seq").isNull() | (c("seq") > c("last_seq")))
        both = previous(open_, ["session_id"], "seq", {"prev": c("seq")})
        gap = c("seq") != F.coalesce(c("prev"), c("last_seq"), F.lit(-1)) + 1
        both = cut_lineage(both.withColumn("gap", gap))
        holds = both.where(c("gap") & (c("ts") >= mark)).groupBy("session_id").agg(F.min("seq").alias("hold"))
        placed = attach(both, holds, ["session_id"], ["seq"], "left")
        done = placed.where(c("hold").isNull() | (c("seq") < c("hold")))
        kind = F.when(c("gap"), "out_of_order").when(~c("allowed"), "wrong_type")
        out = done.select("session_id", "seq", kind.alias("violation")).where("violation IS NOT NULL")
        out = out.unionByName(stale.select("session_id", "seq", F.lit("out_of_order").alias("violation")))
        upto = done.groupBy("session_id").agg(F.max("seq").alias("last_seq"))
        return out, _merge(settled, upto, "last_seq", F.greatest), placed.where(c("seq") >= c("hold"))

    def step(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        latest = batch.select("ts").unionByName(carried.where("session_id IS NULL").select("ts")).agg(F.max("ts").alias("ts")).first()["ts"]
        mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        out, settled, waiting = judge(batch, carried, mark)
        nothing = F.lit(None)
        after = settled.select("session_id", c("last_seq").alias("seq"), F.lit(True).alias("allowed"), nothing.cast("timestamp").alias("ts"), F.lit(True).alias("settled"))
        after = after.unionByName(waiting.select("session_id", "seq", "allowed", "ts", F.lit(False).alias("settled")))
        clock = batch.sparkSession.range(1).select(
            nothing.cast("bigint").alias("session_id"), nothing.cast("bigint").alias("seq"), F.lit(True).alias("allowed"), F.lit(latest).cast("timestamp").alias("ts"), F.lit(True).alias("settled")
        )
        return out, after.unionByName(clock)

    def finish(carried: DataFrame) -> DataFrame:
        none = carried.where("false").select("session_id", "seq", "allowed", "ts")
        return judge(none, carried, F.expr("TIMESTAMP '9999-01-01'"))[0]

    return drain_with_carry(messages, "sequence", SEQUENCE_STATE, "session_id bigint, seq bigint, violation string", step, finish)


def _merge(carried: DataFrame, fresh: DataFrame, value: str, choose) -> DataFrame:
    both = carried.withColumnRenamed(value, "_old").join(fresh.withColumnRenamed(value, "_new"), "session_id", "full_outer")
    return both.select("session_id", choose(c("_old"), c("_new")).alias(value))


def _changed(carried: DataFrame, fresh: DataFrame, value: str, choose) -> DataFrame:
    """The carried rows of the keys in ``fresh``, brought up to date."""
    both = fresh.withColumnRenamed(value, "_new").join(carried.withColumnRenamed(value, "_old"), "session_id", "left")
    return both.select("session_id", choose(c("_old"), c("_new")).alias(value))


def _drain(rows: DataFrame, label: str, state_schema: str, out_schema: str, step, value: str, choose, wait: str | None, order: str) -> DataFrame:
    """Rows as they come, or with ``wait`` only once the watermark has passed them."""
    if wait is not None:
        def changes(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
            out, fresh = step(batch, carried)
            return out, _changed(carried, fresh, value, choose)

        return drain_released(held(rows, ["session_id", order], wait), label, ["session_id"], state_schema, out_schema, changes)

    def whole(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        out, fresh = step(batch, carried)
        return out, _merge(carried, fresh, value, choose)

    return drain_with_carry(rows, label, state_schema, out_schema, whole)


def barrier_check(events: DataFrame, wait_us: int, wait: str | None = None) -> DataFrame:
    """Reveals before the waiting time has passed since the first barrier mark of the session.

    With ``wait`` rows are judged when the watermark (latest ts less ``wait``)
    has passed them, so a mark that comes epochs after its reveal still counts.
    """

    def step(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        fresh = batch.where("is_mark").groupBy("session_id").agg(F.min("ts").alias("t0"))
        both = attach(batch.where("is_reveal"), _merge(carried, fresh, "t0", F.least), ["session_id"], ["event_id"], "left")
        waited = F.unix_micros("ts") - F.unix_micros("t0")
        state = F.when(c("t0").isNull() | (c("ts") < c("t0")), "no_barrier").when(waited < wait_us, "too_early").otherwise("ok")
        return both.select("session_id", "event_id", state.alias("state")), fresh

    schema = "session_id bigint, event_id bigint, state string"
    return _drain(events, "barrier", "session_id bigint, t0 timestamp", schema, step, "t0", F.least, wait, "event_id")


def budget_check(ledger: DataFrame, cap: int, wait: str | None = None) -> DataFrame:
    """Running disclosure per session; entries beyond the cap are refused.

    With ``wait`` entries are booked when the watermark has passed their ts,
    those released together in the order of entry_id.
    """

    def step(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = running(batch, ["session_id"], "entry_id", {"own": ("sum", entry_bits())})
        both = attach(own, carried, ["session_id"], ["entry_id"], "left")
        total = c("own") + F.coalesce(c("spent"), F.lit(0.0))
        rows = both.select("session_id", "entry_id", total.alias("total"), (whole_bits(total) <= cap).alias("accepted"))
        return rows, batch.groupBy("session_id").agg(F.sum(entry_bits()).alias("spent"))

    add = lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    schema = "session_id bigint, entry_id bigint, total double, accepted boolean"
    return _drain(ledger, "budget", "session_id bigint, spent double", schema, step, "spent", add, wait, "entry_id")


TERMINAL = ("DONE", "FAILED", "VERIFIED")


def phase_check(phases: DataFrame, wait: str | None = None) -> DataFrame:
    """Once a session is in a terminal phase only DONE may follow; with ``wait`` judged when the watermark has passed a row's ts."""

    def step(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        fresh = batch.where(c("phase").isin(*TERMINAL)).groupBy("session_id").agg(F.min("event_id").alias("ended"))
        both = attach(batch, _merge(carried, fresh, "ended", F.least), ["session_id"], ["event_id"], "left")
        bad = both.where((c("event_id") > c("ended")) & (c("phase") != "DONE"))
        return bad.select("session_id", "event_id", "phase"), fresh

    schema = "session_id bigint, event_id bigint, phase string"
    return _drain(phases, "phases", "session_id bigint, ended bigint", schema, step, "ended", F.least, wait, "event_id")


IDLE, WAITING = 0, 1
LINK_STATE = "link_id bigint, n bigint, seq bigint, msg_type string, state int"


def link_violations(rows: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(link_id, n, violation) of complete rows in the order ``n``, and what the links carry on.

    Rows have link_id, n, session_id, link_session, is_ack, seq, msg_type,
    allowed, ack_seq, ack_type. A row of another session is reported and
    changes nothing. A message must have the number after the last one, be of
    an allowed type, and not be sent before the last one is acknowledged; an
    acknowledgement must name the last message, once.

    Whether a message waits is told by the last row that settles it: a message
    sets it, the right acknowledgement clears it, all else leaves it.
    """
    rows = rows.withColumn("own", c("session_id").eqNullSafe(c("link_session")))
    sent = c("own") & ~c("is_ack")
    last = F.when(sent, F.struct("n", "seq", "msg_type"))
    seen = running(rows, ["link_id"], "n", {"last": ("max", last)}, inclusive=False)
    before = carried.select("link_id", F.struct("n", "seq", "msg_type").alias("_before"), c("state").alias("_state"))
    seen = attach(seen, before, ["link_id"], ["n"], "left").withColumn("last", F.coalesce("last", "_before")).drop("_before")
    right = c("own") & c("is_ack") & F.coalesce((c("ack_seq") == c("last.seq")) & (c("ack_type") == c("last.msg_type")), F.lit(False))
    seen = cut_lineage(seen.withColumn("right", right))
    settles = F.when(sent, F.struct("n", F.lit(WAITING).alias("state"))).when(c("right"), F.struct("n", F.lit(IDLE).alias("state")))
    judged = running(seen, ["link_id"], "n", {"settled": ("max", settles)}, inclusive=False)
    judged = judged.withColumn("state", F.coalesce("settled.state", "_state", F.lit(IDLE)))
    kind = (
        F.when(~c("own"), "session_mismatch")
        .when(c("is_ack"), F.when(~c("right") | (c("state") == IDLE), "ack_mismatch"))
        .when(c("seq") != F.coalesce(c("last.seq"), F.lit(-1)) + 1, "out_of_order")
        .when(~c("allowed"), "wrong_type")
        .when(c("state") == WAITING, "not_acknowledged")
    )
    out = judged.select("link_id", "n", kind.alias("violation")).where("violation IS NOT NULL")
    ends = seen.groupBy("link_id").agg(F.max(last).alias("new"), F.max(settles).alias("settled"))
    after = ends.join(before, "link_id", "left").withColumn("r", F.coalesce("new", "_before"))
    return out, after.select("link_id", "r.n", "r.seq", "r.msg_type", F.coalesce("settled.state", "_state", F.lit(IDLE)).alias("state"))


def link_check(rows: DataFrame, wait: str) -> DataFrame:
    """``link_violations`` of a stream; rows are judged when the watermark (latest ts less ``wait``) has passed them."""
    released = held(rows, ["link_id", "n"], wait)
    return drain_released(released, "links", ["link_id"], LINK_STATE, "link_id bigint, n bigint, violation string", link_violations)


def ingest_results(stream: DataFrame, path: str, key: str = "sample_key") -> None:
    """Append completed evaluations to the results store, each key once; the keys of a day wait on disk."""
    once = stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, epoch: int) -> None:
        # an epoch owns its folder: a repeated epoch replaces its own rows only
        store.conform(batch).write.mode("overwrite").partitionBy("phase").parquet(f"{path}/epoch={epoch}")

    query = once.writeStream.option("checkpointLocation", path + "-state").trigger(availableNow=True)
    run_on_disk(stream.sparkSession, query.foreachBatch(write))

