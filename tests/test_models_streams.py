import datetime
import random

import pytest
from pyspark.sql import functions as F

from pairsieve.operators import acquire, guardrail, surrogate
from pairsieve.operators.sweep import FEATURES
from pairsieve.session import scratch_path
from pairsieve.sources import messages, sinks, store
from pairsieve.streaming import base, jobs


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        f = [rng.random() for _ in FEATURES[:8]]
        s = i % 2
        y = max(0.0, 0.9 * f[3] - 0.3 * f[0] - 0.2 * s)
        rows.append((f"s{i:04d}", "blind" if s else "baseline", *f, float(s), y))
    cols = ", ".join(f"{n} double" for n in FEATURES)
    return spark.createDataFrame(rows, f"sample_key string, strategy string, {cols}, net_efficiency double")


def test_surrogate_learns(training):
    model = surrogate.fit(training, noise=1e-3)
    got = surrogate.fit_quality(surrogate.predict(training, model, ["strategy"], ("mu", "sd")), ["strategy"], "net_efficiency", "mu").collect()
    assert all(r.r2 > 0.8 for r in got)
    both = surrogate.predict_both(training, model).select(F.min("sd_blind").alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert both.s > 0 and both.n == 400


def test_partitioning_does_not_change_the_fit(training):
    a, b = surrogate.fit(training.repartition(1)), surrogate.fit(training.repartition(9))
    assert abs(a.weights["blind"] - b.weights["blind"]).max() < 1e-8


def test_guardrail_needs_rows_and_classes(training):
    assert guardrail.fit_guardrail(training.limit(20), trees=2) is None
    assert guardrail.fit_guardrail(training.withColumn("net_efficiency", F.lit(1.0)), trees=2) is None
    scored = guardrail.split(training, None)
    assert scored.where("guard = 'run'").count() == 400


def test_diverse_batch_brute_force(training):
    cand = training.withColumn("score", F.round(F.col("storage_noise_r"), 6))
    rows = {r.sample_key: r for r in cand.collect()}
    picks = []
    for _ in range(3):
        def total(k):
            gap = min((sum((rows[k][f] - rows[p][f]) ** 2 for f in FEATURES) ** 0.5 for p in picks), default=0.0)
            return round(rows[k].score + 0.5 * gap, 9)
        picks.append(min((k for k in rows if k not in picks), key=lambda k: (-total(k), k)))
    got = acquire.diverse_batch(cand, 3, "score", "sample_key", weight=0.5).orderBy("pick").collect()
    assert [r.sample_key for r in got] == picks


@pytest.mark.parametrize("n", [1, 7, 100, 997])
def test_latin_hypercube_strata(spark, n):
    df = acquire.latin_hypercube(spark.range(n).withColumnRenamed("id", "sample_id"), n)
    row = df.agg(*[F.count_distinct(f"stratum_{d}").alias(d) for d in acquire.BOUNDS], F.sum("strategy_code").alias("blind")).first()
    assert all(row[d] == n for d in acquire.BOUNDS) and row.blind == n // 2
    for d, (lo, hi) in acquire.BOUNDS.items():
        assert df.where(~F.col(d).between(lo, hi)).isEmpty()


def ledger_files(spark, parts):
    path = scratch_path(spark, "test-ledger")
    schema = "session_id bigint, entry_id bigint, syndrome_bits bigint, hash_bits bigint, retry_bits bigint, shortening_bits double"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_budget_over_many_batches(spark):
    parts = [[(1, 0, 60, 0, 0, 0.0), (2, 1, 10, 0, 0, 0.0)], [(1, 2, 40, 0, 0, 0.0)], [(1, 3, 1, 0, 0, 0.0), (2, 4, 5, 0, 0, 0.5)]]
    got = {r.entry_id: (r.total, r.accepted) for r in jobs.budget_check(ledger_files(spark, parts), 100).collect()}
    assert got == {0: (60.0, True), 1: (10.0, True), 2: (100.0, True), 3: (101.0, False), 4: (15.5, True)}


def message_files(spark, parts):
    path = scratch_path(spark, "test-messages")
    schema = "session_id bigint, seq bigint, allowed boolean, ts timestamp"
    for rows in parts:
        timed = [(s, q, ok, datetime.datetime(2026, 1, 1, 0, minute)) for s, q, ok, minute in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sequence_over_many_batches(spark):
    parts = [[(1, 0, True, 0), (1, 1, True, 0), (2, 0, True, 1)], [(1, 2, True, 2), (2, 2, True, 3)], [(1, 4, True, 4), (2, 3, False, 5)]]
    got = {(r.session_id, r.seq, r.violation) for r in jobs.sequence_check(message_files(spark, parts)).collect()}
    assert got == {(2, 2, "out_of_order"), (1, 4, "out_of_order"), (2, 3, "wrong_type")}


def test_sequence_waits_for_late_messages(spark):
    # 1 comes an epoch after 2, within the delay; in session 7 it comes when the watermark has passed
    parts = [
        [(5, 0, True, 0), (5, 2, True, 1), (7, 0, True, 0), (7, 2, True, 1)],
        [(5, 1, True, 1)],
        [(5, 3, True, 40)],
        [(7, 1, True, 2), (7, 3, True, 41)],
    ]
    got = {(r.session_id, r.seq, r.violation) for r in jobs.sequence_check(message_files(spark, parts)).collect()}
    assert got == {(7, 2, "out_of_order"), (7, 1, "out_of_order")}


def test_phase_order(spark):
    path = scratch_path(spark, "test-phases")
    rows = [(1, 0, "DECODING"), (1, 1, "VERIFIED"), (1, 2, "DONE"), (1, 3, "DECODING"), (2, 4, "DECODING")]
    spark.createDataFrame(rows, "session_id bigint, event_id bigint, phase string").write.parquet(path)
    stream = spark.readStream.schema("session_id bigint, event_id bigint, phase string").parquet(path)
    assert [(r.session_id, r.event_id) for r in jobs.phase_check(stream).collect()] == [(1, 3)]


def test_store_round_trip(spark):
    path = store.new_store(spark, "test")
    assert store.read_results(spark, path).count() == 0
    row = spark.createDataFrame([("a", "lhs_warmup", "success", 5), ("b", "active_learning", "success", 6)], "sample_key string, phase string, outcome string, num_pairs bigint")
    full = row
    for f in store.RESULT_SCHEMA:
        if f.name not in full.columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    store.append_results(full, path)
    store.append_results(full.withColumn("sample_key", F.lit("c")).limit(1), path)
    assert store.read_results(spark, path).count() == 3
    left = store.remaining(spark.createDataFrame([("a",), ("z",)], "sample_key string"), store.read_results(spark, path))
    assert [r.sample_key for r in left.collect()] == ["z"]


def test_malformed_messages_are_kept(spark):
    df = spark.createDataFrame([(1, '{"msg_type":"x","payload":{"k":3},"seq":1,"session_id":"s"}'), (2, '{"seq": '), (3, "plain")], "i int, raw string")
    assert {r.i: r.is_valid for r in messages.parse(df, "raw").collect()} == {1: True, 2: False, 3: False}


def test_markdown(spark):
    text = sinks.markdown(spark.createDataFrame([(1, None)], "a int, b string"), "T")
    assert text.splitlines() == ["# T", "", "| a | b |", "| --- | --- |", "| 1 |  |"]


def test_event_path_is_a_pattern():
    assert base.event_path("/x").startswith("/x/events")
