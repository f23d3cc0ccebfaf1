import datetime
import random

import pytest

from pairsieve.session import scratch_path
from pairsieve.streaming import held, jobs

START = datetime.datetime(2026, 1, 1)


def files(spark, schema, parts):
    """A stream of one file a trigger; the last column of each row is its minute."""
    path = scratch_path(spark, "test-held")
    for rows in parts:
        timed = [(*r[:-1], START + datetime.timedelta(minutes=r[-1])) for r in rows]
        spark.createDataFrame(timed, schema + ", ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def test_mark_an_epoch_after_its_reveal(spark):
    schema = "session_id bigint, event_id bigint, is_mark boolean, is_reveal boolean"
    parts = [
        [(1, 11, False, True, 70), (2, 20, True, False, 0), (2, 21, False, True, 30)],
        [(1, 10, True, False, 0)],  # within the delay of two hours
        [(3, 30, False, True, 140)],
        [(1, 12, False, True, 150), (9, 90, False, False, 400)],
        [(2, 22, True, False, 1), (9, 91, False, False, 500)],  # behind the watermark: dropped
    ]
    got = {r.event_id: r.state for r in jobs.barrier_check(files(spark, schema, parts), 3_600_000_000, "2 hours").collect()}
    assert got == {11: "ok", 21: "too_early", 30: "no_barrier", 12: "ok"}


def test_budget_in_the_order_of_time(spark, monkeypatch):
    monkeypatch.setattr(held, "COMPACT", 2)
    schema = "session_id bigint, entry_id bigint, syndrome_bits bigint, hash_bits bigint, retry_bits bigint, shortening_bits double"
    parts = [[(1, 1, 60, 0, 0, 0.0, 10)], [(1, 0, 30, 0, 0, 0.0, 5)], [(1, 2, 20, 0, 0, 0.0, 20), (2, 3, 7, 0, 0, 0.5, 30)]]
    parts += [[(7, 100 + k, 1, 0, 0, 0.0, 1000 + 100 * k)] for k in range(3)]  # past compactions of the carried table
    got = {r.entry_id: (r.total, r.accepted) for r in jobs.budget_check(files(spark, schema, parts), 100, "1 hour").collect()}
    assert got == {0: (30.0, True), 1: (90.0, True), 2: (110.0, False), 3: (7.5, True)} | {100 + k: (k + 1.0, True) for k in range(2)}


def test_phases_wait_for_late_rows(spark):
    schema = "session_id bigint, event_id bigint, phase string"
    parts = [[(1, 2, "DECODING", 2)], [(1, 1, "DONE", 1), (1, 3, "DONE", 3)], [(2, 9, "DECODING", 500)]]
    got = [(r.session_id, r.event_id) for r in jobs.phase_check(files(spark, schema, parts), "1 hour").collect()]
    assert got == [(1, 2)]


def test_state_goes_with_the_watermark(spark):
    parts = [[(s, k, 60 * k) for s in range(20)] for k in range(6)]
    stream = held.held(files(spark, "session_id bigint, n bigint", parts), ["session_id", "n"], "90 minutes", buckets=4)
    before = spark.conf.get(held.STATE_STORE)
    spark.conf.set(held.STATE_STORE, held.ROCKSDB)
    path = scratch_path(spark, "test-state")
    seen = []
    query = stream.writeStream.option("checkpointLocation", path).trigger(availableNow=True)
    query = query.foreachBatch(lambda batch, epoch: seen.append((epoch, sorted((r.session_id, r.n) for r in batch.collect())))).start()
    query.awaitTermination()
    spark.conf.set(held.STATE_STORE, before)
    released = [r for _, rows in seen for r in rows]
    assert sorted(released) == [(s, k) for s in range(20) for k in range(4)]  # latest row at 300 minutes: up to 210
    entries = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(entries) <= 4 * 3 and entries[-1] <= 4 * 2


def plain_links(rows):
    """The same rules one row after another."""
    out, state = set(), {}
    for r in sorted(rows, key=lambda r: (r["link_id"], r["n"])):
        s = state.setdefault(r["link_id"], {"seq": -1, "last": None, "wait": False})
        bad = None
        if r["session_id"] != r["link_session"]:
            bad = "session_mismatch"
        elif r["is_ack"]:
            if s["wait"] and (r["ack_seq"], r["ack_type"]) == s["last"]:
                s["wait"] = False
            else:
                bad = "ack_mismatch"
        else:
            bad = "out_of_order" if r["seq"] != s["seq"] + 1 else "wrong_type" if not r["allowed"] else "not_acknowledged" if s["wait"] else None
            s.update(seq=r["seq"], last=(r["seq"], r["msg_type"]), wait=True)
        if bad:
            out.add((r["link_id"], r["n"], bad))
    return out


LINK = "link_id bigint, n bigint, session_id bigint, link_session bigint, is_ack boolean, seq bigint, msg_type string, allowed boolean, ack_seq bigint, ack_type string"


def random_links(seed):
    rng, rows = random.Random(seed), []
    for link in range(4):
        seq = 0
        for n in range(120):
            ack = rng.random() < 0.5
            kind = rng.choice("ab")
            if not ack:
                seq += rng.choice([1, 1, 1, 1, 2, 0])
            values = (link, n, rng.choice([link] * 12 + [9]), link, ack, seq - 1, kind, rng.random() < 0.9)
            rows.append((*values, (seq - 1 + (rng.random() < 0.1)) if ack else None, rng.choice([kind, rng.choice("ab")]) if ack else None, n))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_links_like_one_walk(spark, seed):
    rows = random_links(seed)
    rng = random.Random(seed)
    parts = [[] for _ in range(5)]
    for r in rows:  # in five epochs, some rows one late
        k = r[-1] // 25
        parts[min(4, k + (rng.random() < 0.2))].append(r)
    got = {(r.link_id, r.n, r.violation) for r in jobs.link_check(files(spark, LINK, [*parts, [(99, 0, 99, 99, False, 0, "a", True, None, None, 1000)]]), "60 minutes").collect()}
    names = [f.split()[0] for f in LINK.split(", ")]
    want = plain_links([dict(zip(names, r, strict=False)) for r in rows])
    assert got == want and len({v for *_, v in want}) == 5


def test_stream_without_rows(spark):
    assert jobs.link_check(files(spark, LINK, [[]]), "1 hour").count() == 0


def test_rows_wait_without_python(spark):
    stream = held.held(files(spark, "session_id bigint, n bigint", [[(1, 1, 0)]]), ["session_id", "n"], "1 hour")
    plan = stream._jdf.queryExecution().logical().toString()
    assert "Aggregate" in plan and "PySpark" not in plan and "Python" not in plan


def test_released_rows_are_judged_with_adaptive_execution(spark):
    modes, seen = [], []

    def step(rows, carried):
        modes.append(rows.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        seen.append(rows.count())
        return rows.select("k"), rows.groupBy("k").count().select("k", "count")

    rows = [(1, 0), (1, 0), (2, 5)]  # equal rows stay two
    stream = held.held(files(spark, "k bigint", [rows, [(3, 200)]]), ["k"], "1 hour", buckets=2)
    got = held.drain_released(stream, "test-adaptive", ["k"], "k bigint, count bigint", "k bigint", step)
    assert sorted(r.k for r in got.collect()) == [1, 1, 2]
    assert seen == [3] and modes == ["true"]
