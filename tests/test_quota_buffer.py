import random

import pytest
from pyspark.sql import functions as F

from pairsieve.operators import graph, ordered, quota
from pairsieve.session import scratch_path
from pairsieve.streaming import buffered


@pytest.mark.parametrize("share,wanted", [(100, 40), (1, 900)])
def test_quota_at_low_and_high_yield(spark, share, wanted):
    path = scratch_path(spark, "test-quota")
    calls = []

    def generate(ids):
        calls.append(1)
        return ids.withColumn("v", F.col("candidate_id") * 7 % 1009)

    keep = (lambda d: d.where("v % 100 = 0")) if share == 100 else (lambda d: d.where("v % 10 <> 0"))
    ok = (lambda i: i * 7 % 1009 % 100 == 0) if share == 100 else (lambda i: i * 7 % 1009 % 10 != 0)
    got = sorted(r.candidate_id for r in quota.fill_quota(spark, generate, keep, wanted, path).collect())
    assert got == [i for i in range(1_000_000) if ok(i)][:wanted]
    rounds = len(calls)
    more = sorted(r.candidate_id for r in quota.fill_quota(spark, generate, keep, wanted, path).collect())
    assert more == got and len(calls) == rounds  # a restart finds its batches
    larger = quota.fill_quota(spark, generate, keep, wanted * 30, path)
    ids = [r.candidate_id for r in larger.collect()]
    assert sorted(ids) == [i for i in range(1_000_000) if ok(i)][: wanted * 30] and len(set(ids)) == len(ids)


def test_files_of_a_stated_number_of_rows(spark):
    df = spark.range(0, 1000).select(F.md5(F.col("id").cast("string")).alias("k"), "id")
    sink = buffered.BufferedAppend(scratch_path(spark, "test-buffer"), df.schema, "k", 64)
    batches = [df.where(f"id >= {a} AND id < {b}") for a, b in [(0, 30), (30, 500), (500, 500), (500, 1000)]]
    for epoch, batch in enumerate(batches):
        sink.write(batch, epoch)
        if epoch == 1:
            sink.write(batch, epoch)  # an epoch that is repeated changes nothing
    got = sink.close(spark, len(batches) - 1).collect()
    assert sorted(r.id for r in got) == list(range(1000))
    per = {}
    for r in got:
        per[r.file] = per.get(r.file, 0) + 1
    assert sorted(per.values()) == [1000 % 64] + [64] * (1000 // 64)
    assert [(r.n_rows, r.n_files, r.left_over) for r in sink.log(spark).orderBy("epoch").collect()] == [(30, 0, 30), (500, 7, 52), (52, 0, 52), (552, 8, 40)]


def test_buckets_of_skewed_numbers(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(20_000)] + [1e9, -1e300, float("inf")] + [10.0**-k for k in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    cut = ordered.equi_depth(df, "v", width=1000)(df)
    sizes = {r["_b"]: r["count"] for r in cut.where("v IS NOT NULL").groupBy("_b").count().collect()}
    assert max(sizes.values()) <= 2 * len(values) / len(sizes)
    bounds = cut.where("v IS NOT NULL").groupBy("_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_b").collect()
    assert all(a.hi <= b.lo for a, b in zip(bounds, bounds[1:], strict=False))


def test_positions_in_nested_subsets(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), n, rng.randrange(2), rng.choice([True, False, None])) for n in range(500)]
    df = spark.createDataFrame(rows, "k int, n bigint, a int, b boolean")
    got = ordered.positions_in(df, ["k"], "n", {"p": F.lit(True), "q": F.col("a") == 1, "r": F.col("b")}, bucket=ordered.bucket_of("n", 17)).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.n):
        for name, flag in (("p", True), ("q", r.a == 1), ("r", r.b)):
            at = seen.get((r.k, name), 0)
            assert r[name] == (at if flag else None)
            seen[r.k, name] = at + bool(flag)
    assert len(got) == 500


def test_two_hop_sizes_of_wide_classes(spark):
    rng = random.Random(5)
    edges = {(c, v) for v in range(300) for c in rng.sample(range(30), rng.choice([1, 3, 12, 15]))} | {(99, v) for v in range(0, 300, 2)}
    df = spark.createDataFrame(sorted(edges), "check_id bigint, var_id bigint")
    members, checks = {}, {}
    for c, v in edges:
        members.setdefault(c, set()).add(v)
        checks.setdefault(v, set()).add(c)
    want = {v: len(set().union(*(members[c] for c in cs))) for v, cs in checks.items()}
    assert {r.var_id: r.n2_size for r in graph.two_hop_sizes(df, 10).collect()} == want
