"""Mends of what grew too fast: the whole job, the same results, fewer passes or smaller tasks."""

import numpy as np
import pytest

from pairsieve.operators import acquire

NAMES = ("f0", "f1", "f2")


def greedy(keys, x, score, k, weight=0.1):
    picks, near = [], None
    for _ in range(k):
        value = np.floor((score if near is None else score + weight * near) * 1e9 + 0.5) / 1e9
        best = min((i for i in range(len(keys)) if keys[i] not in {p[0] for p in picks}), key=lambda i: (-value[i], keys[i]))
        picks.append((keys[best], value[best]))
        gap = np.sqrt(((x - x[best]) ** 2).sum(axis=1))
        near = gap if near is None else np.minimum(near, gap)
    return picks


@pytest.mark.parametrize("head, part_head", [(16_384, 1_024), (40, 16), (1, 1)])
def test_batch_in_few_passes(spark, monkeypatch, head, part_head):
    rng = np.random.default_rng(3)
    n, k = 2_000, 24
    x, score = rng.uniform(0, 4, (n, 3)), rng.integers(1, 5, n) * 0.01
    x[1_000:1_400] = x[:400]  # equal rows of equal score: the key decides
    score[1_000:1_400] = score[:400]
    keys = [f"k{i:05d}" for i in rng.permutation(n)]
    df = spark.createDataFrame([(a, float(s), *map(float, row)) for a, s, row in zip(keys, score, x)], "key string, score double, f0 double, f1 double, f2 double").repartition(7)
    df = df.unionByName(spark.createDataFrame([("zz", None, 9.0, 9.0, 9.0), ("zy", 1.0, None, 9.0, 9.0)], df.schema).where("score IS NULL"))
    monkeypatch.setattr(acquire, "HEAD", head)
    monkeypatch.setattr(acquire, "PART_HEAD", part_head)
    passes, plain = [], acquire._heads
    monkeypatch.setattr(acquire, "_heads", lambda *a: passes.append(1) or plain(*a))
    got = acquire.diverse_batch(df, k, "score", "key", NAMES).orderBy("pick").collect()
    assert [(r.key, r.pick_score) for r in got] == [(a, pytest.approx(v, abs=2e-9)) for a, v in greedy(keys, x, score, k)]
    assert len(passes) < k or head == 1


def test_repeated_side_is_not_broadcast_by_its_file_size(spark, tmp_path):
    from pyspark.sql import functions as F

    from pairsieve.operators import skew

    # numbers in order take few bytes in a file
    spark.range(400_000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("bit")).coalesce(1).write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    assert keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 << 20
    rows = spark.range(1_000).select((F.col("id") * 7).alias("k"), F.col("id").alias("row"))
    got = skew.attach(rows, keys, ["k"], ["row"])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("s")).first() == (1_000, 500)
    few = skew.attach(rows, keys.limit(5), ["k"], ["row"])
    assert few.count() == 1


def test_epochs_of_many_files(spark):
    from pyspark.sql import functions as F

    from pairsieve.session import scratch_path
    from pairsieve.streaming import base

    # epoch 1 has fewer rows than the others have files, epoch 3 none
    df = spark.range(1_002).select("id", F.when(F.col("id") >= 1_000, 1).otherwise(2 * F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("part"))
    path = scratch_path(spark, "epochs")
    stream = base.file_epochs(df, "part", 4, path, file_rows=50)
    sizes = [r.n for r in spark.read.schema("id bigint").parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 100 and len(sizes) > 16
    seen = {}

    def note(batch, epoch):
        seen[epoch] = {r.id for r in batch.collect()}

    stream.writeStream.option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).foreachBatch(note).start().awaitTermination()
    want = [{r.id for r in df.where(F.col("part") == k).collect()} for k in range(4)]
    assert [seen.get(k, set()) for k in range(4)] == want


def test_frame_slot_is_a_formula(spark):
    import __spark_entry__ as entry

    got = entry.queries()["h48_frame_place"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "sequence" not in plan  # the frame isn't listed for every row
    assert got.where("slot % 5 = 2 OR slot >= 5120").count() == 0


def test_checks_are_computed_once(spark):
    import __spark_entry__ as entry

    for name in ("h29_feasibility_checks", "d23_preflight_report"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # two each in the entropies of the error rate and of the storage, one in the collision rate
        assert plan.count("LOG2(") == 5, name


def test_entropy_is_not_in_the_loop(spark):
    from pyspark.sql import functions as F

    from pairsieve.functions import finite

    c = F.col
    df = spark.range(1).select((c("id") + 100_000).alias("n"), (c("id") + 0.02).alias("q"), (c("id") + 0.9).alias("noise"), (c("id") + 0.1).alias("nu"))
    df = df.repartition(1)  # keeps the columns as names
    for loop in (finite.optimal_test_fraction(c("n"), c("q"), c("noise"), c("nu")), finite.min_n_for_length(1000, c("q"), c("noise"), c("nu"))):
        plan = df.select(loop.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        top = plan.splitlines()[0]
        assert "noise" not in top[top.index("aggregate("):]


def brute_two_hops(edges):
    by_check, by_var = {}, {}
    for a, v in edges:
        by_check.setdefault(a, set()).add(v)
        by_var.setdefault(v, set()).add(a)
    return {v: set().union(*(by_check[a] for a in cs)) for v, cs in by_var.items()}


@pytest.mark.parametrize("heavy", [3, 9, 128])
def test_two_hops_from_pairs_of_checks(spark, monkeypatch, heavy):
    import random

    from pairsieve.operators import graph

    rng = random.Random(heavy)
    # few checks a variable, many variables a check; some variables share two, three and four checks
    edges = {(rng.randint(0, 30), v) for v in range(150) for _ in range(rng.randint(1, 3))}
    edges |= {(a, v) for v in (200, 201, 202) for a in (31, 32, 33)} | {(a, v) for v in (203, 204) for a in (34, 35, 36, 37)} | {(38, 205)}
    df = spark.createDataFrame(sorted(edges), "check_id bigint, var_id bigint")
    paired, plain = [], graph._fresh_pairs
    monkeypatch.setattr(graph, "_fresh_pairs", lambda light, others, classes, rows: paired.append(light) or plain(light, others, classes, rows))
    near = brute_two_hops(edges)
    assert {r.var_id: r.n2_size for r in graph.two_hop_sizes(df, heavy).collect()} == {v: len(x) for v, x in near.items()}
    in_large = {v for a, v in edges if sum(x == a for x, _ in edges) > heavy}
    if heavy > 3:  # members of light checks are paired for those only that lie in a large check as well
        assert all({r.var_id for r in light.select("var_id").distinct().collect()} <= in_large for light in paired)
        assert bool(paired) == bool(in_large)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from pairsieve.operators import graph

    monkeypatch.setattr(graph, "PART_ROWS", 100)
    # two checks of 40 variables: 3,200 pairs
    df = spark.createDataFrame([(a, v) for a in (1, 2) for v in range(40)], "check_id bigint, var_id bigint")
    seen, plain = [], graph._dealt
    monkeypatch.setattr(graph, "_dealt", lambda pairs, rows, *keys: seen.append(plain(pairs, rows, *keys)) or seen[-1])
    assert {r.n2_size for r in graph.two_hop_sizes(df).collect()} == {40}
    assert {r.n2_size for r in graph.two_hop_sizes(df.select(df.check_id.alias("var_id"), df.var_id.alias("check_id"))).collect()} == {2}
    for pairs in seen:
        # pairs of variables, and of checks in the other graph
        assert pairs.rdd.getNumPartitions() >= pairs.count() // 100


def test_greedy_choice_in_rounds(spark):
    import random

    from pairsieve.operators import graph

    rng = random.Random(5)
    edges = {(rng.randint(0, 60), v) for v in range(200) for _ in range(rng.randint(1, 3))}
    df = spark.createDataFrame(sorted(edges) + sorted(edges)[:20], "check_id bigint, var_id bigint")  # a repeated edge counts once
    near = brute_two_hops(edges)
    ranks = {v: rng.randint(0, 4) for v in near}
    left, want = set(near), []
    while left:
        want.append(min(left, key=lambda v: (ranks[v], v)))
        left -= near[want[-1]]
    table = spark.createDataFrame(list(ranks.items()), "var_id bigint, score bigint")
    for target in (0, 1, 7, 1_000):
        got = graph.untainted_selection(df, table, "score", target).collect()
        assert sorted((r.rank, r.var_id) for r in got) == [(ranks[v], v) for v in want[:target]]


def test_known_keys_are_kept_on_disk(spark):
    from pyspark.sql import functions as F

    from pairsieve.session import scratch_path, written
    from pairsieve.sources import store
    from pairsieve.streaming import base, jobs

    rows = store.conform(spark.range(90).selectExpr("id AS sample_id", *[f"cast(null AS {f.dataType.simpleString()}) AS {f.name}" for f in store.RESULT_SCHEMA if f.name not in ("sample_key", "phase")], "if(id % 2 = 0, 'a', 'b') AS phase"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200)))
    # each row in two of three epochs, some twice in one
    cut = rows.withColumn("part", F.pmod(F.xxhash64("sample_key"), F.lit(3))).unionByName(rows.withColumn("part", F.lit(2).cast("long")))
    cut = written(cut, "cut", by="part")
    assert "PartitionFilters: [isnotnull(part" in cut.where("part = 1")._jdf.queryExecution().executedPlan().toString()
    path, before = store.new_store(spark, "test"), spark.conf.get(base.STATE_STORE)
    jobs.ingest_results(base.file_epochs(cut, "part", 3, scratch_path(spark, "test-arrivals")), path)
    assert spark.conf.get(base.STATE_STORE) == before
    got = [r.sample_key for r in store.read_results(spark, path).collect()]
    assert len(got) == 90 and set(got) == {r.sample_key for r in rows.collect()}
    assert all("RocksDB" in r.value for r in spark.read.text(path + "-state/offsets").where("value LIKE '%providerClass%'").collect())
    kept = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path + "-state/state").select("path").collect()
    assert any(r.path.endswith(".zip") for r in kept) and not any(r.path.endswith(".delta") for r in kept)


def test_a_task_writes_many_files(spark, monkeypatch):
    import re

    from pyspark.sql import functions as F

    from pairsieve.session import scratch_path
    from pairsieve.streaming import buffered

    monkeypatch.setattr(buffered, "PART_ROWS", 75, raising=False)  # seven files of ten rows
    df = spark.range(1_003).select(F.md5(F.col("id").cast("string")).alias("k"), "id")
    sink = buffered.BufferedAppend(scratch_path(spark, "test-parts"), df.schema, "k", 10)
    sink.write(df, 0)
    got = sink.close(spark, 0).collect()
    assert sorted(r.id for r in got) == list(range(1_003))
    files = {}
    for r in got:
        files.setdefault(r.file, []).append(r.k)
    assert sorted(len(x) for x in files.values()) == [3] + [10] * 100
    order = sorted(r.k for r in got)
    assert all(order.index(min(x)) % 10 == 0 and order.index(max(x)) - order.index(min(x)) == len(x) - 1 for x in files.values())
    tasks = {re.search(r"/part-(\d+)-", f).group(1) for f in files if "epoch=0" in f}
    assert len(tasks) == 15  # not one for each file
