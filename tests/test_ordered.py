import random

import pytest
from pyspark.sql import functions as F

from pairsieve.operators.ordered import bucket_of, mark_smallest, positions, prefix_of, previous, running


@pytest.fixture(scope="module")
def table(spark):
    """One session holds most of the rows; ids have gaps."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.8 else rng.randint(1, 5), i * 3 + rng.randint(0, 2), rng.randint(-5, 5)) for i in range(2000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k int, o bigint, v int").repartition(7)


def expected(rows):
    by = {}
    for k, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(k, []).append((o, v))
    return by


@pytest.mark.parametrize("width", [16, 1000, 1 << 16])
@pytest.mark.parametrize("partitions", ["1", "9"])
def test_ordered_operators(spark, table, width, partitions):
    rows, df = table
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        b = bucket_of("o", width)
        got_pos = {(r.k, r.o): r.pos for r in positions(df, ["k"], "o", bucket=b).collect()}
        got_run = {(r.k, r.o): (r.s, r.m) for r in running(df, ["k"], "o", {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))}, bucket=b).collect()}
        got_prev = {(r.k, r.o): r.p for r in previous(df, ["k"], "o", {"p": F.col("v")}, bucket=b).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k, seq in expected(rows).items():
        total, low, last = 0, None, None
        for i, (o, v) in enumerate(seq):
            total, low = total + v, v if low is None else min(low, v)
            assert got_pos[k, o] == i + 1
            assert got_run[k, o] == (total, low)
            assert got_prev[k, o] == last
            last = v


def test_exclusive_running(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(10)], "k int, o bigint, v int")
    got = {r.o: r.s for r in running(df, ["k"], "o", {"s": ("sum", F.col("v"))}, bucket=bucket_of("o", 3), inclusive=False).collect()}
    assert got == {i: sum(range(i)) for i in range(10)}


def test_exact_subset(spark, table):
    rows, df = table
    marked = df.withColumn("d", F.md5(F.col("o").cast("string")))
    for digits in (1, 4):
        got = mark_smallest(marked, ["k"], "d", lambda n: F.floor(n / 3), "hit", digits).collect()
        for k, seq in expected(rows).items():
            mine = [r for r in got if r.k == k]
            assert len(mine) == len(seq)
            want = sorted(r.d for r in mine)[: len(seq) // 3]
            assert sorted(r.d for r in mine if r.hit) == want


def test_prefix_buckets_keep_the_order(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("d"))
    got = positions(df, [], "d", bucket=prefix_of("d", 1)).orderBy("d").collect()
    assert [r.pos for r in got] == list(range(1, 501))
