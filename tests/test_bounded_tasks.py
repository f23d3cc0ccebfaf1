"""What a task sorts and groups is bounded by the number of rows, not by the session's shuffle partitions."""

from pyspark.sql import functions as F

from pairsieve.operators import graph, skew


def widest(df):
    """The most rows that a task of the last step put out."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_parity_steps_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "PART_ROWS", 500)
    edges = spark.range(6_000).select((F.col("id") / 2).cast("long").alias("check_id"), (F.col("id") % 700).alias("var_id"))
    hot = spark.range(2_000).select(F.lit(-1).cast("long").alias("check_id"), F.col("id").alias("var_id"))
    edges = edges.unionByName(hot).localCheckpoint()
    bits = spark.range(2_000).select(F.col("id").alias("var_id"), (F.col("id") % 3 % 2).alias("bit"), (F.col("id") % 5 == 0).alias("punctured"))
    got = graph.syndrome(edges, bits)
    assert widest(got) < 600
    assert widest(graph.with_bits(edges, bits, edges.count())) < 1_500
    pairs = [(r.check_id, r.var_id) for r in edges.collect()]
    want = {}
    for check, var in pairs:
        want[check] = want.get(check, 0) ^ (var % 3 % 2)
    assert {r.check_id: r.parity for r in got.collect()} == want
    counts = {}
    for check, var in pairs:
        n, p = counts.get(check, (0, 0))
        counts[check] = (n + 1, p + (var % 5 == 0))
    rows = graph.check_counts(edges, bits)
    assert widest(rows) < 1_500
    assert {(r.check_id, r.var_id): (r.degree, r.n_punctured) for r in rows.collect()} == {k: counts[k[0]] for k in pairs}
