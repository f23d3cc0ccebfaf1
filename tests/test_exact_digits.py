"""Results that the last bit of a logarithm decides."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from pairsieve.functions import clib

# line items whose margin or key rate lies next to a rounding boundary
NEAR = [
    (550090, 73000, 3489, 1, 49.0, 41023.67, 0.08, 0.08, "R", "O"), (453555, 75816, 3308, 1, 47.0, 72215.58, 0.07, 0.05, "R", "F"),
    (74970, 18124, 942, 7, 29.0, 11134.3, 0.09, 0.02, "A", "F"), (120099, 19317, 268, 2, 37.0, 34628.06, 0.06, 0.04, "A", "F"),
    (739064, 89202, 4014, 2, 50.0, 82551.84, 0.08, 0.06, "N", "O"), (83978, 8163, 776, 5, 20.0, 45535.52, 0.06, 0.08, "R", "F"),
    (705272, 95117, 4744, 6, 18.0, 79904.65, 0.05, 0.07, "R", "O"), (486728, 60690, 3690, 3, 37.0, 41528.61, 0.02, 0.07, "R", "F"),
    (400545, 56946, 2945, 4, 25.0, 71806.06, 0.08, 0.03, "R", "O"), (57396, 17907, 945, 1, 33.0, 57445.87, 0.06, 0.04, "N", "F"),
    (292229, 20506, 1501, 1, 22.0, 37197.05, 0.08, 0.03, "R", "F"), (541082, 73106, 3290, 4, 48.0, 81940.01, 0.08, 0.08, "N", "F"),
    (799761, 114677, 5178, 5, 20.0, 12010.45, 0.05, 0.07, "R", "F"),
]
SCHEMA = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


@pytest.mark.parametrize("name", ["d23_preflight_report", "h29_feasibility_checks"])
def test_margins_at_a_rounding_boundary(spark, tmp_path, name):
    import __spark_entry__ as entry

    spark.createDataFrame(NEAR, SCHEMA).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_last_bits_are_those_of_the_c_library(spark):
    numbers = [None, -1.0, 0.0, math.inf, *[0.001 + 0.0007 * i for i in range(3_000)]]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").repartition(3)
    rows = df.select("x", clib.log2(F.col("x")).alias("log"), clib.power(F.lit(10.0), F.col("x")).alias("pow")).collect()
    assert len(rows) == len(numbers)
    for r in rows:
        assert r.log == (None if r.x is None or r.x <= 0 else math.log2(r.x))
        assert r.pow == (None if r.x is None else math.inf if r.x == math.inf else math.pow(10.0, r.x))
    edges = spark.createDataFrame([(0.0, -1.0), (-8.0, 0.5), (10.0, 400.0)], "b double, e double").select(clib.power(F.col("b"), F.col("e")).alias("p"))
    assert [str(r.p) for r in edges.collect()] == ["inf", "nan", "inf"]
