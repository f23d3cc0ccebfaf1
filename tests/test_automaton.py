import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsieve.operators import automaton


def test_prefix_composition():
    rng = np.random.default_rng(1)
    tables, new = rng.integers(0, 3, (200, 3)), rng.random(200) < 0.1
    new[0] = True
    got, now = automaton.prefix_composed(tables, new), None
    for k in range(200):
        now = tables[k] if new[k] else tables[k][now]
        assert (got[k] == now).all()


@pytest.mark.parametrize("width,batch", [(7, 5), (1000, 10_000)])
def test_states_like_one_walk(spark, width, batch):
    rng = random.Random(width)
    rows = [(rng.choice([1, 2, None]), n, *[rng.randrange(3) for _ in range(3)]) for n in range(400)]
    rows += [(9, n, 1, 2, 0) for n in range(300)] + [(8, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "k bigint, n bigint, a int, b int, c int").repartition(4)
    start = spark.createDataFrame([(2, 1), (9, 2), (77, 2)], "k bigint, state int")
    want, ends, state = {}, {}, {2: 1, 9: 2}
    for k, n, *table in sorted(rows, key=lambda r: r[1]):
        want[k, n] = state.get(k, 0)
        state[k] = table[state.get(k, 0)]
        ends[k] = state[k]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out, last = automaton.states_along(df, ["k"], "n", F.array("a", "b", "c"), start, bucket=automaton.bucket_of("n", width))
        assert {(r.k, r.n): r.state for r in out.collect()} == want
        assert {r.k: r.state for r in last.collect()} == ends
        out, last = automaton.states_along(df.where("false"), ["k"], "n", F.array("a", "b", "c"))
        assert out.count() == 0 and last.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
