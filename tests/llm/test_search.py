import numpy as np
from pyspark.sql import functions as F

from pairsieve.llm import mih

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = {}
    for q in range(len(ids)):
        s = x @ x[q]
        order = sorted((-round(float(v), 12), int(i)) for i, v in zip(ids, s, strict=True) if i != ids[q])
        out[int(ids[q])] = order[:k]
    return out


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist(), 0, 0.0) for i in range(600)]
    rows += [(600 + i, rows[0][1], 0, 0.0) for i in range(40)]  # one vector very often
    odd = [(700, None, 0, 0.0), (701, [0.0] * 16, 0, 0.0), (702, [1.0, None] + [0.0] * 14, 0, 0.0), (703, [float("nan")] + [1.0] * 15, 0, 0.0),
           (704, [float("inf")] * 16, 0, 0.0), (705, [1.0], 0, 0.0), (706, [], 0, 0.0), (None, [1.0] * 16, 0, 0.0), rows[5]]
    want = brute(rows, 20)
    got = mih.nearest(spark.createDataFrame(rows + odd, SCHEMA), F.col("id") % 20 == 0).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {i for i, *_ in rows if i % 20 == 0}
    hits = 0
    for q, found in by_query.items():
        found.sort(key=lambda r: r.rank)
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 20 * len(by_query)
    # copies of the query tie, and the smallest ids come first
    assert [r.vec_id for r in by_query[0]] == [i for _, i in want[0]]


def test_fewer_rows_than_asked(spark):
    rows = [(i, [1.0, float(i)], 0, 0.0) for i in range(5)]
    got = mih.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4]
    assert mih.nearest(spark.createDataFrame([], SCHEMA), F.col("id") == 0).count() == 0


def test_pigeonhole():
    rng = np.random.default_rng(1)
    for radius in (0, 3, 9, 22, 64):
        radii = mih.part_radii(radius)
        for _ in range(200):
            flips = rng.choice(64, radius, replace=False)
            per_part = np.bincount(flips // mih.PART_BITS, minlength=mih.PARTS)
            assert any(r >= 0 and n <= r for n, r in zip(per_part, radii, strict=True))
