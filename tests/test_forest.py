import random

import numpy as np
import pytest

from pairsieve.operators import forest

NAMES = ["a", "b", "d", "e"]


def table(spark, n=700, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rng.random(), rng.choice([0.0, 0.5, 1.0]), rng.gauss(0, 1), rng.random()]
        rows.append((*x, float(x[0] + 0.4 * x[1] + 0.2 * x[2] + 0.2 * rng.random() > 0.9)))
    return rows, spark.createDataFrame(rows, "a double, b double, d double, e double, y double").coalesce(1)


def plain_tree(model, bins, y, times, weights, depth):
    """Share of class 0 for every row, one node after another."""
    out = np.zeros(len(y))

    def gini(rows):
        w = [weights[k] * sum(times[i] for i in rows if y[i] == k) for k in (0, 1)]
        n = sum(w)
        return n, (1 - sum((x / n) ** 2 for x in w)) if n else 0.0, w

    def grow(rows, level, place, inherited):
        n, impurity, w = gini(rows)
        share = w[0] / n if n else inherited
        best = (1e-12, None, None)
        if level < depth and impurity > 0:
            for f in forest.candidates(model.seed, level, 1, len(NAMES), 2)[0, place]:
                for cut in range(forest.BINS):
                    left, right = [i for i in rows if bins[f, i] <= cut], [i for i in rows if bins[f, i] > cut]
                    if sum(times[left]) < 1 or sum(times[right]) < 1:
                        continue
                    (nl, gl, _), (nr, gr, _) = gini(left), gini(right)
                    gain = impurity - (nl * gl + nr * gr) / n
                    if gain > best[0] + 1e-12:
                        best = (gain, f, cut)
        if best[1] is None:
            out[rows] = share
            return
        rows = np.array(rows)
        low = bins[best[1], rows] <= best[2]
        grow(list(rows[low]), level + 1, 2 * place, share)
        grow(list(rows[~low]), level + 1, 2 * place + 1, share)

    grow(list(range(len(y))), 0, 0, 0.5)
    return out


def test_one_tree_like_brute_force(spark):
    rows, df = table(spark)
    weights = (0.7, 1.9)
    model = forest.fit(df, NAMES, "y", weights, trees=1, depth=3, seed=42)
    values = np.array(rows)
    bins, y = model.binned([values[:, k] for k in range(4)]), values[:, 4].astype(int)
    times = forest.POISSON[np.random.default_rng([42, 0]).integers(0, 1 << 16, (1, len(y)), dtype=np.uint16)[0]].astype(int)
    got = np.array([r.p for r in df.select(model.p_fail().alias("p")).collect()])
    assert len(set(got)) > 4
    np.testing.assert_allclose(got, plain_tree(model, bins, y, times, weights, 3), atol=1e-12)


def test_all_rows_are_drawn_from_in_every_tree(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 64)
    rows, df = table(spark)
    model = forest.Forest(NAMES, [np.array([0.5])] * 4, 7, [], [], np.full((5, 1), 0.5), np.ones((5, 1), dtype=bool))
    blocks = forest._blocks(model, df.repartition(3), "y").collect()
    assert sum(len(b.classes) for b in blocks) == len(rows) and len({b.block for b in blocks}) == len(blocks)
    assert sum(sum(b.classes) for b in blocks) == sum(int(r[-1]) for r in rows)
    counts = np.bincount(forest.POISSON) / (1 << 16)
    assert abs(counts[:4] - [np.exp(-1) / d for d in (1, 1, 2, 6)]).max() < 1e-4


def test_forest_tells_classes_apart(spark):
    _, df = table(spark, 1500)
    model = forest.fit(df, NAMES, "y", (1.0, 1.0), trees=20, depth=8, seed=1)
    right = df.select(((model.p_fail() < 0.5) == (df.y == 1)).alias("right"), model.p_fail().alias("p")).collect()
    assert sum(r.right for r in right) > 0.93 * len(right) and all(0 <= r.p <= 1 for r in right)


def test_missing_features_are_refused(spark):
    df = spark.createDataFrame([(1.0, None, 0.0, 0.0, 1.0)] * 3, "a double, b double, d double, e double, y double")
    with pytest.raises(Exception, match="null or NaN"):
        forest.fit(df, NAMES, "y", (1.0, 1.0), trees=1, depth=1, seed=1)
