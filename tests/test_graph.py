import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsieve.operators import decode, extract, graph


@pytest.fixture(scope="module")
def hot_graph(spark):
    """One check holds a third of the edges."""
    rng = random.Random(11)
    edges = {(0, v) for v in range(60)} | {(rng.randint(1, 40), rng.randint(0, 89)) for _ in range(120)}
    return edges, spark.createDataFrame(sorted(edges), "check_id bigint, var_id bigint")


def members(edges):
    by_check, by_var = {}, {}
    for c, v in edges:
        by_check.setdefault(c, set()).add(v)
        by_var.setdefault(v, set()).add(c)
    return by_check, by_var


@pytest.mark.parametrize("heavy", [1, 3, 128])
def test_two_hop_sizes(hot_graph, heavy):
    edges, df = hot_graph
    by_check, by_var = members(edges)
    want = {v: len(set().union(*(by_check[c] for c in cs))) for v, cs in by_var.items()}
    assert {r.var_id: r.n2_size for r in graph.two_hop_sizes(df, heavy).collect()} == want


def test_untainted_selection_is_greedy(hot_graph):
    edges, df = hot_graph
    by_check, by_var = members(edges)
    near = {v: set().union(*(by_check[c] for c in cs)) for v, cs in by_var.items()}
    left, want = set(by_var), []
    while left:
        best = min(left, key=lambda v: (len(near[v]), v))
        want.append(best)
        left -= near[best]
    got = graph.untainted_selection(df, graph.two_hop_sizes(df), "n2_size", 1000).collect()
    assert sorted(r.var_id for r in got) == sorted(want)
    first = graph.untainted_selection(df, graph.two_hop_sizes(df), "n2_size", 3).collect()
    assert sorted(r.var_id for r in first) == sorted(want[:3])


def test_four_cycles(hot_graph):
    edges, df = hot_graph
    by_check, _ = members(edges)
    want = sum(k * (k - 1) // 2 for a, b in itertools.combinations(by_check, 2) for k in [len(by_check[a] & by_check[b])])
    assert graph.four_cycles(df).first()["n_cycles"] == want


def test_scores(spark, hot_graph):
    edges, df = hot_graph
    by_check, by_var = members(edges)
    punctured = {v for v in by_var if v % 7 == 0}
    flags = spark.createDataFrame([(v, v in punctured) for v in by_var], "var_id bigint, punctured boolean")
    ext = {r.var_id: r.score for r in graph.extrinsic_score(df, flags).collect()}
    exc = {r.var_id: r.score for r in graph.excess_degree(df).collect()}
    dead = {r.var_id: r.n_dead for r in graph.dead_checks(df, flags).collect()}
    for v, cs in by_var.items():
        shares = [len(by_check[c] - {v} - punctured) / len(by_check[c] - {v}) for c in cs if len(by_check[c]) > 1]
        assert ext[v] == pytest.approx(min(shares) if shares else 0.0)
        assert exc[v] == sum(max(0, len(by_var[w]) - 2) for c in cs for w in by_check[c] if w != v)
        assert dead[v] == (0 if v in punctured else sum(len(by_check[c] - punctured - {v}) == 0 for c in cs))


def code(spark):
    rng = random.Random(2)
    edges = sorted({(c, v) for v in range(60) for c in rng.sample(range(30), 3)})
    return edges, spark.createDataFrame(edges, "check_id bigint, var_id bigint")


def test_message_passing_corrects(spark):
    edges, df = code(spark)
    rng = random.Random(4)
    frames = {f: [rng.randint(0, 1) for _ in range(60)] for f in range(3)}
    flips = {0: {5}, 1: {17, 40}, 2: set()}
    llr = [(f, v, (1 - 2 * (b ^ (v in flips[f]))) * 3.0) for f, bits in frames.items() for v, b in enumerate(bits)]
    target = [(f, c, sum(bits[v] for cc, v in edges if cc == c) % 2) for f, bits in frames.items() for c in {c for c, _ in edges}]
    got = decode.decode(df, spark.createDataFrame(llr, "frame_id int, var_id bigint, llr double"), spark.createDataFrame(target, "frame_id int, check_id bigint, target int"), 8).collect()
    for f, bits in frames.items():
        mine = {r.var_id: r for r in got if r.frame_id == f}
        assert all(r.converged for r in mine.values())
        assert [mine[v].bit for v in range(60)] == bits


@pytest.mark.parametrize("limit", [3, 6, 16])
def test_toeplitz_both_ways(spark, limit):
    rng = np.random.default_rng(9)
    sizes = {1: (40, 20), 2: (200, 90), 3: (1, 1)}
    seeds = {k: rng.integers(0, 2, 400) for k in sizes}
    table = spark.createDataFrame([(i, int(b)) for i, b in enumerate(seeds[1])], "i int, b int")
    arr = [int(r.b) for r in table.orderBy("i").collect()]
    rows, want = [], {}
    for key, (n, m) in sizes.items():
        x = rng.integers(0, 2, n)
        rows += [(key, p, int(b), n, m) for p, b in enumerate(x)]
        want[key] = [sum(arr[i + j] * int(x[j]) for j in range(n)) % 2 for i in range(m)]
    df = spark.createDataFrame(rows, "key int, pos bigint, bit int, n bigint, m bigint")
    seed = lambda idx: F.element_at(F.array(*[F.lit(v) for v in arr]), (idx + 1).cast("int"))
    got = extract.toeplitz(extract.seeded_rows(df, ["key"], seed), ["key"], limit_log2=limit).collect()
    for key in sizes:
        assert [r.bit for r in sorted((r for r in got if r.key == key), key=lambda r: r.i)] == want[key]


def test_retries_only_touch_failed_frames(spark):
    edges, df = code(spark)
    bits = [v % 2 for v in range(60)]
    flips = {0: set(), 1: {3, 30, 50}}
    llr = [(f, v, (1 - 2 * (b ^ (v in flips[f]))) * 3.0) for f in flips for v, b in enumerate(bits)]
    target = [(f, c, sum(bits[v] for cc, v in edges if cc == c) % 2) for f in flips for c in {c for c, _ in edges}]
    llr = spark.createDataFrame(llr, "frame_id int, var_id bigint, llr double")
    target = spark.createDataFrame(target, "frame_id int, check_id bigint, target int")
    first = {r.frame_id: r.n_failing for r in decode.decode(df, llr, target, 1).collect()}
    got = decode.decode_with_retries(df, llr, target, 1, retries=2, iteration_scale=4.0).collect()
    assert len(got) == 120
    assert {r.attempt for r in got if r.frame_id == 0} == {0}
    assert all(r.n_failing <= first[r.frame_id] for r in got)
    for r in got:
        assert not r.converged or r.bit == bits[r.var_id]
