import math
import random

import numpy as np
import pytest

from pairsieve.operators import decode


def plain(edges, llr, target, limit):
    """The same algorithm one frame and one message at a time."""
    checks, variables = sorted({c for c, _ in edges}), sorted({v for _, v in edges})
    llr = {v: max(-30.0, min(30.0, llr.get(v, 0.0))) for v in variables}
    q = {(c, v): llr[v] for c, v in edges}
    of_check = {c: [v for cc, v in edges if cc == c] for c in checks}
    of_var = {v: [c for c, vv in edges if vv == v] for v in variables}
    for iteration in range(1, limit + 1):
        r = {}
        for c in checks:
            for v in of_check[c]:
                if c not in target:
                    r[c, v] = 0.0
                    continue
                product = 1.0
                for w in of_check[c]:
                    if w != v:
                        product *= math.tanh(q[c, w] / 2)
                product = max(-decode.CLIP, min(decode.CLIP, product)) * (-1 if target[c] else 1)
                r[c, v] = math.log((1 + product) / (1 - product))
        total = {v: llr[v] + sum(r[c, v] for c in of_var[v]) for v in variables}
        bit = {v: int(total[v] < 0) for v in variables}
        failing = sum(sum(bit[v] for v in of_check[c]) % 2 != target[c] for c in checks if c in target)
        if failing == 0:
            break
        q = {(c, v): total[v] - r[c, v] for c, v in edges}
    return [bit[v] for v in variables], iteration, failing


def random_code(seed, n=40, m=20):
    rng = random.Random(seed)
    return sorted({(c, v) for v in range(n) for c in rng.sample(range(m), 3)})


@pytest.mark.parametrize("seed", range(4))
def test_sum_product_like_the_plain_form(seed):
    rng = random.Random(seed)
    edges = random_code(seed)
    code = decode.Code.of(np.array(edges + edges[:5]))
    rows, goals, want = [], [], []
    for _ in range(12):
        bits = [rng.randint(0, 1) for _ in range(40)]
        llr = {v: rng.choice([2.5, 0.0, 100.0] if rng.random() < 0.2 else [2.5]) * (1 - 2 * (b ^ (rng.random() < 0.06))) for v, b in enumerate(bits)}
        target = {c: sum(bits[v] for cc, v in edges if cc == c) % 2 for c in range(20) if rng.random() < 0.9}
        want.append(plain(edges, llr, target, 20))
        rows.append([llr[v] for v in range(40)])
        goals.append([target.get(c, -1) for c in code.checks])
    goals = np.array(goals)
    bound = goals >= 0
    got, used, failing = decode.sum_product(code, np.array(rows), np.where(bound, goals, 0).astype(np.int8), bound, 20)
    for k, (bits, iteration, wrong) in enumerate(want):
        assert used[k] == iteration and failing[k] == wrong
        assert got[k].tolist() == bits


def test_ladder_keeps_the_best():
    rng = np.random.default_rng(5)
    edges = np.array(random_code(7))
    code = decode.Code.of(edges)
    truth = rng.integers(0, 2, (60, 40))
    llr = (1 - 2 * (truth ^ (rng.random(truth.shape) < 0.14))) * 2.0
    target = np.bitwise_xor.reduceat(truth[:, code.var_at], code.check_starts, axis=1).astype(np.int8)
    bound = np.ones(target.shape, dtype=bool)
    _, _, once = decode.sum_product(code, llr, target, bound, 10)
    bits, used, failing, attempts = decode.ladder(code, llr, target, bound, 10, 2, 0.15, 0.5)
    assert (failing <= once).all() and (failing < once).any() and (attempts[once == 0] == 0).all() and (attempts[failing < once] > 0).all()
    again = np.bitwise_xor.reduceat(bits[:, code.var_at], code.check_starts, axis=1)
    assert ((again != target).sum(axis=1) == failing).all()
    assert (used <= 10 * (1 + 0.5 * attempts)).all()
    damped, _, f1 = decode.sum_product(code, llr[once > 0] * 0.85, target[once > 0], bound[once > 0], 15)
    first = attempts[once > 0] == 1
    assert (bits[once > 0][first] == damped[first]).all()


def frames_for(spark, seed=2):
    rng = random.Random(seed)
    edges = random_code(seed, 60, 30)
    truth = {f: [rng.randint(0, 1) for _ in range(60)] for f in range(6)}
    llr = [(f, v, (1 - 2 * (b ^ (rng.random() < 0.04))) * 3.0) for f, bits in truth.items() for v, b in enumerate(bits)]
    target = [(f, c, sum(bits[v] for cc, v in edges if cc == c) % 2) for f, bits in truth.items() for c in {c for c, _ in edges}]
    return (
        spark.createDataFrame(edges, "check_id bigint, var_id bigint"), spark.createDataFrame(llr, "frame_id int, var_id bigint, llr double"),
        spark.createDataFrame(target, "frame_id int, check_id bigint, target int"),
    )


def test_packed_frames_like_tables(spark):
    edges, llr, target = frames_for(spark)
    key = lambda r: (r.frame_id, r.var_id)
    packed = sorted(decode.decode(edges, llr, target, 4).collect(), key=key)
    wide = sorted(decode.decode_wide(edges, llr, target, 4).collect(), key=key)
    assert [(*key(r), r.bit, r.converged, r.iterations, r.n_failing) for r in packed] == [(*key(r), r.bit, r.converged, r.iterations, r.n_failing) for r in wide]


def test_size_of_the_code_decides(spark, monkeypatch):
    edges, llr, target = frames_for(spark, 3)
    want = {(r.frame_id, r.var_id): r.bit for r in decode.decode_with_retries(edges, llr, target, 3).collect()}
    monkeypatch.setattr(decode, "MAX_EDGES", 10)
    got = {(r.frame_id, r.var_id): r.bit for r in decode.decode_with_retries(edges, llr, target, 3).collect()}
    assert got == want
    with pytest.raises(ValueError, match="edges"):
        decode.decode_frames(edges, llr, target)


def test_missing_values_and_odd_rows(spark):
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (1, 2)], "check_id bigint, var_id bigint")
    llr = spark.createDataFrame([("a", 0, 4.0), ("a", 2, -4.0), ("a", 9, 1.0), ("b", 1, -4.0), ("b", 0, None), (None, 0, 3.0), ("c", 0, -9.0)], "frame_id string, var_id bigint, llr double")
    target = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 7, 1), (None, 0, 0), ("d", 0, 1)], "frame_id string, check_id bigint, target int")
    got = {r.frame_id: (list(r.bits), r.converged) for r in decode.decode_frames(edges, llr, target).collect()}
    assert got == {"a": ([0, 1, 1], True), "b": ([1, 1, 0], True), None: ([0, 0, 0], True), "c": ([1, 0, 0], True)}
    known = {r.frame_id: list(r.bits) for r in decode.decode_frames(edges, llr.where("frame_id = 'b' AND llr IS NOT NULL"), target.where("frame_id = 'b'"), missing=30.0).collect()}
    assert known == {"b": [0, 0, 0]}
    assert decode.decode_frames(edges, llr.where("false"), target).count() == 0


def test_regular_code(spark):
    edges = [(r.check_id, r.var_id) for r in decode.regular_code(spark, 100, 3, 6).collect()]
    assert len(set(edges)) == 300 and len({c for c, _ in edges}) == 51
    per = [sum(1 for c, _ in edges if c == k) for k in {c for c, _ in edges}]
    assert max(per) == 6 and sum(p < 6 for p in per) == 3


def test_short_frames_are_decoded_on_their_own_checks(monkeypatch):
    rng = np.random.default_rng(5)
    code = decode.Code.of(np.column_stack([np.repeat(np.arange(60), 6), np.concatenate([rng.permutation(120) for _ in range(3)])]))
    n, length = 12, 30
    llr = np.full((n, 120), decode.LLR_LIMIT)
    llr[:, :length] = rng.choice([-2.0, 2.0], (n, length))
    bits = (rng.random((n, 120)) < 0.5) & (np.arange(120) < length)
    target = np.stack([np.bitwise_xor.reduceat(b[code.var_at].astype(np.int8), code.check_starts) for b in bits])
    bound = np.zeros((n, len(code.checks)), dtype=bool)
    bound[:, np.unique(code.check_at[code.var_at < length])[:25]] = True
    bound[0] = False
    settings = (20, 2, 0.15, 0.5)
    want = decode.ladder(code, llr, target, bound, *settings)
    widths, plain = [], decode.sum_product
    monkeypatch.setattr(decode, "sum_product", lambda part, *a: (widths.append(len(part.check_at)), plain(part, *a))[1])
    got = decode.bound_ladder(code, llr, target, bound, *settings)
    for a, b in zip(got, want, strict=True):
        assert (a == b).all()
    assert max(widths) < len(code.check_at) / 2
    nothing = np.zeros_like(bound)
    for a, b in zip(decode.bound_ladder(code, llr, target, nothing, *settings), decode.ladder(code, llr, target, nothing, *settings), strict=True):
        assert (a == b).all()


def test_bits_end_with_the_frame(spark):
    edges, llr, target = frames_for(spark, 4)
    short = llr.where("frame_id > 2 OR var_id < 7 + 11 * frame_id")
    want = {r.frame_id: r for r in decode.decode_frames(edges, short, target, 5, missing=30.0).collect()}
    got = {r.frame_id: r for r in decode.decode_frames(edges, short, target, 5, missing=30.0, whole=False).collect()}
    assert {f: len(r.bits) for f, r in got.items()} == {0: 7, 1: 18, 2: 29, 3: 60, 4: 60, 5: 60}
    for f, r in got.items():
        assert list(r.bits) == list(want[f].bits)[: len(r.bits)] and r[2:] == want[f][2:]


def test_decoded_bits_are_not_broadcast(spark):
    from pairsieve.plans import graphs
    from pairsieve.session import written

    n = 300  # short frames: a few bytes each in the file
    frames = written(spark.range(n * 10).selectExpr(f"id % {n} AS session_id", "id * 0 AS block_id", f"id div {n} AS var_id", "cast(id % 2 AS int) AS a_bit", "cast(id % 2 AS int) AS b_bit"), "frames")
    edges = written(spark.range(10).selectExpr("id div 5 AS check_id", "id AS var_id"), "code")
    found = written(frames.select("session_id", "block_id").distinct().selectExpr("*", "array_repeat(cast(0 AS tinyint), 4096) AS bits", "true AS converged", "1L AS iterations", "0L AS attempt", "0L AS n_failing"), "decoded")
    got = graphs.frame_errors(frames, edges, found)
    plan = got._jdf.queryExecution().executedPlan().toString()
    sides = [part.split("FileScan", 1)[1].split("\n")[0] if "FileScan" in part else part for part in plan.split("BroadcastExchange")[1:]]
    assert not any("bits" in side or "n_failing" in side for side in sides)
    assert got.count() == n
