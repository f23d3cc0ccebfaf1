import math

import pytest
from pyspark.sql import functions as F

from pairsieve.functions import bits, bounds, channel, finite, rates

lit = F.lit


@pytest.mark.parametrize("p,want", [(0.0, 0.0), (1.0, 0.0), (0.5, 1.0), (0.11, 0.499915958)])
def test_binary_entropy(one, p, want):
    assert one(channel.binary_entropy(lit(p))) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("q,want", [(0.0, 1.0), (0.5, 0.0)])
def test_channel_capacity(one, q, want):
    assert one(channel.channel_capacity(lit(q))) == pytest.approx(want)


@pytest.mark.parametrize("r,coll,erasure,best,rational", [(0.0, 1.0, 1.0, 1.0, 0.5), (0.75, 1 - math.log2(2.6875), 0.25, 0.25, 0.25), (1.0, -1.0, 0.0, 0.0, 0.0)])
def test_bounds(one, r, coll, erasure, best, rational):
    assert one(bounds.collision_entropy_rate(lit(r))) == pytest.approx(coll)
    assert one(bounds.erasure_bound(lit(r))) == pytest.approx(erasure)
    assert one(bounds.max_bound_entropy(lit(r))) == pytest.approx(best)
    assert one(bounds.rational_bound(lit(r))) == pytest.approx(rational)


@pytest.mark.parametrize("x,want", [(0.5, 0.5), (0.0, 0.0), (-0.5, 0.0), (0.8, 0.8)])
def test_gamma_inverse_ends(one, x, want):
    assert one(bounds.gamma_inverse(lit(x))) == pytest.approx(want)


def test_gamma_inverse_solves(spark):
    rows = spark.range(1, 50).select((F.col("id") / 100).alias("x")).withColumn("y", bounds.gamma_inverse(F.col("x"))).collect()
    for r in rows:
        h = -r.y * math.log2(r.y) - (1 - r.y) * math.log2(1 - r.y)
        assert h + r.y - 1 == pytest.approx(r.x, abs=1e-9)


def test_closed_form_equals_full_bound(spark):
    r = spark.range(0, 1001).select((F.col("id") / 1000).alias("r"))
    full = F.greatest(bounds.dupuis_konig_bound(F.col("r")), 1 - F.col("r"))
    gap = r.select(F.max(F.abs(full - bounds.max_bound_entropy(F.col("r")))).alias("g")).first()["g"]
    assert gap < 1e-9


def test_storage_capacity_ends(one):
    assert one(bounds.storage_capacity_mixed(lit(0.0))) == 0
    assert one(bounds.storage_capacity_mixed(lit(1.0))) == 1


def test_penalty_closed_form(one):
    want = math.sqrt((1500 / 500000) * (501 / 500) * math.log(4e10))
    assert one(finite.finite_size_penalty(lit(1000), lit(500), 1e-10)) == pytest.approx(want)
    assert one(finite.finite_size_penalty(lit(100), lit(100))) > one(finite.finite_size_penalty(lit(10000), lit(10000)))


def test_min_n_is_least(spark):
    df = spark.createDataFrame([(0.01, 0.1, 0.002), (0.03, 0.5, 0.01)], "q double, r double, nu double")
    df = df.withColumn("n", finite.min_n_for_length(500, F.col("q"), F.col("r"), F.col("nu")))
    at = lambda n: finite.finite_key_length(n, F.col("q"), F.col("r"), F.col("nu"))
    for r in df.select(at(F.col("n")).alias("here"), at(F.col("n") - 1).alias("below")).collect():
        assert r.here >= 500 > r.below


def test_strong_converse_against_grid(spark):
    df = spark.createDataFrame([(0.3, 0.5), (0.7, 0.9), (0.9, 1.0)], "r double, rate double")
    for row in df.withColumn("e", bounds.strong_converse_exponent(F.col("r"), F.col("rate"))).collect():
        best = 0.0
        for i in range(200001):
            x = 0.01 + i * (1 / 1.0001 - 0.01) / 200000
            s = math.log2(1 + row.r) + x * math.log2(1 + ((1 - row.r) / (1 + row.r)) ** (1 / x))
            best = max(best, 1 + ((1 - x) * (row.rate - 1) - s))
        assert row.e == pytest.approx(best, abs=1e-6)


def test_nearest_rate_tie_takes_lower(one):
    assert one(rates.nearest_rate(lit(0.75), F.array(lit(0.7), lit(0.8)))) == 0.7


def test_hashes_against_hashlib(spark):
    import hashlib
    import hmac

    text, seed = "1011001110001111", 77
    payload = bytes(int(b) for b in text)
    df = spark.createDataFrame([(text, seed)], "t string, s bigint")
    row = df.select(
        bits.block_hash_hex(bits.bit_hex(F.col("t")), F.col("s")).alias("h"),
        bits.hmac_sha256(F.concat(lit("8f1d"), bits.le64_hex(F.col("s"))), bits.bit_hex(F.col("t"))).alias("m"),
    ).first()
    assert row.h == hashlib.sha256(payload + seed.to_bytes(8, "little")).digest()[:8].hex()
    key = bytes.fromhex("8f1d") + seed.to_bytes(8, "little")
    assert row.m == hmac.new(key, payload, hashlib.sha256).hexdigest()


def test_polynomial_hash(spark):
    bit_list, seed = [1, 0, 1, 1, 0, 1] * 50, 123456789
    acc = 0
    for b in bit_list:
        acc = (acc * (seed + 1) + b) % (2**61 - 1)
    df = spark.createDataFrame([(bit_list,)], "b array<int>")
    assert df.select(bits.polynomial_hash(F.col("b"), seed).alias("h")).first()["h"] == acc & ((1 << 50) - 1)
