import pytest
from pyspark.sql import functions as F

from pairsieve.operators import ledger, report, sifting, sweep
from pairsieve.operators.contracts import sifting_rules, violated

CASES = {
    "all": ([0, 0, 1, 1], [1, 0, 1, 0], [0, 0, 1, 1], [1, 0, 1, 0], [0, 1, 2, 3]),
    "none": ([0] * 4, [1, 0, 1, 0], [1] * 4, [0, 1, 0, 1], []),
    "partial": ([0, 1, 0, 1, 0], [1, 0, 1, 0, 1], [0, 0, 0, 1, 1], [1, 1, 1, 0, 0], [0, 2, 3]),
}


def party(spark, bases, outcomes):
    return spark.createDataFrame([(1, i, b, o) for i, (b, o) in enumerate(zip(bases, outcomes))], "session_id int, round_id bigint, basis int, outcome int")


@pytest.mark.parametrize("name", CASES)
def test_sift(spark, name):
    ab, ao, bb, bo, want = CASES[name]
    got = sifting.sift(sifting.align(party(spark, ab, ao), party(spark, bb, bo)))
    assert sorted(r.round_id for r in got.collect()) == want


def test_partition_positions(spark):
    a = party(spark, [0, 1, 0, 1], [1, 0, 1, 0])
    got = sifting.partition_positions(sifting.sift(sifting.align(a, a))).collect()
    assert {(r.round_id, r.basis, r.partition_pos) for r in got} == {(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)}


def ledger_rows(spark, *entries):
    rows = [(1, i, *e) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "session_id bigint, entry_id bigint, syndrome_bits bigint, hash_bits bigint, retry_bits bigint, shortening_bits double")


@pytest.mark.parametrize("entries,cap,breach", [([(99, 0, 0, 0.0), (2, 0, 0, 0.0)], 100, 101), ([(100, 0, 0, 0.0), (1, 0, 0, 0.0)], 100, 101), ([(100, 0, 0, 0.0)], 100, None), ([(2048, 64, 0, 0.0), (50, 0, 0, 0.0), (50, 0, 0, 0.0)], 10000, None)])
def test_breach(spark, entries, cap, breach):
    df = ledger_rows(spark, *entries)
    got = ledger.first_breach(df, cap).collect()
    assert [r.breach_total for r in got] == ([] if breach is None else [breach])
    total = ledger.totals(df, cap).first()
    assert total.total == sum(sum(e) for e in entries)
    assert total.within_cap == (breach is None)


def test_test_size(one):
    size = lambda n, f, m=1: one(sifting.test_size(F.lit(n).cast("bigint"), f, m))
    assert size(100, 0.1) == 10 and size(3, 0.1) == 1 and size(1, 0.5) == 0 and size(10, 0.9) == 5


def test_bin_edges_are_right_closed(one):
    label = lambda q: one(report.bin_label(F.lit(q)))
    assert label(0.0) is None and label(0.01) == "0%-1%" and label(0.0100001) == "1%-3%" and label(0.23) is None


def test_levels_without_rows_stay(spark):
    df = spark.createDataFrame([(0.011, 1000, True)], "qber double, num_pairs bigint, is_success boolean")
    got = {round(r.qber_percent): r.state for r in report.death_valley(df).collect()}
    assert got == {1: "OK", 3: "NO DATA", 5: "NO DATA", 8: "NO DATA", 10: "NO DATA"}


def test_nearest_surface_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.random(), 10 ** -rng.uniform(3, 8), rng.random(), f"k{i:04d}") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, y double, v double, t string")
    xs, ys = [0.1, 0.5, 0.9], [1e-6, 1e-4, 5e-4]
    got = {(r.g, r.gx, r.gy): r.value for r in report.nearest_surface(df, xs, ys, "x", "y", "g", "v", "t").collect()}
    for g in "ab":
        for gx in xs:
            for gy in ys:
                best = min((round((r[1] - gx) ** 2 + (r[2] - gy) ** 2, 15), r[4], r[3]) for r in rows if r[0] == g)
                assert got[g, gx, gy] == best[2]


def test_outcome_precedence(one):
    c = lambda e, a=False, w="", n=1: one(sweep.classify(F.lit(e), F.lit(a), F.lit(w), F.lit(n)))
    assert c("Timeout in QBER") == "failure_timeout" and c("QBER") == "failure_qber" and c("ldpc") == "failure_reconciliation"
    assert c(None, True, "security") == "failure_security" and c(None, n=0) == "failure_security" and c(None) == "success"


def test_contract_ids(one):
    rules = sifting_rules(F.lit(5), F.lit(4), F.lit(0.05), F.lit(0.01), F.lit(0.3), 0.22)
    assert one(violated(rules)) == "POST-S-001,POST-S-002,POST-S-003"
