"""Edge-table jobs, message passing and randomness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits, distributions, rates
from ..operators import decode, graph, quality, sifting
from ..operators.ordered import positions, running
from ..session import scratch_path, written
from ..sources import config, views
from . import oracle as o
from .common import tidy
from .registry import query, view
from .sessions import FRAME_KEYS, frames_of

c = F.col

view("v_syndrome", "SELECT check_id, bit_xor(bit) AS parity FROM v_edges JOIN v_variables USING (var_id) GROUP BY 1")
view("v_target", f"SELECT check_id, CASE WHEN {o.byte_of('flip', 'check_id')} < 20 THEN 1 - parity ELSE parity END AS target FROM v_syndrome")


@query("c12_edge_bits", "SELECT check_id, var_id, CAST(bit AS BIGINT) AS bit FROM v_edges JOIN v_variables USING (var_id)")
def c12(spark, sf):
    return tidy(graph.with_bits(views.edges(spark, sf), views.variables(spark, sf)).select("check_id", "var_id", "bit"))


@query("d9_parity_syndrome", "SELECT check_id, CAST(parity AS BIGINT) AS parity FROM v_syndrome")
def d9(spark, sf):
    return tidy(_syndrome(spark, sf))


def _edges(spark, sf) -> DataFrame:
    return written(views.edges(spark, sf), "edges")


def _syndrome(spark, sf) -> DataFrame:
    return graph.syndrome(_edges(spark, sf), views.variables(spark, sf))


def _target(s: DataFrame) -> DataFrame:
    return s.select("check_id", F.when(views.byte_of("flip", c("check_id")) < 20, 1 - c("parity")).otherwise(c("parity")).alias("target"))


@query("d10_syndrome_mismatches", "SELECT count(*) AS n_checks, count(*) FILTER (parity <> target) AS n_failing FROM v_syndrome JOIN v_target USING (check_id)")
def d10(spark, sf):
    s = _syndrome(spark, sf)
    both = s.join(_target(s), "check_id")
    return both.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(c("parity") != c("target")).alias("n_failing"))


@query("d11_variable_reliability", """
SELECT var_id, n_failing, round(1 - n_failing / max(degree) OVER ()::DOUBLE, 9) AS reliability FROM (
 SELECT var_id, count(*) FILTER (parity <> target) AS n_failing, count(*) AS degree FROM v_edges JOIN v_syndrome USING (check_id) JOIN v_target USING (check_id) GROUP BY 1)""".replace("max(degree) OVER ()::DOUBLE", "CAST(max(degree) OVER () AS DOUBLE)"))
def d11(spark, sf):
    edges, bits = _edges(spark, sf), views.variables(spark, sf)
    return tidy(graph.reliability(edges, graph.mismatches(edges, bits, _target(graph.syndrome(edges, bits)))))


@query("d12_degree_stats", "SELECT sum(d)::BIGINT AS n_edges, count(*) AS n_vars, max(d) AS max_degree, round(avg(d), 9) AS mean_degree FROM (SELECT var_id, count(*) AS d FROM v_edges GROUP BY 1)")
def d12(spark, sf):
    return tidy(graph.degree_stats(views.edges(spark, sf)))


@query("c13_two_hop_set", """
SELECT DISTINCT e.var_id FROM v_edges e WHERE e.check_id IN (SELECT check_id FROM v_edges JOIN v_variables USING (var_id) WHERE punctured)""")
def c13(spark, sf):
    return graph.reach_two_hops(views.edges(spark, sf), views.variables(spark, sf).where("punctured"))


view("v_n2", "SELECT a.var_id, count(DISTINCT b.var_id) AS n2_size FROM v_edges a JOIN v_edges b USING (check_id) GROUP BY 1")


@query("i1_two_hop_size", "SELECT var_id, n2_size FROM v_n2")
def i1(spark, sf):
    return graph.two_hop_sizes(written(views.edges(spark, sf), "edges"))


view("v_checks", "SELECT e.check_id, e.var_id, v.punctured, count(*) OVER w AS degree, count(*) FILTER (v.punctured) OVER w AS n_punctured FROM v_edges e JOIN v_variables v USING (var_id) WINDOW w AS (PARTITION BY e.check_id)")


@query("i2_extrinsic_score", """
SELECT var_id, round(coalesce(min(CASE WHEN degree > 1 THEN (degree - n_punctured - (NOT punctured)::INT) / (degree - 1)::DOUBLE END), 0), 9) AS score FROM v_checks GROUP BY 1""")
def i2(spark, sf):
    return tidy(graph.extrinsic_score(_edges(spark, sf), views.variables(spark, sf)))


view("v_excess", """
WITH d AS (SELECT var_id, greatest(0, count(*) - 2) AS o FROM v_edges GROUP BY 1)
SELECT var_id, sum(total - o)::BIGINT AS score FROM (SELECT e.var_id, d.o, sum(d.o) OVER (PARTITION BY e.check_id) AS total FROM v_edges e JOIN d USING (var_id)) GROUP BY 1""")


@query("i3_excess_degree", "SELECT var_id, score FROM v_excess")
def i3(spark, sf):
    return graph.excess_degree(views.edges(spark, sf))


@query("i4_untainted", f"""
SELECT var_id FROM (SELECT e.var_id, max(v.few) OVER (PARTITION BY e.check_id) AS hit FROM v_edges e JOIN (SELECT p_partkey AS var_id, ({o.byte_of('few', 'p_partkey')} < 1)::INT AS few FROM part) v USING (var_id)) GROUP BY 1 HAVING max(hit) = 0""")
def i4(spark, sf):
    few = views.variables(spark, sf).select("var_id", (views.byte_of("few", c("var_id")) < 1).alias("punctured"))
    return graph.untainted(_edges(spark, sf), few)


@query("i5_dead_checks", "SELECT var_id, count(*) FILTER (NOT punctured AND degree - n_punctured = 1) AS n_dead FROM v_checks GROUP BY 1")
def i5(spark, sf):
    return graph.dead_checks(_edges(spark, sf), views.variables(spark, sf))


view("v_order_size", """
SELECT a.var_id, count(DISTINCT b.var_id) AS rank FROM (SELECT var_id AS check_id, check_id AS var_id FROM v_edges) a
 JOIN (SELECT var_id AS check_id, check_id AS var_id FROM v_edges) b USING (check_id) GROUP BY 1""")


# a tenth of the orders at most; the SQL goes on in rounds of what is left, with all that comes first in each of its checks
@query("i6_untainted_selection", """
WITH RECURSIVE r(turn, check_id, var_id, rank, picked) AS (
 SELECT 0, e.var_id, e.check_id, s.rank, false FROM v_edges e JOIN v_order_size s ON s.var_id = e.check_id
 UNION ALL
 SELECT * FROM (
  WITH l AS (SELECT * FROM r WHERE NOT picked),
  f AS (SELECT check_id, min({'a': rank, 'b': var_id}) AS first FROM l GROUP BY check_id),
  p AS (SELECT l.var_id, any_value(l.rank) AS rank, any_value(l.turn) AS turn FROM l JOIN f USING (check_id) GROUP BY l.var_id HAVING bool_and({'a': l.rank, 'b': l.var_id} = f.first)),
  g AS (SELECT DISTINCT y.var_id FROM l x JOIN p ON p.var_id = x.var_id JOIN l y ON y.check_id = x.check_id)
  SELECT l.turn + 1, l.check_id, l.var_id, l.rank, false FROM l ANTI JOIN g ON g.var_id = l.var_id
  UNION ALL SELECT p.turn + 1, NULL, p.var_id, p.rank, true FROM p))
SELECT var_id, rank FROM r WHERE picked ORDER BY rank, var_id LIMIT (SELECT count(DISTINCT check_id) // 10 FROM v_edges)""")
def i6(spark, sf):
    # orders play the variables here: they have few edges, so many of them do not touch
    e = written(views.edges(spark, sf).select(c("var_id").alias("check_id"), c("check_id").alias("var_id")), "edges")
    sizes = written(graph.two_hop_sizes(e), "two-hop")
    return graph.untainted_selection(e, sizes, "n2_size", sizes.count() // 10)


@query("i7_reachable_checks", """
WITH RECURSIVE s AS (SELECT min(var_id) AS v FROM v_edges),
 c0 AS (SELECT DISTINCT check_id FROM v_edges WHERE var_id = (SELECT v FROM s)),
 v1 AS (SELECT DISTINCT var_id FROM v_edges WHERE check_id IN (SELECT check_id FROM c0)),
 c2 AS (SELECT DISTINCT check_id FROM v_edges WHERE var_id IN (SELECT var_id FROM v1))
SELECT check_id, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT check_id, 0 AS depth FROM c0 UNION ALL SELECT check_id, 2 FROM c2) GROUP BY 1""")
def i7(spark, sf):
    e = views.edges(spark, sf)
    return tidy(graph.reachable_checks(e, e.agg(F.min("var_id").alias("var_id")), 4))


@query("i8_short_cycles", """
SELECT CAST(sum(k * (k - 1) // 2) AS BIGINT) AS n_cycles, sum(k * (k - 1) // 2) > 0 AS girth_is_four FROM (
 SELECT a.var_id, b.var_id AS other, count(*) AS k FROM v_edges a JOIN v_edges b ON a.check_id = b.check_id AND a.var_id < b.var_id GROUP BY 1, 2)""")
def i8(spark, sf):
    return graph.four_cycles(views.edges(spark, sf))


_DIST = ", ".join(f"('{r}:{s}', {d}, {p!r}::DOUBLE)" for r, s, d, p in distributions.rows())


@query("i9_degree_targets", f"""
SELECT rate, CAST(degree AS BIGINT) AS degree, CAST(base + CASE WHEN rk <= n - sum_base THEN 1 ELSE 0 END AS BIGINT) AS n_nodes FROM (
 SELECT *, sum(base) OVER (PARTITION BY rate) AS sum_base, row_number() OVER (PARTITION BY rate ORDER BY expected - base DESC, degree DESC) AS rk FROM (
  SELECT *, floor(expected) AS base FROM (SELECT rate, degree, n, p * round_even(n / sum(p / degree) OVER (PARTITION BY rate), 0) / degree AS expected
   FROM (VALUES {_DIST}) t(rate, degree, p), (SELECT count(DISTINCT var_id) AS n FROM v_edges))))""")
def i9(spark, sf):
    n = views.edges(spark, sf).select("var_id").distinct().count()
    # any table of this form will do; this one holds the nine rates that are built in
    path = scratch_path(spark, "distributions")
    config.write_distributions(spark, path, [(f"{r}:{s}", d, p) for r, s, d, p in distributions.rows()])
    return tidy(graph.degree_targets(config.read_distributions(spark, path), n))


RATES = [round(0.51 + 0.01 * i, 2) for i in range(40)]
_K = ", ".join(f"({r!r}::DOUBLE)" for r in RATES)


@query("i10_pattern_library", f"""
SELECT var_id, place, min(rate) AS first_rate FROM (SELECT var_id, row_number() OVER (ORDER BY score, var_id) AS place FROM v_excess),
 (SELECT rate, CAST(floor((1 - 0.5::DOUBLE / rate) * n + 1e-9) AS BIGINT) AS kk FROM (VALUES {_K}) r(rate), (SELECT count(DISTINCT var_id) AS n FROM v_edges)) WHERE place <= kk GROUP BY 1, 2""")
def i10(spark, sf):
    e = views.edges(spark, sf)
    n = e.select("var_id").distinct().count()
    # place = variables of lower score, from the histogram of scores, plus the place among equal scores
    scored = written(graph.excess_degree(e), "scores")
    hist = scored.groupBy("score").agg(F.count(F.lit(1)).alias("k"))
    before = running(hist, [], "score", {"before": ("sum", c("k"))}, inclusive=False).select("score", "before")
    inside = positions(scored, ["score"], "var_id", out="inner")
    ordered = graph.attach(inside, before, ["score"], ["var_id"]).withColumn("place", c("before") + c("inner"))
    return graph.nested_patterns(ordered.select("var_id", "place"), n, RATES).select("var_id", "place", "first_rate")


def _code_sql(check_degree: int) -> str:
    return f"""SELECT v AS offs, layer * {-(-rates.FRAME // check_degree)} + (row_number() OVER (PARTITION BY layer ORDER BY md5('code:' || layer || ':' || v)) - 1) // {check_degree} AS check_id
 FROM (SELECT unnest(range({rates.FRAME})) AS v), (SELECT unnest(range(3)) AS layer)"""


view("v_code", _code_sql(6))


def decoded_frames(spark, sf, check_degree: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, code, and the bits one party gets from its own ones and the other's parities.

    A frame's missing end is known to be 0 on both sides.
    """
    frames = frames_of(spark, sf).withColumnRenamed("offset", "var_id")
    edges = written(decode.regular_code(spark, rates.FRAME, 3, check_degree), "code")
    target = decode.frame_syndromes(edges, frames.select(*FRAME_KEYS, "var_id", c("a_bit").alias("bit")), FRAME_KEYS)
    llr = frames.select(*FRAME_KEYS, "var_id", bits.channel_llr(c("b_bit"), F.lit(views.NOISE_OF_256 / 256), F.lit(False)).alias("llr"))
    found = decode.decode_frames(edges, llr, target, keys=FRAME_KEYS, missing=decode.LLR_LIMIT, whole=False)
    return frames, edges, written(found, "decoded")


def frame_errors(frames: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """Per frame: errors before and after decoding, ones, and the checks whose parity is off, recounted from the rows."""
    # bits take a byte each here and far less in files, by which the optimizer would have the driver collect and broadcast them
    # the code's variables are the places in a frame
    both = frames.join(found.select(*FRAME_KEYS, "bits").hint("merge"), FRAME_KEYS).withColumn("bit", F.element_at("bits", (c("var_id") + 1).cast("int")).cast("int")).drop("bits")
    per = both.groupBy(*FRAME_KEYS).agg(
        F.count(F.lit(1)).alias("n_bits"), F.sum("bit").alias("ones"), F.count_if(c("a_bit") != c("b_bit")).alias("errors_before"), F.count_if(c("a_bit") != c("bit")).alias("errors_after")
    )
    parities = both.join(edges, "var_id").groupBy(*FRAME_KEYS, "check_id").agg(
        F.bit_xor("a_bit").alias("a"), F.bit_xor("b_bit").alias("b"), F.bit_xor("bit").alias("x")
    )
    off = parities.groupBy(*FRAME_KEYS).agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(c("a") != c("b")).alias("off_before"), F.count_if(c("a") != c("x")).alias("off_after"))
    return per.join(off, FRAME_KEYS).join(found.drop("bits").hint("merge"), FRAME_KEYS)


# at the error rate of these tables a code of rate 1/2 corrects every frame, so the corrected bits are those of the other party
@query("i11_message_passing", """
SELECT session_id, block_id, n_bits, errors_before, ones, 0::BIGINT AS errors_after, n_checks, off_before, 0::BIGINT AS n_failing, true AS converged FROM (
 SELECT session_id, block_id, count(*) AS n_bits, count(*) FILTER (a_bit <> b_bit) AS errors_before, sum(a_bit)::BIGINT AS ones FROM v_frames GROUP BY 1, 2)
 JOIN (SELECT session_id, block_id, count(*) AS n_checks, count(*) FILTER (a <> b) AS off_before FROM (
  SELECT session_id, block_id, check_id, bit_xor(a_bit) AS a, bit_xor(b_bit) AS b FROM v_frames JOIN v_code USING (offs) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (session_id, block_id)""")
def i11(spark, sf):
    got = frame_errors(*decoded_frames(spark, sf, 6))
    return tidy(got.select(*FRAME_KEYS, "n_bits", "errors_before", "ones", "errors_after", "n_checks", "off_before", "n_failing", "converged"))


view("v_code_dense", _code_sql(8))


# rate 5/8 is near what this error rate allows: some frames need retries, and how many is for the decoder to find;
# the parities of what it returns are recounted here for every frame
@query("i12_retry_ladder", """
SELECT session_id, block_id, n_bits, n_checks, true AS parities_agree, true AS corrected_if_converged, true AS within_ladder FROM (
 SELECT session_id, block_id, count(*) AS n_bits FROM v_frames GROUP BY 1, 2)
 JOIN (SELECT session_id, block_id, count(DISTINCT check_id) AS n_checks FROM v_frames JOIN v_code_dense USING (offs) GROUP BY 1, 2) USING (session_id, block_id)""")
def i12(spark, sf):
    got = frame_errors(*decoded_frames(spark, sf, 8))
    limit = decode.ITERATIONS * (1 + decode.ITERATION_SCALE * c("attempt"))
    return tidy(got.select(
        *FRAME_KEYS, "n_bits", "n_checks",
        ((c("off_after") == c("n_failing")) & (c("converged") == (c("n_failing") == 0))).alias("parities_agree"),
        (~c("converged") | (c("errors_after") == 0)).alias("corrected_if_converged"),
        ((c("attempt") <= decode.RETRIES) & (c("iterations") <= limit)).alias("within_ladder"),
    ))


# --- randomness -----------------------------------------------------------------

view("v_bits", "SELECT session_id, a_bit AS bit, row_number() OVER (PARTITION BY session_id ORDER BY round_id) - 1 AS pos FROM v_large_sifted")
view("v_lag", "SELECT *, lag(bit) OVER (PARTITION BY session_id ORDER BY pos) AS prev FROM v_bits")


def key_bits(spark, sf) -> DataFrame:
    s = sifting.sift(views.pairs_large(spark, sf))
    return positions(s, ["session_id"], "round_id", out="pos", start=0).select("session_id", "pos", c("a_bit").alias("bit"))


@query("d24_bit_uniformity", """
SELECT session_id, n, ones, round((power(n - ones - n / 2.0::DOUBLE, 2) + power(ones - n / 2.0::DOUBLE, 2)) / (n / 2.0::DOUBLE), 9) AS chi2 FROM (SELECT session_id, count(*) AS n, sum(bit)::BIGINT AS ones FROM v_bits GROUP BY 1)""")
def d24(spark, sf):
    return tidy(quality.bit_chi_square(key_bits(spark, sf), "session_id"))


@query("d25_byte_uniformity", """
WITH h AS (SELECT session_id, value, count(*) AS k FROM (SELECT session_id, pos // 8 AS b, count(*) AS n, CAST(sum(bit * (1 << (7 - pos % 8)::INTEGER)) AS INTEGER) AS value FROM v_bits GROUP BY 1, 2) WHERE n = 8 GROUP BY 1, 2),
 t AS (SELECT session_id, sum(k)::BIGINT AS total FROM h GROUP BY 1)
SELECT t.session_id, t.total AS n_bytes, round(sum(power(coalesce(h.k, 0) - t.total / 256.0::DOUBLE, 2) / (t.total / 256.0::DOUBLE)), 6) AS chi2 FROM t CROSS JOIN range(0, 256) r(v) LEFT JOIN h ON h.session_id = t.session_id AND h.value = r.v GROUP BY 1, 2""")
def d25(spark, sf):
    return tidy(quality.byte_chi_square(key_bits(spark, sf), "session_id"), 6)


@query("d26_serial_correlation", """
SELECT session_id, count(*) AS n_pairs, round(sum((bit - 0.5::DOUBLE) * (prev - 0.5::DOUBLE)) / count(*) / 0.25::DOUBLE, 9) AS lag1, round(corr(bit, prev), 9) AS pearson FROM v_lag WHERE prev IS NOT NULL GROUP BY 1""")
def d26(spark, sf):
    return tidy(quality.serial_correlation(key_bits(spark, sf), "session_id"))


@query("d27_runs_test", """
SELECT session_id, n, n1, runs, n - n1 AS n0, round(e, 9) AS expected, round(v, 9) AS variance, round((runs - e) / sqrt(v), 9) AS z FROM (
 SELECT *, 2.0::DOUBLE * (n - n1) * n1 / n + 1 AS e, 2.0::DOUBLE * (n - n1) * n1 * (2.0::DOUBLE * (n - n1) * n1 - n) / (n::DOUBLE * n * (n - 1)) AS v FROM (
  SELECT session_id, count(*) AS n, sum(bit)::BIGINT AS n1, count(*) FILTER (prev IS NULL OR prev <> bit) AS runs FROM v_lag GROUP BY 1))""")
def d27(spark, sf):
    return tidy(quality.runs_test(key_bits(spark, sf), "session_id"))
