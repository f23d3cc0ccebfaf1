"""Sources and sinks (group A), acknowledgements and envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sweep
from ..session import scratch_path, written
from ..sources import config, messages, sinks, store, views
from ..streaming import base, buffered
from .common import k, tidy
from .registry import query
from .reports import _DV, report_input
from ..operators import report

c = F.col


def filled_store(spark, sf) -> str:
    """Results of both phases appended to a new store as two batches."""
    path = store.new_store(spark, "query")
    r = written(views.results(spark, sf), "results")
    for phase in ("lhs_warmup", "active_learning"):
        store.append_results(r.where(c("phase") == phase), path)
    return path


@query("a1_scan_phase", "SELECT sample_key, outcome, final_key_length FROM v_results WHERE phase = 'active_learning'")
def a1(spark, sf):
    return store.read_phase(spark, filled_store(spark, sf), "active_learning").select("sample_key", "outcome", "final_key_length")


@query("a2_count_by_phase", "SELECT phase, count(*) AS n FROM v_results GROUP BY 1")
def a2(spark, sf):
    return store.read_results(spark, filled_store(spark, sf)).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("a3_append_batches", "SELECT phase, outcome, count(*) AS n, sum(final_key_length)::BIGINT AS total_length FROM v_results GROUP BY 1, 2")
def a3(spark, sf):
    got = store.read_results(spark, filled_store(spark, sf))
    return got.groupBy("phase", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("final_key_length").alias("total_length"))


def arrivals(spark, sf) -> DataFrame:
    """Results as a stream of four epochs."""
    r = store.conform(views.results(spark, sf))
    path = scratch_path(spark, "buffer")
    cut = written(r.withColumn("_part", F.pmod(F.xxhash64("sample_key"), F.lit(4))), "arrivals", by="_part")
    return base.file_epochs(cut, "_part", 4, path)


FILE_ROWS = 700


@query("a4_buffered_append", "SELECT outcome, count(*) AS n FROM v_results GROUP BY 1")
def a4(spark, sf):
    got = buffered.append_buffered(arrivals(spark, sf), "buffered", "sample_key", FILE_ROWS)
    return got.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("a4_file_sizes", "SELECT n_rows, count(*) AS n_files FROM (SELECT CASE WHEN f < n // 700 THEN 700 ELSE n % 700 END AS n_rows FROM (SELECT count(*) AS n, unnest(range((count(*) + 699) // 700)) AS f FROM v_results)) GROUP BY 1")
def a4_files(spark, sf):
    got = buffered.append_buffered(arrivals(spark, sf), "buffered", "sample_key", FILE_ROWS)
    per = got.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    return per.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_files"))


@query("a5_wide_rows", """
SELECT sample_key, phase, outcome, final_key_length, '{"error_message":' || CASE WHEN outcome = 'success' THEN 'null' ELSE '"' || outcome || '"' END || ',"num_pairs":' || num_pairs || ',"leakage_bits":' || leakage_bits || '}' AS metadata FROM v_results""")
def a5(spark, sf):
    meta = F.struct(F.when(c("outcome") != "success", c("outcome")).alias("error_message"), "num_pairs", "leakage_bits")
    return views.results(spark, sf).select("sample_key", "phase", "outcome", "final_key_length", F.to_json(meta, {"ignoreNullFields": "false"}).alias("metadata"))


@query("a6_training_rows", """
SELECT sample_key, round(storage_noise_r, 9) AS storage_noise_r, round(log10(storage_rate_nu), 9) AS log_storage_rate_nu, round(log10(num_pairs::DOUBLE), 9) AS log_num_pairs, round(net_efficiency, 9) AS y FROM v_results WHERE outcome = 'success'""")
def a6(spark, sf):
    rows = sweep.encode(views.results(spark, sf).where("outcome = 'success'"))
    return tidy(rows.select("sample_key", "storage_noise_r", "log_storage_rate_nu", "log_num_pairs", c("net_efficiency").alias("y")))


@query("a7_load_both_phases", "SELECT sample_key, phase FROM v_results")
def a7(spark, sf):
    path = filled_store(spark, sf)
    both = store.read_phase(spark, path, "lhs_warmup").unionByName(store.read_phase(spark, path, "active_learning"))
    return both.select("sample_key", "phase")


@query("a8_remaining_samples", "SELECT sample_key FROM v_samples WHERE sample_key NOT IN (SELECT sample_key FROM v_results WHERE phase = 'lhs_warmup')")
def a8(spark, sf):
    done = store.read_phase(spark, filled_store(spark, sf), "lhs_warmup")
    return store.remaining(views.samples(spark, sf), done).select("sample_key")


@query("a9_config_bounds", """
SELECT name, count(*) AS n, count(*) FILTER (value BETWEEN lo AND hi) AS n_inside FROM (
 SELECT unnest(['storage_noise_r', 'channel_fidelity', 'detector_error']) AS name, unnest([storage_noise_r, channel_fidelity, detector_error]) AS value FROM v_samples)
 JOIN (VALUES ('storage_noise_r', 0.1::DOUBLE, 0.75::DOUBLE), ('channel_fidelity', 0.9::DOUBLE, 1.0::DOUBLE), ('detector_error', 0.0::DOUBLE, 0.05::DOUBLE)) b(name, lo, hi) USING (name) GROUP BY 1""")
def a9(spark, sf):
    path = scratch_path(spark, "config")
    config.write_lines(spark, path, {"storage_noise_r": (0.1, 0.75), "channel_fidelity": (0.9, 1.0), "detector_error": (0.0, 0.05)})
    bounds = config.read_bounds(spark, path)
    names = ("storage_noise_r", "channel_fidelity", "detector_error")
    rows = views.samples(spark, sf).select(*names).unpivot([], list(names), "name", "value")
    both = rows.join(bounds, "name")
    return both.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("value").between(c("lo"), c("hi"))).alias("n_inside"))


@query("a10_report_csv", _DV)
def a10(spark, sf):
    table = tidy(report.death_valley(report_input(spark, sf)), 6)
    path = scratch_path(spark, "report")
    sinks.write_csv(table, path)
    return spark.read.schema(table.schema).option("header", "true").csv(path)



_TEXT = """CASE WHEN event_id % 50 = 0 THEN '{"seq": ' ELSE '{"msg_type":"' || msg_type || '","payload":' || replace(payload, ' ', '') || ',"seq":' || seq || ',"session_id":"' || session_id || '"}' END"""


@query("h51_envelope_json", """SELECT event_id, '{"msg_type":"' || msg_type || '","payload":' || replace(payload, ' ', '') || ',"seq":' || seq || ',"session_id":"' || session_id || '"}' AS text FROM v_messages""")
def h51(spark, sf):
    return views.messages(spark, sf).select("event_id", messages.to_text().alias("text"))


@query("a10_report_markdown", """
WITH t AS (SELECT phase, count(*) AS processed, count(*) FILTER (outcome = 'skipped_infeasible') AS skipped FROM v_results GROUP BY 1)
SELECT '# Campaign' AS line UNION ALL SELECT '' UNION ALL SELECT '| phase | processed | skipped |' UNION ALL SELECT '| --- | --- | --- |'
UNION ALL SELECT '| ' || phase || ' | ' || processed || ' | ' || skipped || ' |' FROM t""")
def a10_markdown(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_markdown(report.campaign_metrics(views.results(spark, sf), "phase").select("phase", "processed", "skipped"), "Campaign", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("a11_parse_messages", """
SELECT event_id, event_id % 50 <> 0 AS is_valid, CASE WHEN event_id % 50 <> 0 THEN seq END AS seq, CASE WHEN event_id % 50 <> 0 THEN msg_type END AS msg_type, CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract(payload, '$.k') AS BIGINT) END AS k FROM v_messages""")
def a11(spark, sf):
    raw = views.messages(spark, sf).select("event_id", F.when(c("event_id") % 50 == 0, F.lit('{"seq": ')).otherwise(messages.to_text()).alias("raw"))
    return messages.parse(raw, "raw").select("event_id", "is_valid", "seq", "msg_type", c("payload.k").alias("k"))


@query("c15_ack_matching", """
SELECT session_id, seq, CASE WHEN event_id % 13 = 0 THEN 'timeout' WHEN event_id % 29 = 0 THEN 'mismatch' ELSE 'acked' END AS state FROM v_messages""")
def c15(spark, sf):
    m = views.messages(spark, sf)
    acks = m.where("event_id % 13 <> 0").select(
        "session_id", c("seq").alias("ack_seq"), F.when(c("event_id") % 29 == 0, "other").otherwise(c("msg_type")).alias("ack_type")
    )
    return messages.match_acks(m, acks).select("session_id", "seq", "state")
