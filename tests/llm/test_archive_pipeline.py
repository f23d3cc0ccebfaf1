import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pairsieve.llm import warc
from pairsieve.session import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, header string, content_key string"


def test_archive_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c\r\nX: y", "other é"), (4, None, None), (5, "", ""), (None, "n", "same"), (None, "n", "alone"), (2, "http://b", "same")]
    rows = [(*r, "clash", "clash") for r in rows]
    folder = scratch_path(spark, "test-archive")
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), folder)
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_index(spark, folder).collect()]
    want = [(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "response", None, 8), (4, "revisit", 5, 0), (5, "response", None, 0), (None, "revisit", 2, 4), (None, "response", None, 5)]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = sorted((str(r.page_id), bytes(r.payload).decode()) for r in warc.pages_back(spark, folder).collect())
    assert back == sorted((str(r[0]), r[2] or "") for r in rows)
    for r in warc.records(spark, folder).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert len(body) == length + 4 and body.endswith(b"\r\n\r\n")
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    folder = scratch_path(spark, "test-archive")
    warc.write_archive(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_index(spark, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="input tables not present")
def test_archive_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(entry.oracle_sql()["op8_warc"])
    cols = [d[0] for d in cur.description]
    got = entry.queries()["op8_warc"](spark, SF).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="input tables not present")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(None, "no id at all but words", "en", "s", 1), (0, docs.first().text, "en", "s", 1), (90001, None, None, None, None), (90002, "", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(docs.limit(2))
    before = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        n = docs.count()
        out = stage(spark, docs, SF)
        assert out.columns == before, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() <= n
        if name == "quality_classifier":
            good = labels.where("quality = 1").select("doc_id")
            assert good.join(docs, "doc_id", "left_anti").count() <= 0.02 * good.count()
        if name == "near_duplicates":
            ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
