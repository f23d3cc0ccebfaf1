import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
import public_tokenizers
from pairsieve.llm import common, minhash, pii, shared_files, token_files, tokens
from pairsieve.session import scratch_path

SCHEMA = "doc_id long, text string"


def test_key_of_any_length(spark):
    key = "sk-" + "aZ9" * 700
    text = f"the token is {key} and so on"
    row = pii.redacted(spark.createDataFrame([(1, text), (2, "x" * 3000)], SCHEMA)).orderBy("doc_id").collect()
    assert key not in row[0].text and row[1].text == "x" * 3000


def test_kept_follows_the_id(spark):
    a = " ".join(f"w{k}" for k in range(60))
    rows = [(1, a), (1, a + " more"), (2, a + " other"), (3, "nothing like it at all here"), (None, a)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, None, True)], key=str)


def test_one_id_in_many_rows(spark):
    rows = [(7, f"text number {k % 9}") for k in range(400)] + [(None, "no id")] * 50 + [(3, "first")]
    folder = scratch_path(spark, "test-tokens")
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    token_files.write_token_files(docs, folder, path)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 50 + [3] + [7] * 400
    lengths = [r.n_tokens for r in got]
    assert [r.start for r in got] == [sum(lengths[:k]) for k in range(len(got))]


def test_paths_are_qualified(spark, tmp_path):
    assert shared_files.qualified(spark, str(tmp_path)).startswith("file:/")
    with pytest.raises(ValueError, match="scheme"):
        shared_files.place(str(tmp_path))


def test_letters_by_the_model():
    coder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert coder.by_model
    for text in ("plain words", "ciónñ ÀÉ straße µm ª º", "I'm don't", "a,b. c..", "İstanbul ſ ﬁ 中文 é", "x1y2 \t tab", "ends. here,"):
        assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_workers_keep_little(spark):
    text = b"some words of a very long text " * 200_000
    before = common._POWERS["n"]
    sums = common.prefix_hashes(np.frombuffer(text, dtype=np.uint8))
    at = np.array([0, 31, len(text) - 31])
    assert len(set(common.range_hashes(sums, at, at + 30).tolist())) == 1
    assert common._POWERS["n"] <= max(before, common.KEPT_POWERS)
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 5000})
    pieces = list(common.rows_at_a_time([batch]))
    assert sum(p.num_rows for p in pieces) == 5000 and max(p.num_rows for p in pieces) <= 1050
    coder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert coder.encode("words").dtype == np.uint32 and coder.ids.itemsize == 2


def test_texts_go_to_python_in_small_batches(spark):
    before = spark.conf.get(common.BATCH_KEY)
    try:
        for asked, want in (("10000", str(common.BATCH_ROWS)), ("0", str(common.BATCH_ROWS)), ("50", "50")):
            spark.conf.set(common.BATCH_KEY, asked)
            corpus_pipeline.pack(spark, spark.createDataFrame([(1, "a b")], SCHEMA), "")
            assert spark.conf.get(common.BATCH_KEY) == want
    finally:
        spark.conf.set(common.BATCH_KEY, before)
