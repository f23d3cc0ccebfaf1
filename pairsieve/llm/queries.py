"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontam, langid, lexical, mih, minhash, mixing, packing, pfp, pii, prefix_trie, quality, token_files, warc
from .common import read
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

VOCABULARY = "word_bpe_49k.json"


@query("op1_multi_index_hashing")
def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(read(spark, sf_dir, "documents"))


@query("op3_minhash")
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op7_prefix_free_parsing")
def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.report(read(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
w AS (SELECT x, max(page_id) AS holder FROM d GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(d.x, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = holder OR holder IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder OR holder IS NULL THEN NULL ELSE holder END AS refers_to
FROM d JOIN w USING (x)
"""


@query("op8_warc", WARC_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archive")
    warc.write_archive(read(spark, sf_dir, "pages"), folder)
    return warc.read_index(spark, folder)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return token_files.read_token_files(spark, folder)


@query("op11_sainte_lague_mix", mixing.MIX_SQL)
def op11_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op12_prefix_trie", prefix_trie.TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


@query("op13_lexical_search", lexical.SEARCH_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
