"""Corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back for the next.

1. quality: documents that the classifier rejects go. It learns from the
   labels of all documents outside the held-out fold; without labels nothing
   is rejected.
2. near_duplicates: the smallest doc_id of each group of near copies stays;
   of rows with equal ids and texts one stays. Rows without an id stay.
3. decontamination: documents that hold a benchmark item go.
4. personal_data: spans are replaced by their kind in brackets; n_chars follows.
5. packing: pieces of training sequences.

Texts go to Python in batches of ``BATCH_ROWS`` rows; the session keeps that
setting, as the results are computed by whoever reads or writes them.

Nulls, empty texts, repeated rows, empty tables and further columns: as stated
by each operator. Stages 1 to 4 return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.llm import decontam, minhash, packing, pii, quality
from pairsieve.llm.common import few_rows_a_batch, read, written
from pairsieve.llm.idfilter import without_ids

VOCABULARY = "word_bpe_49k.json"

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the threshold."""
    few_rows_a_batch(spark)
    labels = read(spark, sf_dir, "labels")
    model = quality.learn(quality.sample_statistics(docs, labels), labels)
    return quality.good_rows(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    few_rows_a_batch(spark)
    judged = written(minhash.judged(docs), "near-duplicates")
    again = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL")
    if again.isEmpty():
        return without_ids(docs, judged.where(~F.col("kept")).select("doc_id"))
    # rows with a repeated id: each by its own text, one of each text
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text_key")).distinct()
    single = without_ids(docs, gone.select("_gone").unionByName(again.select(F.col("doc_id").alias("_gone"))))
    repeated = docs.join(again.select(F.col("doc_id").alias("_again")), docs["doc_id"].cast("long") == F.col("_again"), "left_semi")
    own = (F.col("doc_id").cast("long") == F.col("_gone")) & (minhash.text_key(F.col("text")) == F.col("_text_key"))
    return single.unionByName(repeated.join(gone, own, "left_anti").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    few_rows_a_batch(spark)
    found = decontam.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return without_ids(docs, written(found.select("doc_id").distinct(), "leaks"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced."""
    clean = pii.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    few_rows_a_batch(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_classifier", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
