"""Results store: a Parquet table partitioned by phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("sample_key", T.StringType()),
        T.StructField("strategy", T.StringType()),
        *[
            T.StructField(n, T.DoubleType())
            for n in (
                "storage_noise_r", "storage_rate_nu", "wait_time_ns", "channel_fidelity", "detection_efficiency", "detector_error", "dark_count_prob",
            )
        ],
        T.StructField("num_pairs", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("net_efficiency", T.DoubleType()),
        T.StructField("raw_key_length", T.LongType()),
        T.StructField("final_key_length", T.LongType()),
        T.StructField("qber_measured", T.DoubleType()),
        T.StructField("reconciliation_efficiency", T.DoubleType()),
        T.StructField("leakage_bits", T.LongType()),
        T.StructField("phase", T.StringType()),
    ]
)


def new_store(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, f"results-{label}")


def conform(df: DataFrame) -> DataFrame:
    """Exactly the columns of the store; a missing key column is derived from ``sample_id``."""
    if "sample_key" not in df.columns:
        df = df.withColumn("sample_key", F.md5(F.concat(F.lit("id:"), F.col("sample_id").cast("string"))))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA])


def append_results(df: DataFrame, path: str) -> None:
    """Add a batch. Parquet commits a job as a whole, so a failed batch leaves nothing behind."""
    conform(df).write.mode("append").partitionBy("phase").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All phases; an empty store gives no rows."""
    try:
        return spark.read.schema(RESULT_SCHEMA).parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RESULT_SCHEMA)


def read_phase(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """One phase; only its folder is listed and read."""
    return read_results(spark, path).where(F.col("phase") == phase)


def remaining(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples without a result yet (restart without repeating work)."""
    return samples.join(done.select("sample_key"), "sample_key", "left_anti")


def write_bucketed(df: DataFrame, label: str, keys: list[str], buckets: int) -> str:
    """A table bucketed and sorted by ``keys`` under the shared folder: joins on them need no shuffle. Returns its name."""
    path = scratch_path(df.sparkSession, label)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    # rows of a bucket meet in one task before they are written, so a bucket is one file
    rows = df.repartition(buckets, *keys)
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(table)
    return table
