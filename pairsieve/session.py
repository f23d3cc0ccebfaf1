"""Session helpers: settings, shared scratch folder, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "pairsieve", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs are written for.

    On a cluster pass no ``master``: the submit command decides, and
    ``spark.checkpoint.dir`` must name a folder every executor can reach.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the workers, once per Spark context.

    Functions that run in tasks are found there by their module, wherever the
    driver was started from. A test session on one machine gets it the same way.
    """
    context = spark.sparkContext
    if getattr(context, "_pairsieve_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "pairsieve_package.zip")  # the driver's own copy, served by Spark
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "pairsieve")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._pairsieve_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; without that a cluster
    job fails here. Only a session on one machine, where every task sees the
    same disk, sets a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    known = getattr(spark, "_pairsieve_dir", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._pairsieve_dir = known
    return known


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return os.path.join(shared_dir(spark), "pairsieve", spark.sparkContext.applicationId)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results read from them must be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder, for this application; ``drop_scratch`` removes them all."""
    ship_package(spark)
    return os.path.join(run_dir(spark), f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    For intermediate tables that several later steps read: they are computed
    once, and a lost executor costs a re-read instead of a recomputation.
    Steps that filter by the column ``by`` read their part only.
    """
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the plan of an iterative job: written to the shared folder, read back.

    Compared with ``checkpoint()`` the next round sees true sizes, so small
    sides are found small by the optimizer, and no constraints of earlier
    rounds pile up in its plan (they grow with every round otherwise).
    """
    return written(df, "round")
