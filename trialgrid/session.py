"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

# Settings the library's results depend on (not tuning): UTC for the
# HH:MM:SS texts, case-insensitive names (the reference reads `frames.p`
# for the field `P`), ANSI mode so bad casts and zero divisors fail loudly.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.ansi.enabled": "true",
    # Rows that go to Python may hold long texts: fewer of them at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

# Tuning for scale: AQE re-plans joins from runtime sizes, coalesces small
# shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "trialgrid", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("TRIALGRID_DRIVER_MEMORY", "8g")))
    for key, value in {**SCALE_CONF, **REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's `spark.checkpoint.dir` wins. Only a local master (tests) may
    leave it unset: driver and executors are then one machine and a scratch
    folder of our own is visible to all of them. On any other master a folder
    picked here would be machine-local, so an unset one is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set on master {master}: "
                               "name a folder that every executor shares")
        current = tempfile.mkdtemp(prefix="trialgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster) for tables written to cut lineage. The name carries the
    application id and a random id, so that no other driver, restarted or
    concurrent, gets the same folder. Write to it with mode `errorifexists`;
    the whole application folder can go once the application has ended."""
    app = re.sub(r"[^A-Za-z0-9_.-]", "_", spark.sparkContext.applicationId)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/trialgrid-{app}/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied_shuffles(spark: SparkSession):
    """The shuffle files of what is run in the block go as soon as it has run,
    instead of when the driver's memory is next cleaned."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, compression: str = "snappy", tidy: bool = False) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: cuts
    the lineage and lets several readers share one computation. With `tidy`
    the shuffle files of the computation go as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidied_shuffles(spark) if tidy else nullcontext():
        df.write.mode("errorifexists").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_table(df: DataFrame, name: str, compression: str = "zstd", by: list[str] | None = None):
    """`written`, for as long as the block runs: the table is removed at its
    end. Rows that differ in the last columns, `by`, lie in different folders."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidied_shuffles(spark):
        df.write.mode("errorifexists").option("compression", compression).partitionBy(*by or []).parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove the folder `path`, by its own file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def last_version(spark: SparkSession, path: str) -> int | None:
    """Number of the last folder `path/version=N` that was written whole (it
    has a success marker), looked up by the path's own file system."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS")) or []
    return max((int(s.getPath().getParent().getName().split("=")[1]) for s in found), default=None)
