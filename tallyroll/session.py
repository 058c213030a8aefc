"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tallyroll", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALLYROLL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on, plus skew handling; all can change at run time.

    Python workers on this machine find the package from any working folder; elsewhere it must be installed.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Only a local session without that setting falls back to the machine's own temporary folder, which goes
    when the interpreter ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        own = tempfile.TemporaryDirectory(prefix="tallyroll-", ignore_cleanup_errors=True)
        context._tallyroll_scratch = own  # kept as long as the context
        context.setCheckpointDir(own.name)
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    It cuts the lineage, survives lost executors, and every later pass sees the same rows. Joins of stored
    tables are plain shuffles, whose skewed partitions adaptive execution can split.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores by a hash of their columns, for work that costs far more than reading them.

    A scan has at most one working task per row group, and few of them where the rows are small.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def _files(spark: SparkSession, path: str):
    """The path and its file system, as Spark's own readers reach it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    where, system = _files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package has written."""
    where, system = _files(spark, path)
    system.delete(where, True)
