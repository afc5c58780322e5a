"""Session helpers: checkpoint folder, lineage cutting, table loading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


def build_session(app: str = "chunkloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; for tests and the command line."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir`` of the session where set.

    Only where the cluster names none (tests, local mode) a temporary folder is used.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="chunkloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; a temporary folder is left to the system
        pass


def _root(spark: SparkSession) -> str:
    """The application's folder for written tables, removed when its driver ends."""
    root = f"{ensure_checkpoint_dir(spark)}/chunkloom-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read back.

    A written table is evaluated once (``checkpoint()`` computes its last stage twice), is read by column,
    and outlives the loss of any executor.  The application's tables are removed when its driver ends.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_at = path
    return written


def cut_bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """As :func:`cut_lineage`, in ``parts`` buckets by ``key``: groupings and cogroups by it shuffle nothing.

    Spark uses the buckets where there are at least as many as it has shuffle partitions.  The table is known to
    the session's catalog under a random name until it is released.
    """
    spark = df.sparkSession
    name = f"chunkloom_{uuid.uuid4().hex}"
    path = f"{_root(spark)}/{name}"
    df.write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    written = spark.table(name)
    written._written_at = path
    written._table = name
    return written


def release(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, and the shuffle files of finished steps.

    Spark drops the files of a shuffle once the driver has forgotten it, so the driver collects its garbage.
    """
    for df in tables:
        if hasattr(df, "_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        _remove(df.sparkSession, df._written_at)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it has fewer partitions than there are; a large table stays as it is read."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
