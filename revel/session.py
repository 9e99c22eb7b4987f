"""Session defaults and the shared scratch / checkpoint folder.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by
whoever launches the job).  Only when it is unset -- local runs and tests --
do we pick a folder of our own and register it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "revel", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    In local mode the executors live in the driver JVM, so ``driver_memory``
    is the memory of the whole engine (the JVM default is only 1 GB)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # delete checkpoint files once nothing references them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering a local one only if unset
    and the master is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="revel-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for staged outputs."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex[:12]}"


def materialized(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: it
    cuts the lineage like a checkpoint, and Spark knows the bytes of what it
    reads, so it can choose joins by them."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_input(spark: SparkSession, key: tuple, write) -> str:
    """Path of a raw input derived from the given tables: ``write(path)`` fills
    a fresh folder (the raw inputs of the reference's scripts are given files)."""
    path = f"{scratch_dir(spark, 'input-' + str(key[0]))}/data"
    write(path)
    return path
