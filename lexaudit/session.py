"""Spark session helpers: a local session for tests/bench, and the checkpoint
folder rule (use the cluster's ``spark.checkpoint.dir``; only a local session
without one gets a scratch folder)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "lexaudit") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEXAUDIT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system). Only a local-mode session without that setting gets a fresh
    scratch folder, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/...) so that checkpoints survive executor loss")
    folder = tempfile.mkdtemp(prefix="lexaudit-ckpt-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder). The shuffle
    files of its plan go as soon as it is written (``_FILE_CLEANUP``): nothing
    reads them again, but without that they stay until the driver happens to
    collect its garbage, so a job of many checkpoints would hold those of all.
    The setting holds for plans made after it, hence the ``select``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_FILE_CLEANUP, "false")
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_FILE_CLEANUP, before)


_KEY_TRACING = ("spark.sql.constraintPropagation.enabled", "spark.sql.optimizer.dynamicPartitionPruning.enabled")


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read
    back. The lineage is cut as by a checkpoint, the last stage runs once, and
    later joins know the size of the table, so that Spark broadcasts it only
    where it is small. ``by``: a column whose hash buckets the table is kept
    in, so that joins and aggregates by it need no exchange. The table goes
    when the application ends.

    While the table is written, Spark does not follow join keys and filters
    down through projections (``_KEY_TRACING``): over the staged projections
    of the URL rules that substitutes expressions into each other, their size
    grows exponentially, and planning takes longer than the work."""
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    before = {key: spark.conf.get(key) for key in _KEY_TRACING}
    for key in _KEY_TRACING:
        spark.conf.set(key, "false")
    try:
        if by is None:
            df.write.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
        else:
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
            out = spark.table(name)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return out
