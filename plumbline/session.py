"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SMALL_ROWS_CONF = "plumbline.smallRows"
BROADCAST_BYTES_CONF = "plumbline.broadcastBytes"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "plumbline") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir`` if there is one.

    Only a local session may fall back to a temporary folder; executors of a cluster could not see it.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: no lineage, survives lost executors,
    and the scan carries file sizes for the planner."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(spark: SparkSession) -> int:
    """Row count up to which one task may hold a whole ordered group."""
    return int(spark.conf.get(SMALL_ROWS_CONF, "1000000"))


def broadcast_bytes(spark: SparkSession) -> int:
    """Largest payload that may be shipped to every executor."""
    return int(spark.conf.get(BROADCAST_BYTES_CONF, str(64 * 1024 * 1024)))
