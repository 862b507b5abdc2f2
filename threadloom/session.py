"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "threadloom", cores: int | str = "*", shuffle_partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.appName(app).master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
    )
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared folder; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="threadloom-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` spread over all shuffle partitions by columns that tell rows apart.

    After joins the adaptive plan keeps as few partitions as their bytes ask for; costly work on each row needs more of them.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def dealt_to(df: DataFrame, least: int, *by: str) -> DataFrame:
    """As :func:`dealt`, over ``least`` partitions at least, up to ten thousand."""
    spark = df.sparkSession
    return df.repartition(max(min(least, 10_000), int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut_lineage`, in columns: for wide tables of which readers take a few columns each."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
