"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill
in settings that are unset (tests and local runs) and never override the
cluster's choices.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the session does not define them already.
_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods above the JIT's 8000-byte limit run interpreted and
    # are several times slower than the non-fused fallback: fall back early.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Broadcast only the bounded dimension sides we mark explicitly; never let
    # a large side slip into an automatic broadcast on a cluster.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sparkaudit") -> SparkSession:
    """The active session, or one built from the submitted configuration.

    Defaults fill in only what the submitted configuration leaves unset; the
    number of shuffle partitions and the memory are the caller's or the
    cluster's choice.  Only a local session gets a checkpoint folder of its own.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    given = SparkConf()  # what spark-submit and the environment set
    master = master or given.get("spark.master", None) or os.environ.get("SPARKAUDIT_MASTER", "local[*]")
    builder = SparkSession.builder.appName(app_name).master(master)
    wanted = dict(_LOCAL_DEFAULTS)
    if master.startswith("local["):
        wanted["spark.driver.memory"] = os.environ.get("SPARKAUDIT_DRIVER_MEMORY", "8g")
        wanted["spark.checkpoint.dir"] = os.path.join(tempfile.gettempdir(), "sparkaudit-checkpoints")
        wanted["spark.sql.shuffle.partitions"] = "8"
    for k, v in wanted.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Unset, a local session gets a folder of its own; any other one is refused,
    as executors would each write to their own disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sparkaudit-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder.

    Spark removes a checkpoint that nothing refers to any more if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Unlike a checkpoint, which computes its last stage twice, every row is computed once; the folder stays
    until the checkpoint folder is cleared.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when the action ends, and Parquet is written with zstd.

    For operators of many passes over one large table, each of which writes what it leaves: otherwise all passes'
    shuffle files lie on the disks together until the driver happens to collect garbage.  Settings are put back.
    """
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
