"""Session set-up and the shared folder used for checkpoints, sinks and stream state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("studylattice")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    allow_skewed_joins(spark)
    return spark


def allow_skewed_joins(spark: SparkSession) -> None:
    """Settings the plans rely on when one key holds a large part of the rows: joins split
    such a key over several tasks, even where that costs one more small shuffle after it."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def package_for_workers(spark: SparkSession) -> None:
    """Let Python workers find this package wherever the driver was started."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back
    to a temporary folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    current = context.getCheckpointDir()
    if named is None and current is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="studylattice-")
    if current is None:
        context.setCheckpointDir(named)
    return named or current


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path under the shared folder; it goes when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder: later reads see the same rows even if
    executors are lost and upstream stages run again. Runs a job."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
