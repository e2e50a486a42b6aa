"""The newest row of every key, written by micro-batches: state that is read in batch.

Every micro-batch owns a folder with the rows it changed; run again after a failure, it overwrites its own. The
first batch of every generation of GENERATION batches also writes all other rows, so a reader needs the newest whole
generation only, and older ones go. KEPT of them stay for readers that began earlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATION = 16
KEPT = 2


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(generation, batch) of every folder that a batch has finished."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/generation=*/batch_id=*/_SUCCESS")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getParent() for status in files.globStatus(pattern) or []]
    return sorted((int(n.getParent().getName().split("=")[1]), int(n.getName().split("=")[1])) for n in names)


def start(spark: SparkSession, path: str, schema) -> None:
    """An empty state, unless there is one."""
    if not _folders(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/generation=-1/batch_id=-1")


def newest(spark: SparkSession, path: str, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """The newest row of every key, of the batches before one if it is given. Lists the folders, runs no job."""
    folders = [f for f in _folders(spark, path) if before is None or f[1] < before]
    last = folders[-1][0]
    paths = [f"{path}/generation={g}/batch_id={b}" for g, b in folders if g == last]
    rows = spark.read.option("basePath", path).parquet(*paths)
    facts = [c for c in rows.columns if c not in (*keys, "generation", "batch_id")]
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*facts), "batch_id").alias("f")).select(*keys, "f.*")
    )


def save(changed: DataFrame, path: str, keys: Sequence[str], batch_id: int) -> None:
    """Write what a batch changed; the first batch of a generation takes all other rows along, and generations
    that no reader needs go. Runs a job."""
    spark, generation = changed.sparkSession, max(batch_id, 0) // GENERATION
    if generation and batch_id % GENERATION == 0:
        older = newest(spark, path, keys, batch_id)
        same = [older[k].eqNullSafe(changed[k]) for k in keys]
        changed = changed.unionByName(older.join(changed, same, "left_anti"))
    changed.write.mode("overwrite").parquet(f"{path}/generation={generation}/batch_id={batch_id}")
    for old in sorted({g for g, _ in _folders(spark, path)}):
        if old < generation - KEPT:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={old}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
