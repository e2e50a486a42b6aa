"""The attempt log as a stream: running facts per (user, subject, level), and numbered attempts.

The facts are raw (best score, attempts, passes, fails) because weights change
with every attempt and apply to old attempts too; weights are joined when the state is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylattice.functions import rules
from studylattice.operators import leaderboard, quiz
from studylattice.session import checkpointed
from studylattice.sources import files
from studylattice.streaming import generations

CELL = ["user_id", "subject", "difficulty"]
COUNTED = ["user_id", "subject"]
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_cells(attempts: DataFrame) -> DataFrame:
    """The aggregation itself; works on a stream and on a table alike."""
    good = rules.passed()
    return attempts.groupBy(*CELL).agg(
        F.max("score").alias("score"),
        F.count("score").alias("attempts"),
        F.count_if(good).alias("passes"),
        F.count_if(~good).alias("fails"),
    )


def run_available(attempts: DataFrame, state_path: str, checkpoint_path: str) -> None:
    """Process everything the streaming ``attempts`` has and stop. Runs a streaming query.

    Every micro-batch saves the cells it changed (see ``generations``). A batch that is run again after a
    failure overwrites its own, so nothing is counted twice.
    """
    cells = running_cells(attempts)
    spark = attempts.sparkSession
    # A log without any attempt yet has a state too, an empty one.
    generations.start(spark, state_path, cells.schema)

    def save(changed: DataFrame, batch_id: int) -> None:
        generations.save(changed, state_path, CELL, batch_id)

    # On disk, because the number of cells grows with the users. The query keeps the setting it
    # is started with, so the session has its own back at once.
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, _ROCKSDB)
    try:
        query = (
            cells.writeStream.outputMode("update")
            .foreachBatch(save)
            .option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()


def read_cells(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest row of every cell, from the files of the newest generation."""
    return generations.newest(spark, state_path, CELL)


def number_available(attempts: DataFrame, log_path: str, counts_path: str, checkpoint_path: str) -> None:
    """Number everything the streaming ``attempts`` has after the attempts before it, append it to the log, and
    stop. Runs a streaming query.

    A micro-batch takes the counts of its (user, subject) keys from the batches before it, numbers
    its attempts in log order, appends them as a batch of that id, and saves the new counts of its keys. Run again after
    a failure, it finds the same counts, its rows enter the log once, and its counts overwrite their own.
    """
    spark = attempts.sparkSession
    generations.start(spark, counts_path, "user_id long, subject string, attempts long")

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = checkpointed(batch)
        counts = generations.newest(spark, counts_path, COUNTED, batch_id)
        files.append_attempts(quiz.continue_numbering(rows, counts), log_path, f"{batch_id:09d}")
        came = rows.select("user_id", quiz.subject_key().alias("subject")).groupBy(*COUNTED).agg(F.count("*").alias("came"))
        same = [came[k].eqNullSafe(counts[k]) for k in COUNTED]
        total = (came["came"] + F.coalesce(counts["attempts"], F.lit(0))).alias("attempts")
        changed = came.join(counts, same, "left").select(*[came[k] for k in COUNTED], total)
        generations.save(changed, counts_path, COUNTED, batch_id)

    query = (
        attempts.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def sketch_available(attempts: DataFrame, state_path: str, checkpoint_path: str) -> None:
    """Take everything the streaming ``attempts`` has into the sketches of the users of every subject, and stop.
    Runs a streaming query. Taking the same attempts in twice changes nothing."""
    spark = attempts.sparkSession
    generations.start(spark, state_path, "subject string, users binary")

    def save(batch: DataFrame, batch_id: int) -> None:
        before = generations.newest(spark, state_path, ["subject"], batch_id)
        came = checkpointed(leaderboard.user_sketches(batch))
        generations.save(leaderboard.merged_sketches(came, before), state_path, ["subject"], batch_id)

    query = (
        attempts.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_sketches(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest sketch of every subject."""
    return generations.newest(spark, state_path, ["subject"])
