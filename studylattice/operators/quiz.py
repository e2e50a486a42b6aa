"""Question bank, quiz drawing, grading and the attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylattice import constants as K
from studylattice.functions import rules
from studylattice.plans.ordered import with_running_sums

STRATUM = ["subject", "difficulty"]
OPTIONS = ["option1", "option2", "option3", "option4"]


def question_bank(raw: DataFrame) -> DataFrame:
    """Bank with title-case subject and level, and the options as one array."""
    return raw.withColumns(
        {
            "subject": rules.title_case(F.col("subject")),
            "difficulty": rules.title_case(F.col("difficulty")),
            "options": F.array(*OPTIONS),
        }
    ).drop(*OPTIONS)


def question_bank_counts(bank: DataFrame) -> DataFrame:
    return bank.groupBy(*STRATUM).agg(F.count("*").alias("questions"))


def quiz_sample(bank: DataFrame, seed: int = K.MODEL_SEED, size: int = K.QUESTIONS_PER_QUIZ) -> DataFrame:
    """Up to ``size`` questions of every stratum, drawn without replacement.

    A seeded hash orders the questions, so a seed always draws the same quiz; the per-group
    limit is applied before the shuffle.
    """
    draw = F.md5(F.concat_ws(":", F.col("question_id").cast("string"), F.lit(str(seed))))
    order = Window.partitionBy(*STRATUM).orderBy(draw, "question_id")
    return (
        bank.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= size)
        .select(*STRATUM, F.col("place").cast("bigint").alias("place"), "question_id", "question")
    )


def grade_responses(responses: DataFrame, bank: DataFrame) -> DataFrame:
    """Correct answers and questions asked per sitting. An answer counts when it equals the
    key exactly; a question the bank does not know is asked all the same, and never right. Spark
    broadcasts the bank only if its size allows."""
    graded = responses.join(bank.select("question_id", "answer"), "question_id", "left")
    return graded.groupBy("session_id").agg(
        F.count_if(F.col("choice") == F.col("answer")).cast("int").alias("score"),
        F.count("*").cast("int").alias("total"),
    )


def attempt_numbering(attempts: DataFrame) -> DataFrame:
    """Number every attempt of a (user, subject) in log order, levels mixed. Runs a job."""
    return _numbered(attempts.withColumn("subject_key", subject_key()), F.lit(1))


def subject_key() -> Column:
    """What attempts are numbered by, with the user."""
    return rules.title_case(F.col("subject"))


def _numbered(rows: DataFrame, step: Column) -> DataFrame:
    order = [F.col("log_pos").asc_nulls_first()]
    numbered = with_running_sums(rows, ["user_id", "subject_key"], order, {"number": step}, F.col("log_pos"))
    return numbered.withColumn("attempt_no", F.col("number").cast("int")).drop("number", "subject_key")


def finished_attempts(sessions: DataFrame, grades: DataFrame) -> DataFrame:
    """Log rows, not numbered yet, for the graded sittings."""
    seconds = _seconds(F.col("finished_at") - F.col("started_at"))
    return sessions.filter(valid_user(F.col("user_id"))).join(grades, "session_id").select(
        F.col("session_id").alias("log_pos"),
        _whole_seconds(F.col("finished_at")).alias("attempt_ts"),
        F.col("user_id").cast("bigint").alias("user_id"),
        "subject",
        "difficulty",
        "score",
        "total",
        basename(F.col("dataset_path")).alias("dataset"),
        rules.half_even(rules.settled(seconds / 60.0), 2).alias("time_spent_mins"),
    )


def _whole_seconds(moment: Column) -> Column:
    second = F.extract(F.lit("SECOND"), moment)
    return moment - F.make_dt_interval(secs=second - F.floor(second))


def _seconds(span: Column) -> Column:
    """Length of an interval; unlike a timestamp difference it knows no time zone."""
    parts = (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))
    return sum((F.extract(F.lit(part), span).cast("double") * size for part, size in parts), F.lit(0.0))


def valid_user(user: Column) -> Column:
    """User ids are digits only."""
    return user.cast("string").rlike("^[0-9]+$")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def continue_numbering(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Number a batch so that it continues the log's count per (user, subject). Runs a job.

    The log is reduced to one count per key of the batch. That count enters the running sum as
    a row before the batch's first, so the batch itself is not joined to anything. Instead of
    the log, the stream's running cells will do; they save reading it.
    """
    keyed = batch.withColumn("subject_key", subject_key())
    n = F.sum("attempts") if "attempts" in log.columns else F.count("*")
    so_far = (
        log.groupBy("user_id", subject_key().alias("subject_key"))
        .agg(n.alias("step"))
        .join(keyed.select("user_id", "subject_key").distinct(), ["user_id", "subject_key"], "left_semi")
        .withColumn("from_log", F.lit(True))
    )
    rows = keyed.withColumns({"step": F.lit(1).cast("bigint"), "from_log": F.lit(False)})
    together = rows.unionByName(so_far, allowMissingColumns=True)
    return _numbered(together, F.col("step")).filter("not from_log").drop("step", "from_log")


def combine_logs(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both logs, the second after the first in log order; a column one of them
    lacks becomes NULL there."""
    end = F.coalesce(first.agg(F.max("log_pos")).scalar(), F.lit(-1))
    follow = second.withColumn("log_pos", (F.col("log_pos") + end + 1).cast("bigint"))
    return first.unionByName(follow, allowMissingColumns=True)


def attempts_filter(
    attempts: DataFrame,
    user_id: int | None = None,
    subject: str | None = None,
    difficulty: str | None = None,
) -> DataFrame:
    """Attempts matching every given value; plain equalities reach the scan."""
    wanted = {"user_id": user_id, "subject": subject, "difficulty": difficulty}
    for column, value in wanted.items():
        if value is not None:
            attempts = attempts.filter(F.col(column) == value)
    return attempts


def filter_domains(attempts: DataFrame) -> DataFrame:
    """Distinct users, subjects and levels, sorted, from one scan."""
    seen = attempts.select("user_id", "subject", "difficulty").distinct()
    entry = F.explode(
        F.array(
            F.struct(F.lit("user").alias("domain"), F.col("user_id").cast("string").alias("value"), F.col("user_id").alias("number")),
            F.struct(F.lit("subject").alias("domain"), F.col("subject").alias("value"), F.lit(None).cast("bigint").alias("number")),
            F.struct(F.lit("difficulty").alias("domain"), F.col("difficulty").alias("value"), F.lit(None).cast("bigint").alias("number")),
        )
    )
    rows = seen.select(entry.alias("e")).select("e.*").filter("value is not null").distinct()
    return rows.orderBy("domain", "number", "value").select("domain", "value")
