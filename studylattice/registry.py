"""Every operator as a query over the test tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylattice.operators import gap, grades, groups, leaderboard, planner, quiz, revision
from studylattice.session import allow_skewed_joins, checkpointed, fresh_dir
from studylattice.sources import bindings, files, schemas
from studylattice.streaming import attempt_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Decimals kept of double columns, so that two engines' last bits do not matter.
SHOWN_DIGITS = 6


def shown(df: DataFrame) -> DataFrame:
    scale = F.lit(10.0**SHOWN_DIGITS)
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = (F.rint(column * scale) / scale + F.lit(0.0)).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def query(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        allow_skewed_joins(spark)
        return shown(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


def _over_attempts(operator: Callable[[DataFrame], DataFrame]) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(bindings.attempts(spark, sf_dir))

    build.__name__ = operator.__name__
    query(build)


def _over_courses(operator: Callable[..., DataFrame], with_courses: bool) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = [bindings.assignments(spark, sf_dir)]
        if with_courses:
            inputs.append(bindings.courses(spark, sf_dir))
        return operator(*inputs)

    build.__name__ = operator.__name__
    query(build)


for _operator in (
    leaderboard.difficulty_weights,
    leaderboard.weighted_score,
    leaderboard.subject_leaderboard,
    leaderboard.overall_leaderboard,
    leaderboard.progress_leaderboard,
    leaderboard.top_improved,
    leaderboard.platform_kpis,
    leaderboard.subject_participation,
    leaderboard.difficulty_distribution,
    gap.gap_weighted_score,
    gap.gap_forecast,
    gap.gap_micro_trend,
    gap.gap_reason,
    gap.gap_difficulty_context,
    gap.gap_scores,
    gap.gap_score_path,
    gap.gap_most_improved,
    gap.gap_percentile,
    revision.training_set_fallback,
    revision.score_percent,
    revision.ideal_interval,
    revision.performance_label,
    revision.revision_summary,
    revision.revision_recommendations,
    revision.difficulty_label_encode,
    revision.recent_attempts,
    revision.revision_plan,
    quiz.filter_domains,
    groups.student_profiles,
):
    _over_attempts(_operator)

for _operator in (grades.course_grades, grades.grade_trend, grades.course_progress, grades.course_weight_check):
    _over_courses(_operator, with_courses=False)

for _operator in (
    grades.required_scores,
    grades.goal_status,
    grades.study_time_allocation,
    grades.grade_insights,
    grades.grade_series,
    grades.letter_grade,
    grades.weighted_gpa,
):
    _over_courses(_operator, with_courses=True)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.student_profiles(bindings.attempts(spark, sf_dir))


def _kept_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles, one row per user, kept because the operators below read them several times."""
    return checkpointed(_profiles(spark, sf_dir))


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.question_bank(bindings.questions(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered attempts with only the columns the revision features read."""
    log = bindings.attempts(spark, sf_dir).drop("attempt_ts", "dataset")
    return quiz.attempt_numbering(log)


def _new_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = quiz.grade_responses(bindings.responses(spark, sf_dir), _bank(spark, sf_dir))
    return quiz.finished_attempts(bindings.sessions(spark, sf_dir), graded)


@query
def attempts_scan(spark, sf_dir):
    return bindings.attempts(spark, sf_dir)


@query
def attempts_csv_scan(spark, sf_dir):
    """Numbered attempts written as a CSV log and read back by header."""
    path = fresh_dir(spark, "attempts-csv")
    files.write_attempts_csv(quiz.attempt_numbering(bindings.attempts(spark, sf_dir)), path)
    return files.read_attempts_csv(spark, path)


@query
def attempts_filter(spark, sf_dir):
    return quiz.attempts_filter(bindings.attempts(spark, sf_dir), subject="Maths", difficulty="Hard")


@query
def attempt_numbering(spark, sf_dir):
    log = bindings.attempts(spark, sf_dir).select("log_pos", "user_id", "subject")
    return quiz.attempt_numbering(log)


@query
def question_bank_scan(spark, sf_dir):
    return _bank(spark, sf_dir).withColumn("options", F.array_join("options", "|"))


@query
def question_bank_csv_scan(spark, sf_dir):
    """The bank written as CSV in the order of its file format and read back."""
    path = fresh_dir(spark, "bank-csv")
    files.write_csv(bindings.questions(spark, sf_dir).select(*schemas.QUESTION_HEADER), path)
    bank = quiz.question_bank(files.read_questions_csv(spark, path))
    return bank.withColumn("options", F.array_join("options", "|"))


@query
def question_bank_counts(spark, sf_dir):
    return quiz.question_bank_counts(_bank(spark, sf_dir))


@query
def quiz_sample(spark, sf_dir):
    return quiz.quiz_sample(_bank(spark, sf_dir))


@query
def grade_responses(spark, sf_dir):
    return quiz.grade_responses(bindings.responses(spark, sf_dir), _bank(spark, sf_dir))


@query
def log_attempts(spark, sf_dir):
    """Graded sittings numbered after the existing log, appended to a log as a batch and read back."""
    path = fresh_dir(spark, "attempt-log")
    batch = quiz.continue_numbering(_new_attempts(spark, sf_dir), bindings.attempts(spark, sf_dir))
    files.append_attempts(batch, path, "sittings")
    return files.read_attempt_log(spark, path)


@query
def combine_logs(spark, sf_dir):
    return quiz.combine_logs(bindings.attempts(spark, sf_dir), _new_attempts(spark, sf_dir))


@query
def fallback_features(spark, sf_dir):
    return revision.fallback_features(_numbered(spark, sf_dir))


@query
def revision_schedule(spark, sf_dir):
    return revision.revision_schedule(revision.revision_plan(bindings.attempts(spark, sf_dir)))


@query
def export_schedule_csv(spark, sf_dir):
    """The revision schedule written as CSV and read back."""
    rows = revision.revision_schedule(revision.revision_plan(bindings.attempts(spark, sf_dir)))
    path = fresh_dir(spark, "schedule-csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query
def revision_interval_model(spark, sf_dir):
    return revision.revision_interval_model(_numbered(spark, sf_dir))


@query
def scaled_features(spark, sf_dir):
    return groups.scaled_features(_kept_profiles(spark, sf_dir))


@query
def cluster_k_selection(spark, sf_dir):
    return groups.cluster_k_selection(_kept_profiles(spark, sf_dir))


@query
def student_groups(spark, sf_dir):
    return groups.student_groups(_kept_profiles(spark, sf_dir))


@query
def group_members(spark, sf_dir):
    return groups.group_members(groups.student_groups(_kept_profiles(spark, sf_dir)))


@query
def compare_users(spark, sf_dir):
    """Every user compared with the user of the next id."""
    profiles = _kept_profiles(spark, sf_dir)
    pairs = profiles.select(F.col("user_id").alias("first_user"), (F.col("user_id") + 1).alias("second_user"))
    return groups.compare_users(profiles, pairs)


@query
def peer_recommendation(spark, sf_dir):
    return groups.peer_recommendation(_kept_profiles(spark, sf_dir))


@query
def peer_comparison(spark, sf_dir):
    return groups.peer_comparison(_kept_profiles(spark, sf_dir))


@query
def compare_users_with_groups(spark, sf_dir):
    """Every user with a group and their peer, with the groups of both."""
    profiles = _kept_profiles(spark, sf_dir)
    return groups.peer_comparison(profiles, checkpointed(groups.student_groups(profiles)))


@query
def revision_schedule_model(spark, sf_dir):
    """The schedule that follows the model's intervals."""
    return revision.revision_schedule(revision.revision_interval_model(_numbered(spark, sf_dir)))


@query
def completed_from_grade(spark, sf_dir):
    rows = grades.completed_from_grade(bindings.assignments(spark, sf_dir))
    return rows.select("course_id", "assignment_name", "grade", "completed")


def _plan_query(name: str, allocate: Callable[[DataFrame], DataFrame]) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = allocate(bindings.plan_items(spark, sf_dir))
        return plan.select("request_id", "name", "priority", "hours")

    build.__name__ = name
    query(build)


_plan_query("allocate_proportional", planner.allocate_proportional)
_plan_query("allocate_softmax", planner.allocate_softmax)
_plan_query("allocate_balanced", planner.allocate_balanced)


@query
def plan_summary(spark, sf_dir):
    return planner.plan_summary(planner.allocate_softmax(bindings.plan_items(spark, sf_dir)))


@query
def plan_shares(spark, sf_dir):
    return planner.plan_shares(planner.allocate_softmax(bindings.plan_items(spark, sf_dir)))


@query
def block_schedule(spark, sf_dir):
    return planner.block_schedule(planner.allocate_softmax(bindings.plan_items(spark, sf_dir)))


@query
def export_plan_csv(spark, sf_dir):
    """The balanced plan written as CSV and read back."""
    plan = planner.allocate_balanced(bindings.plan_items(spark, sf_dir))
    rows = plan.select("request_id", F.col("name").alias("subject"), "hours", "priority")
    path = fresh_dir(spark, "plan-csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query
def attempts_stream(spark, sf_dir):
    """The subject leaderboard from the state of the streamed log."""
    # The pattern also takes a table that is one file.
    events = spark.readStream.schema(schemas.EVENTS).parquet(f"{sf_dir}/event[s].parquet")
    state = fresh_dir(spark, "stream-state")
    attempt_log.run_available(bindings.as_attempts(events), state, fresh_dir(spark, "stream-checkpoint"))
    return leaderboard.subject_leaderboard(attempt_log.read_cells(spark, state))
