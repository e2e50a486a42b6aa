"""The learning tables as views over the star-schema test tables.

Every binding keeps all rows of the table it reads. Order columns are built so that they stay
unique at any size: the log position is a fixed shuffle of the event ids, and positions inside
a course or request are structs of the line's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SUBJECT_OF_EVENT = {
    "click": "Maths",
    "view": "Science",
    "purchase": "Social Studies",
    "signup": "English",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(code) -> F.Column:
    return F.when(code == 0, "Easy").when(code == 1, "Intermediate").otherwise("Hard")


def as_attempts(events: DataFrame) -> DataFrame:
    """Events read as quiz attempts. Log order differs from time order on purpose; the event
    type without a subject becomes ``Other``, a subject outside the weight table."""
    kind = F.col("event_type")
    subject = F.lit("Other")
    for event, name in reversed(_SUBJECT_OF_EVENT.items()):
        subject = F.when(kind == event, name).otherwise(subject)
    drawn = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    return drawn.select(
        F.expr(f"event_id % 31 * {1 << 50} + event_id div 31").alias("log_pos"),
        F.col("ts").alias("attempt_ts"),
        "user_id",
        subject.alias("subject"),
        _level(F.col("k") % 3).alias("difficulty"),
        (F.floor(F.col("k") / 3).cast("int") % 6).alias("score"),
        F.lit(5).alias("total"),
        F.lit("events").alias("dataset"),
        (F.col("value") / 10.0).alias("time_spent_mins"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_attempts(table(spark, sf_dir, "events"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as multiple-choice questions; the answer is always among the options."""
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    option = [F.concat(F.lit("Brand#"), ((brand - 1 + step) % 25 + 1).cast("string")) for step in (0, 7, 11, 18)]
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"),
        F.col("p_type").alias("subject"),
        _level(F.col("p_size") % 3).alias("difficulty"),
        F.col("p_name").alias("question"),
        *[column.alias(f"option{i}") for i, column in enumerate(option, start=1)],
        F.col("p_brand").alias("answer"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as quiz sittings."""
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    subject = F.element_at(
        F.array(*[F.lit(s) for s in ("Maths", "Science", "Social Studies", "English", "Other")]), rank
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        subject.alias("subject"),
        _level(F.col("o_orderkey") % 3).alias("difficulty"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_totalprice / 100.0D)")).alias("finished_at"),
        F.lit("banks/part.parquet").alias("dataset_path"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as answers given in a sitting."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    guess = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_partkey").alias("question_id"),
        F.when(F.col("l_returnflag") == "A", F.col("p_brand")).otherwise(guess).alias("choice"),
    )


def _line_position() -> F.Column:
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def _line_name(prefix: str) -> F.Column:
    return F.concat(
        F.lit(prefix),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as the assignments of a course (their order)."""
    done = F.col("l_linestatus") == "F"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("course_id"),
        _line_position().alias("pos"),
        _line_name("A").alias("assignment_name"),
        F.col("l_quantity").alias("weight"),
        F.when(done, 100.0 - 500.0 * F.col("l_discount")).alias("grade"),
        F.when(done & (F.col("l_returnflag") != "R"), 1.0 + 100.0 * F.col("l_tax")).alias("study_hours"),
        done.alias("completed"),
    )


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("course_id"),
        F.col("o_custkey").alias("user_id"),
        F.lit(3.0).alias("credits"),
        (60.0 + 8.0 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("target"),
        (F.lit(1.0) + F.col("o_custkey") % 40).alias("available_hours"),
    )


def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as the subjects of a study-plan request (their order)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        _line_position().alias("pos"),
        _line_name("Subject ").alias("name"),
        (F.col("l_partkey") % 5 + 1).cast("int").alias("priority"),
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("difficulty_level"),
        ((F.col("l_linenumber") % 4) * 0.5).alias("min_hours"),
        (F.lit(2.0) + F.col("l_orderkey") % 9).alias("total_hours"),
    )
