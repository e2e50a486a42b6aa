"""Spaced repetition: performance summaries, revision intervals and schedules.

A *target* is a (user, subject, level). A target without attempts of its own falls back to
all of the user's attempts in the subject. Targets are built from one row per (user, subject,
level), so the fallback copies aggregates and not attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylattice import constants as K
from studylattice.functions import rules
from studylattice.plans import forests
from studylattice.plans.skew import join_totals
from studylattice.session import checkpointed

KEYS = ["user_id", "subject"]
TARGET = [*KEYS, "difficulty"]


def _per_level(attempts: DataFrame) -> DataFrame:
    """One row per (user, subject, level); mergeable aggregates over plain numbers."""
    percent, minutes = rules.score_percent(), F.col("time_spent_mins")
    numbered = "attempt_no" in attempts.columns
    number = (F.col("attempt_no") if numbered else F.lit(None)).cast("int")
    return attempts.groupBy(*TARGET).agg(
        F.count("*").alias("n"),
        F.count(percent).alias("percent_n"),
        F.sum(percent).alias("percent_sum"),
        F.count(minutes).alias("minutes_n"),
        F.sum(minutes).alias("minutes_sum"),
        F.max_by(percent, "log_pos").alias("latest_percent"),
        F.max_by(minutes, "log_pos").alias("latest_minutes"),
        F.max_by(number, "log_pos").alias("latest_attempt_no"),
        F.max(number).alias("max_attempt_no"),
    )


def _targets(attempts: DataFrame) -> DataFrame:
    """Every target with its own level's row (``own``), the rows of all its levels (``all``,
    one per level name) and ``is_prediction_mode``."""
    level = F.struct(*[F.col(c) for c in _per_level(attempts).columns if c not in KEYS])
    subjects = _per_level(attempts).groupBy(*KEYS).agg(F.array_sort(F.collect_list(level)).alias("all"))
    standard = F.array(*[F.lit(name) for name in K.LEVELS])
    target = F.explode(F.array_union(standard, F.array_compact("all.difficulty")))
    rows = subjects.select(*KEYS, target.alias("difficulty"), "all")
    own = F.filter("all", lambda r: r["difficulty"] == F.col("difficulty"))
    return rows.withColumn("own", F.get(own, F.lit(0))).withColumn(
        "is_prediction_mode", F.col("own").isNull()
    )


def _over(field: str) -> Column:
    """Sum of an aggregate over the target's training rows."""
    whole = F.aggregate(
        F.transform("all", lambda r: F.coalesce(r[field].cast("double"), F.lit(0.0))),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return F.when(F.col("is_prediction_mode"), whole).otherwise(
        F.coalesce(F.col(f"own.{field}").cast("double"), F.lit(0.0))
    )


def training_set_fallback(attempts: DataFrame) -> DataFrame:
    """Targets with the size of their training set, whether it is the fallback, and the levels
    the user has tried in the subject."""
    return _targets(attempts).select(
        *TARGET,
        "is_prediction_mode",
        _over("n").cast("bigint").alias("training_rows"),
        F.array_join(F.array_sort(F.array_compact("all.difficulty")), ", ").alias("available"),
    )


def revision_summary(attempts: DataFrame) -> DataFrame:
    """Mean score, attempts, mean minutes and label of every target."""
    return _summary(attempts).select(
        *TARGET, "is_prediction_mode", "avg_percent", "attempts", "avg_minutes", "performance"
    )


def _summary(attempts: DataFrame) -> DataFrame:
    rows = _targets(attempts).withColumns(
        {
            "avg_percent": F.try_divide(_over("percent_sum"), _over("percent_n")),
            "attempts": _over("n").cast("bigint"),
            "avg_minutes": F.try_divide(_over("minutes_sum"), _over("minutes_n")),
        }
    )
    return rows.withColumn("performance", rules.performance_label(rules.settled(F.col("avg_percent"))))


def performance_label(attempts: DataFrame) -> DataFrame:
    return _summary(attempts).select(*TARGET, "avg_percent", "performance")


def revision_recommendations(attempts: DataFrame) -> DataFrame:
    """Advice codes per target, one row each, in the order they are shown."""
    score, minutes = rules.settled(F.col("avg_percent")), rules.settled(F.col("avg_minutes"))
    pace = F.when(minutes < 10, "EXTEND_SESSIONS").when(minutes > 45, "TAKE_BREAKS")
    advice = F.array_compact(
        F.concat(
            F.when(score < 60, F.array(F.lit("FOCUS_FUNDAMENTALS"), F.lit("SHORTER_FREQUENT")))
            .when(score < 80, F.array(F.lit("FOCUS_CHALLENGES"), F.lit("MIX_PRACTICE_THEORY")))
            .otherwise(F.array(F.lit("MAINTAIN_KNOWLEDGE"), F.lit("SPACED_REPETITION"))),
            F.array(pace),
        )
    )
    return _summary(attempts).select(*TARGET, F.posexplode(advice).alias("position", "advice"))


def ideal_interval(attempts: DataFrame) -> DataFrame:
    """Days until the next revision for every attempt; a row-wise projection."""
    percent = rules.score_percent()
    return attempts.select(
        "log_pos", *TARGET, percent.alias("percent"), rules.ideal_interval(percent).alias("ideal_days")
    )


def score_percent(attempts: DataFrame) -> DataFrame:
    return attempts.select("log_pos", *TARGET, rules.score_percent().alias("percent"))


def difficulty_label_encode(attempts: DataFrame) -> DataFrame:
    """0-based code of every level a (user, subject) has, in name order, and the code an unseen
    level gets (the middle one)."""
    levels = (
        attempts.filter("difficulty is not null")
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_set("difficulty")).alias("levels"))
    )
    return levels.select(
        *KEYS,
        F.posexplode("levels").alias("code", "difficulty"),
        F.floor(F.size("levels") / 2).cast("int").alias("unseen_code"),
    )


def recent_attempts(attempts: DataFrame, last: int = 5) -> DataFrame:
    """The last attempts of every target in log order, fallback included.

    The last ones of a subject are among the last ones of its levels, so the per-level limit,
    which Spark applies before the shuffle, comes first.
    """
    newest = F.col("log_pos").desc()
    kept = (
        attempts.withColumn("back", F.row_number().over(Window.partitionBy(*TARGET).orderBy(newest)))
        .filter(F.col("back") <= last)
        .select(*KEYS, F.col("difficulty").alias("taken_at"), "log_pos", "attempt_ts", "score", "total", "time_spent_mins")
    )
    # At most ``last`` rows per level, so the lists are small whatever the group.
    listed = kept.groupBy(*KEYS).agg(
        F.collect_list(F.struct("log_pos", "taken_at", "attempt_ts", "score", "total", "time_spent_mins")).alias("rows")
    )
    standard = F.array(*[F.lit(name) for name in K.LEVELS])
    target = F.explode(F.array_union(standard, F.array_compact(F.array_distinct("rows.taken_at"))))
    rows = listed.select(*KEYS, target.alias("difficulty"), "rows")
    own = F.filter("rows", lambda r: r["taken_at"] == F.col("difficulty"))
    chosen = F.when(F.size(own) > 0, own).otherwise(F.col("rows"))
    newest_first = F.slice(F.reverse(F.array_sort(chosen)), 1, last)
    return (
        rows.select(*TARGET, (F.size(own) == 0).alias("is_prediction_mode"), F.posexplode(newest_first).alias("back", "r"))
        .select(
            *TARGET,
            "is_prediction_mode",
            (F.col("back") + 1).alias("back"),
            "r.log_pos",
            "r.taken_at",
            "r.attempt_ts",
            "r.score",
            "r.total",
            F.col("r.time_spent_mins").alias("time_spent_mins"),
        )
        .withColumn("percent", rules.half_even(rules.settled(rules.score_percent()), 1))
    )


def _level_means(rows: DataFrame) -> DataFrame:
    """Unweighted means over a subject's levels: what an unseen level is predicted from. Attempts
    without a level belong to no level and do not count here."""
    levels = F.filter("all", lambda r: r["difficulty"].isNotNull())

    def mean(value) -> Column:
        values = F.array_compact(F.transform(levels, value))
        return F.try_divide(
            F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.size(values).cast("double")
        )

    return rows.withColumns(
        {
            "mean_percent": mean(lambda r: F.try_divide(r["percent_sum"], r["percent_n"].cast("double"))),
            "mean_max_attempt": mean(lambda r: r["max_attempt_no"].cast("double")),
            "mean_minutes": mean(lambda r: F.try_divide(r["minutes_sum"], r["minutes_n"].cast("double"))),
        }
    )


def fallback_features(numbered: DataFrame) -> DataFrame:
    """Prediction input of the targets without attempts; needs ``attempt_no``."""
    rows = _level_means(_targets(numbered).filter("is_prediction_mode"))
    return rows.select(*TARGET, "mean_percent", "mean_max_attempt", "mean_minutes")


def revision_plan(attempts: DataFrame, days: int = K.DAYS_UNTIL_QUIZ) -> DataFrame:
    """Sessions and interval until a quiz in ``days`` days, for every target.

    The base interval is the ideal one for the latest attempt, or for the fallback's mean.
    """
    rows = _level_means(_targets(attempts))
    percent = F.when(F.col("is_prediction_mode"), F.col("mean_percent")).otherwise(
        F.col("own.latest_percent")
    )
    base = rules.ideal_interval(rules.settled(percent)).cast("double")
    return with_sessions(rows.select(*TARGET, "is_prediction_mode", base.alias("base_interval")), days)


def with_sessions(rows: DataFrame, days: int) -> DataFrame:
    """Session count, exact and rounded interval from ``base_interval``."""
    if not 1 <= days <= 90:
        raise ValueError("days must be between 1 and 90")
    fit = (F.lit(float(days)) / F.col("base_interval")).cast("int")
    sessions = F.when(fit.isNotNull(), F.greatest(F.lit(2), fit))
    return rows.withColumn("sessions", sessions).withColumns(
        {
            "interval_days": F.lit(float(days)) / F.col("sessions"),
            "rounded_days": rules.half_step_ceil(F.lit(float(days)) / F.col("sessions")),
        }
    )


def revision_schedule(plan: DataFrame, days: int = K.DAYS_UNTIL_QUIZ, as_of: str = K.AS_OF) -> DataFrame:
    """One row per session; the first is at ``as_of``. At most 45 sessions per target."""
    rows = plan.filter("sessions is not null").withColumn(
        "session", F.explode(F.sequence(F.lit(1), F.col("sessions")))
    )
    offset = (F.col("session") - 1) * F.col("interval_days")
    seconds = F.rint(offset * 86400e6).cast("bigint") / F.lit(1e6)
    moment = F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return rows.select(
        *TARGET,
        "session",
        F.date_format(moment, "yyyy-MM-dd").alias("date"),
        F.date_format(moment, "EEEE").alias("day"),
        (F.lit(float(days)) - offset).cast("int").alias("days_until_quiz"),
    )


def _own_rows(numbered: DataFrame) -> DataFrame:
    """Training rows of the targets with attempts: the attempts themselves; their level is the only one."""
    return numbered.filter("difficulty is not null").select(
        _key(*TARGET).alias("key"), "log_pos", _features(F.lit(0.0)).alias("x"), _label().alias("y")
    )


def _subject_rows(numbered: DataFrame, levels: DataFrame) -> DataFrame:
    """Training rows of the subjects some level of which has no attempts: all attempts, the level as its place
    among the names the subject has."""
    lacking = levels.filter(F.size(F.array_except(F.array(*map(F.lit, K.LEVELS)), "levels")) > 0)
    code = F.array_position("levels", F.col("difficulty")).cast("double") - 1
    return join_totals(numbered.filter("difficulty is not null"), lacking, KEYS).select(
        _key(*KEYS).alias("key"), "log_pos", _features(code).alias("x"), _label().alias("y")
    )


def _key(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def _features(code: Column) -> Column:
    minutes = F.col("time_spent_mins").cast("double")
    return F.array(rules.score_percent(), F.col("attempt_no").cast("double"), minutes, code)


def _label() -> Column:
    return rules.ideal_interval(rules.score_percent()).cast("double")


def _whole(x: str) -> Column:
    return ~F.exists(x, lambda v: v.isNull())


def revision_interval_model(
    numbered: DataFrame,
    days: int = K.DAYS_UNTIL_QUIZ,
    trees: int = K.FOREST_TREES,
    seed: int = K.MODEL_SEED,
) -> DataFrame:
    """Base interval of every target from a forest of its own. Runs jobs. Needs ``attempt_no``.

    A target with attempts learns from them and is asked its latest attempt. The levels a user has not tried in a
    subject learn from all attempts there that have a level, and are asked the means over the levels, with the
    middle one of the levels. The features are score, attempt number, minutes and level; the label is the
    ideal interval. Attempts and questions without one of them are left out; without any, the interval is NULL.
    """
    numbered = checkpointed(numbered.select(*TARGET, "log_pos", "attempt_no", "score", "total", "time_spent_mins"))
    levels = (
        numbered.filter("difficulty is not null")
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_set("difficulty")).alias("levels"))
    )
    guess = F.col("is_prediction_mode")
    middle = F.floor(F.size(F.array_compact("all.difficulty")) / 2).cast("double")
    asked = checkpointed(
        _level_means(_targets(numbered)).select(
            *TARGET,
            "is_prediction_mode",
            F.when(guess, _key(*KEYS)).otherwise(_key(*TARGET)).alias("key"),
            F.when(
                guess, F.array("mean_percent", F.col("mean_max_attempt"), F.col("mean_minutes"), middle)
            )
            .otherwise(
                F.array(
                    F.col("own.latest_percent"),
                    F.col("own.latest_attempt_no").cast("double"),
                    F.col("own.latest_minutes").cast("double"),
                    F.lit(0.0),
                )
            )
            .alias("asked"),
        )
    )
    rows = _own_rows(numbered).unionByName(_subject_rows(numbered, levels)).filter(_whole("x"))
    rows = checkpointed(rows.withColumnRenamed("log_pos", "id"))
    # The levels without attempts of a subject ask the same.
    questions = asked.filter(_whole("asked")).select("key", "asked").dropDuplicates(["key"])
    answers = forests.answers(rows, questions, trees, seed).withColumnRenamed("answer", "base_interval")
    interval = rules.settled(F.col("base_interval")).alias("base_interval")
    return with_sessions(asked.join(answers, "key", "left").select(*TARGET, "is_prediction_mode", interval), days)
