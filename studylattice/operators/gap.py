"""Score forecasts and trends for every (user, subject), in time order.

The forecasts need the index of each attempt in its group; they are taken from sums of
index * score (``indexed_sums``), so a learner with very many attempts is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylattice import constants as K
from studylattice.functions import rules
from studylattice.plans.ordered import INDEX, PART, indexed_sums, with_position

KEYS = ["user_id", "subject"]
_TREND = 0.1
_MICRO_TREND = 0.05
_LEVEL_MARGIN = 0.3


def _time_order() -> list[Column]:
    return [F.col("attempt_ts").asc(), F.col("log_pos").asc()]


def _level() -> Column:
    return rules.lookup(F.col("difficulty"), K.LEVEL_RANK, 2)


def _factored_score() -> Column:
    return F.col("score") * rules.lookup(F.col("difficulty"), K.GAP_FACTOR, 1.0)


def gap_weighted_score(attempts: DataFrame) -> DataFrame:
    """Score times the level's fixed factor, for every attempt."""
    return attempts.select("log_pos", *KEYS, "difficulty", _factored_score().alias("weighted_score"))


def forecast(attempts: DataFrame) -> DataFrame:
    """Weighted mean, slope and predicted next score, with the facts the rules below use."""
    sums = indexed_sums(
        attempts.filter("score is not null"),
        KEYS,
        _time_order(),
        _factored_score(),
        {
            "points": (F.sum("score"), F.sum),
            "levels": (F.sum(_level()), F.sum),
            "last_level": (F.max_by(_level(), INDEX), lambda level: F.max_by(level, PART)),
            "first_pos": (F.min("log_pos"), F.min),
        },
    )
    n = F.col("n").cast("double")
    # Weight of attempt i: 1 + i/(n-1), from 1 for the oldest to 2 for the newest.
    last = F.greatest(n - 1.0, F.lit(1.0))
    weighted = (F.col("total") + F.col("index_total") / last) / (n + n * (n - 1.0) / 2.0 / last)
    slope = rules.slope_from_sums(F.col("n"), F.col("total"), F.col("index_total"))
    rows = sums.select(
        *KEYS,
        F.col("n").alias("attempts"),
        weighted.alias("weighted_avg"),
        rules.settled(slope).alias("slope"),
        (F.col("points") / n).alias("mean_score"),
        (F.col("levels") / n).alias("mean_level"),
        "last_level",
        "first_pos",
    )
    expected = rules.settled(F.col("weighted_avg") + F.col("slope"))
    return rows.withColumns(
        {
            "predicted": rules.clamp(F.rint(expected), 0.0, float(K.MAX_SCORE)).cast("int"),
            "trend": F.when(F.col("slope") > _TREND, "Improving")
            .when(F.col("slope") < -_TREND, "Declining")
            .otherwise("Stable"),
        }
    )


def gap_forecast(attempts: DataFrame) -> DataFrame:
    return forecast(attempts).select(
        *KEYS, "attempts", "weighted_avg", "slope", "predicted", "trend"
    )


def gap_micro_trend(attempts: DataFrame) -> DataFrame:
    """Mean and slope of the last three raw scores; Spark keeps three rows per group before
    the shuffle, so the window never sees a whole group."""
    newest = Window.partitionBy(*KEYS).orderBy(F.col("attempt_ts").desc(), F.col("log_pos").desc())
    recent = (
        attempts.filter("score is not null")
        .withColumn("back", F.row_number().over(newest))
        .filter("back <= 3")
    )
    # ``back`` counts backwards in time, hence the sign.
    slope = F.coalesce(-F.regr_slope("score", "back"), F.lit(0.0))
    return recent.groupBy(*KEYS).agg(
        F.avg("score").alias("recent_avg"), rules.settled(slope).alias("micro_slope")
    )


def gap_reason(attempts: DataFrame) -> DataFrame:
    """Reason code for the trend; the order of the rules matters."""
    rows = forecast(attempts).join(gap_micro_trend(attempts), KEYS)
    mean, below = F.col("mean_score"), F.col("mean_score") < 3
    reason = (
        F.when(F.col("slope") > _TREND, "IMPROVING")
        .when(F.col("slope") < -_TREND, "DIPPED")
        .when((F.col("micro_slope") > _MICRO_TREND) & below, "STABLE_UP")
        .when(mean < 2, "STABLE_LOW")
        .when((F.col("recent_avg") <= mean) & below, "STABLE_FLAT")
        .when(mean < 4, "CONSISTENT")
        .otherwise("STRONG")
    )
    return rows.select(*KEYS, "trend", reason.alias("reason"))


def gap_difficulty_context(attempts: DataFrame) -> DataFrame:
    """How the last level compares with the usual one; NULL when it makes no difference."""
    last, mean, slope = F.col("last_level"), F.col("mean_level"), F.col("slope")
    harder, easier = last > mean + _LEVEL_MARGIN, last < mean - _LEVEL_MARGIN
    context = (
        F.when(harder & (slope >= 0), "HARDER_HOLDING")
        .when(harder, "HARDER_DIP")
        .when(easier & (slope < 0), "EASIER_DIP")
    )
    return forecast(attempts).select(*KEYS, "mean_level", "last_level", context.alias("context"))


def gap_scores(attempts: DataFrame) -> DataFrame:
    """Raw scores with their position in time, one row each, from 1. Runs a job."""
    rows = attempts.filter("score is not null").select(*KEYS, "attempt_ts", "log_pos", "score")
    return with_position(rows, KEYS, _time_order(), "position").select(*KEYS, "position", "score")


def gap_score_path(attempts: DataFrame, page_size: int = 1000) -> DataFrame:
    """``gap_scores`` as text for display: rows are pages of ``page_size`` scores, the key is
    (user, subject, page). Join on ``gap_scores`` instead. Runs a job."""
    step = F.struct("position", "score")
    return (
        gap_scores(attempts).withColumn("page", F.expr(f"(position - 1) div {page_size}"))
        .groupBy(*KEYS, "page")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
        .select(
            *KEYS,
            "page",
            F.array_join(F.col("steps.score").cast("array<string>"), " → ").alias("score_path"),
        )
    )


def gap_most_improved(attempts: DataFrame) -> DataFrame:
    """Each user's subject with the steepest slope; ties to the subject first attempted."""
    best = F.min_by(F.struct("subject", "slope"), F.struct(-F.col("slope"), "first_pos", "subject"))
    return (
        forecast(attempts)
        .groupBy("user_id")
        .agg(best.alias("best"))
        .select(
            "user_id",
            "best.subject",
            "best.slope",
            F.when(F.col("best.slope") > _TREND, "improved").otherwise("consistent").alias("status"),
        )
    )


def gap_percentile(attempts: DataFrame) -> DataFrame:
    """Mean predicted score over a user's subjects as a percentage, and its band."""
    share = F.avg("predicted") / float(K.MAX_SCORE) * 100.0
    return (
        forecast(attempts)
        .groupBy("user_id")
        .agg(rules.clamp(rules.half_even(rules.settled(share), 1), 0.0, 100.0).alias("percentile"))
        .withColumn("band", rules.banded(F.col("percentile"), ((85.0, "EXCELLENT"), (60.0, "GOOD")), "NEEDS_WORK"))
    )
