"""Learned difficulty weights and the rankings built on them.

A weight is a product of one factor per attempt, so at scale it leaves the range of a double.
Everything is therefore ranked by logarithms; the plain scores are for display and become
0 or infinity when the weight does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylattice import constants as K
from studylattice.functions import rules
from studylattice.plans.ordered import with_position

# Beyond this exponent two different weighted scores are more than 100 points apart.
_HUGE_EXPONENT = 600.0

# Bits of a register number in the sketches of distinct users.
SKETCH_BITS = 14


def difficulty_weights(attempts: DataFrame) -> DataFrame:
    """Weight per weighted subject and level: the base weight times one factor per attempt.

    The order of attempts does not matter, so counting passes and fails is enough; rows that
    carry these counts already (the stream's cells) are summed. Always one row per entry of
    the base table, whatever the size of the log.
    """
    base = attempts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in K.WEIGHTED_SUBJECTS])).alias("subject")
    ).select(
        "subject", F.explode(F.array(*[F.lit(level) for level in K.LEVELS])).alias("difficulty")
    )
    if "passes" in attempts.columns:
        tallies = {"passes": F.sum("passes"), "fails": F.sum("fails")}
    else:
        tallies = {"passes": F.count_if(rules.passed()), "fails": F.count_if(~rules.passed())}
    counts = (
        attempts.filter(F.col("subject").isin(*K.WEIGHTED_SUBJECTS))
        .groupBy("subject", "difficulty")
        .agg(*[tally.alias(name) for name, tally in tallies.items()])
    )
    passes, fails = (F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("passes", "fails"))
    log_weight = (
        F.ln(rules.lookup(F.col("difficulty"), K.BASE_WEIGHT))
        + passes * F.ln(F.lit(K.PASS_FACTOR))
        + fails * F.ln(F.lit(K.FAIL_FACTOR))
    )
    return base.join(counts, ["subject", "difficulty"], "left").select(
        "subject",
        "difficulty",
        passes.alias("passes"),
        fails.alias("fails"),
        log_weight.alias("ln_weight"),
        F.exp(log_weight).alias("weight"),
    )


def _weighted(attempts: DataFrame) -> DataFrame:
    """Attach ``ln_weight``; 0 (weight 1) for subjects or levels outside the base table.

    The broadcast side has one row per base-table entry by construction.
    """
    weights = difficulty_weights(attempts).select("subject", "difficulty", "ln_weight")
    return attempts.join(F.broadcast(weights), ["subject", "difficulty"], "left").withColumn(
        "ln_weight", F.coalesce("ln_weight", F.lit(0.0))
    )


def _ln_score(score: str = "score") -> Column:
    """Log of the weighted score; NULL for a score of zero."""
    return F.when(F.col(score) > 0, F.ln(F.col(score).cast("double")) + F.col("ln_weight"))


def best_scores(attempts: DataFrame) -> DataFrame:
    """Best weighted score and attempts per (subject, user), in one shuffle.

    ``attempts`` may be raw attempts, or the stream's (user, subject, difficulty) cells.
    """
    n = F.sum("attempts") if "attempts" in attempts.columns else F.count("score")
    return (
        _weighted(attempts)
        .groupBy("subject", "user_id")
        .agg(F.max(_ln_score()).alias("ln_weighted_score"), n.alias("attempts"))
    )


def weighted_score(attempts: DataFrame) -> DataFrame:
    """Score times the learned weight, for every attempt."""
    return _weighted(attempts).select(
        "log_pos",
        "user_id",
        "subject",
        "difficulty",
        "score",
        (F.col("score") * F.exp("ln_weight")).alias("weighted_score"),
    )


def _display(ln_value: Column) -> Column:
    return F.coalesce(F.exp(ln_value), F.lit(0.0))


def subject_leaderboard(attempts: DataFrame, subject: str | None = None) -> DataFrame:
    """Users of every subject ranked by their best weighted score; ties by user id.

    ``subject`` limits the ranking (weights are per subject, so they are unaffected).
    """
    if subject is not None:
        attempts = attempts.filter(F.col("subject") == subject)
    best = best_scores(attempts)
    order = [rules.settled(F.col("ln_weighted_score")).desc_nulls_last(), F.col("user_id").asc()]
    return with_position(best, ["subject"], order, "rank").select(
        "subject",
        "rank",
        "user_id",
        _display(F.col("ln_weighted_score")).alias("weighted_score"),
        "ln_weighted_score",
        "attempts",
    )


def overall_leaderboard(attempts: DataFrame) -> DataFrame:
    """Users ranked by the mean over their subjects of the best weighted score."""
    per_user = (
        best_scores(attempts)
        .groupBy("user_id")
        .agg(
            # One entry per subject the user tried: the subject list bounds it.
            F.array_sort(F.collect_list("ln_weighted_score")).alias("logs"),
            F.count("*").alias("subjects"),
            F.sum("attempts").alias("attempts"),
        )
    )
    top = F.array_max("logs")
    shares = F.aggregate("logs", F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    ln_mean = F.when(F.size("logs") > 0, top + F.ln(shares) - F.ln(F.col("subjects").cast("double")))
    scored = per_user.select(
        "user_id", ln_mean.alias("ln_average_best_score"), "subjects", "attempts"
    )
    order = [rules.settled(F.col("ln_average_best_score")).desc_nulls_last(), F.col("user_id").asc()]
    return with_position(scored, [], order, "rank").select(
        "rank",
        "user_id",
        _display(F.col("ln_average_best_score")).alias("average_best_score"),
        "ln_average_best_score",
        "attempts",
    )


def progress(attempts: DataFrame) -> DataFrame:
    """Change in weighted percentage from the first to the last attempt in log order, for
    every (subject, user) with two attempts or more; within -100..100, two decimals."""
    percent = F.col("score").cast("double") / F.greatest(F.col("total"), F.lit(1)) * 100.0
    points = _weighted(attempts).withColumn(
        "ln_percent", F.when(F.col("score") > 0, F.ln(percent) + F.col("ln_weight"))
    )
    # Plain numbers only, so that Spark can aggregate by hashing.
    rows = (
        points.groupBy("subject", "user_id")
        .agg(
            F.min_by("ln_percent", "log_pos").alias("ln_first"),
            F.max_by("ln_percent", "log_pos").alias("ln_last"),
            F.count("*").alias("attempts"),
        )
        .filter("attempts > 1")
    )
    floor = F.lit(float("-inf"))
    ln_first, ln_last = F.coalesce("ln_first", floor), F.coalesce("ln_last", floor)
    change = F.when(
        F.greatest(ln_first, ln_last) <= _HUGE_EXPONENT,
        rules.clamp(_display(F.col("ln_last")) - _display(F.col("ln_first")), -100.0, 100.0),
    ).otherwise(100.0 * F.signum(F.when(ln_last == ln_first, 0.0).otherwise(ln_last - ln_first)))
    return rows.select(
        "subject",
        "user_id",
        rules.half_even(rules.settled(change), 2).alias("progress_percent"),
        "attempts",
    )


def _progress_order() -> list[Column]:
    return [F.col("progress_percent").desc(), F.col("user_id").asc()]


def progress_leaderboard(attempts: DataFrame) -> DataFrame:
    """Users of every subject ranked by progress; ties by user id."""
    return with_position(progress(attempts), ["subject"], _progress_order(), "rank").select(
        "subject", "rank", "user_id", "progress_percent", "attempts"
    )


def top_improved(attempts: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` users per subject by progress, with the width of their bar in percent.

    The rank filter is a per-group limit, which Spark applies before the shuffle.
    """
    ranked = Window.partitionBy("subject").orderBy(*_progress_order())
    leaders = progress(attempts).withColumn("rank", F.row_number().over(ranked)).filter(
        F.col("rank") <= top
    )
    widest = F.max(F.abs("progress_percent")).over(Window.partitionBy("subject"))
    return leaders.select(
        "subject",
        F.col("rank").cast("bigint").alias("rank"),
        "user_id",
        "progress_percent",
        (F.abs("progress_percent") / F.greatest(widest, F.lit(1.0)) * 100.0).alias("bar_width"),
        (F.col("progress_percent") > 0).alias("improved"),
    )


def platform_kpis(attempts: DataFrame) -> DataFrame:
    """Users, attempts, subjects and mean score, counted from (user, subject) totals."""
    pairs = attempts.groupBy("user_id", "subject").agg(
        F.count("*").alias("n"), F.count("score").alias("scored"), F.sum("score").alias("points")
    )
    # One row per user, then one row in all: no row is expanded for a distinct count.
    users = pairs.groupBy("user_id").agg(
        F.sum("n").alias("n"),
        F.sum("scored").alias("scored"),
        F.sum("points").alias("points"),
    )
    totals = users.agg(
        F.count("user_id").alias("users"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("attempts"),
        F.try_divide(F.sum("points").cast("double"), F.sum("scored").cast("double")).alias("mean_score"),
    )
    subjects = attempts.select(F.countDistinct("subject").alias("subjects"))
    return totals.select("users", "attempts", subjects.scalar().alias("subjects"), "mean_score")


def subject_participation(attempts: DataFrame) -> DataFrame:
    """Distinct users per subject, and as a share of the best attended subject."""
    # Distinct pairs spread a popular subject over all tasks before it is counted.
    counts = (
        attempts.filter("user_id is not null")
        .select("subject", "user_id")
        .distinct()
        .groupBy("subject")
        .agg(F.count("*").alias("participants"))
    )
    most = counts.agg(F.max("participants")).scalar()
    return counts.select(
        "subject",
        "participants",
        (F.col("participants").cast("double") / most.cast("double") * 100.0).alias("share"),
    )


def user_sketches(attempts: DataFrame) -> DataFrame:
    """(subject, users): a mergeable sketch of the distinct users of every subject, 16 KB at most each.

    Its estimates have a relative standard error of about 0.7 percent, whatever the number of users.
    """
    return attempts.filter("user_id is not null").groupBy("subject").agg(
        F.hll_sketch_agg("user_id", SKETCH_BITS).alias("users")
    )


def merged_sketches(first: DataFrame, second: DataFrame) -> DataFrame:
    """The sketches of ``first``, each with what ``second`` knows of its subject."""
    other = second.select(F.col("subject").alias("_subject"), F.col("users").alias("_users"))
    both = first.join(other, F.col("subject").eqNullSafe(F.col("_subject")), "left")
    merged = F.when(F.col("_users").isNull(), F.col("users")).otherwise(F.hll_union("users", "_users"))
    return both.select("subject", merged.alias("users"))


def estimated_participation(sketches: DataFrame) -> DataFrame:
    """Estimated distinct users per subject, as a share of the best attended subject, and of all subjects
    together (``all_users``): ``subject_participation`` and the users of ``platform_kpis`` without the attempts."""
    counts = sketches.select("subject", F.hll_sketch_estimate("users").alias("participants"))
    most = counts.agg(F.max("participants")).scalar().cast("double")
    everyone = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("users"))).scalar()
    share = F.col("participants").cast("double") / most * 100.0
    return counts.select("subject", "participants", share.alias("share"), everyone.alias("all_users"))


def difficulty_distribution(attempts: DataFrame) -> DataFrame:
    """Attempts and share per standard level; levels without attempts are kept.

    The share is of all attempts that name a level, standard or not.
    """
    levels = attempts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(level) for level in K.LEVELS])).alias("difficulty")
    )
    counts = (
        attempts.filter("difficulty is not null")
        .groupBy("difficulty")
        .agg(F.count("*").alias("attempts"))
    )
    everything = counts.agg(F.sum("attempts")).scalar().cast("double")
    n = F.coalesce("attempts", F.lit(0).cast("bigint"))
    return levels.join(counts, "difficulty", "left").select(
        "difficulty",
        n.alias("attempts"),
        F.coalesce(F.try_divide(n.cast("double"), everything) * 100.0, F.lit(0.0)).alias("share"),
    )
