"""Course grades: what is earned, what is needed, where it is heading.

Inputs are ``assignments`` (many per course) and ``courses`` (one row per course). Each
operator aggregates the assignments once and joins the result to the courses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylattice import constants as K
from studylattice.functions import rules
from studylattice.plans.ordered import indexed_sums
from studylattice.plans.skew import join_totals

_CLOSE_GAP = 10.0
_VARIED_STD = 10.0


def _done() -> Column:
    return F.coalesce(F.col("completed"), F.lit(False))


def _sum_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def _weights(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("course_id").agg(
        _sum_where(_done(), F.col("weight") / 100.0 * F.col("grade")).alias("earned"),
        _sum_where(_done(), F.col("weight")).alias("completed_weight"),
        _sum_where(~_done(), F.col("weight")).alias("remaining_weight"),
    )


def completed_from_grade(assignments: DataFrame) -> DataFrame:
    """An assignment counts as completed once it has a grade."""
    return assignments.withColumn("completed", F.col("grade").isNotNull())


def course_grades(assignments: DataFrame) -> DataFrame:
    """Current grade over completed work, projected grade with the rest counted as 0, and the
    one to display."""
    done = F.col("completed_weight") > 0
    current = F.when(done, F.col("earned") / (F.col("completed_weight") / 100.0)).otherwise(0.0)
    weightless = F.col("completed_weight") + F.col("remaining_weight") == 0
    earned = F.when(weightless, 0.0).otherwise(F.col("earned"))
    return (
        _weights(assignments)
        .withColumns({"current_grade": current, "projected_grade": earned})
        .select(
            "course_id",
            "current_grade",
            "completed_weight",
            "projected_grade",
            F.when(rules.settled(F.col("completed_weight")) < 100, F.col("current_grade"))
            .otherwise(F.col("projected_grade"))
            .alias("display_grade"),
        )
    )


def required_scores(assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """Mean score needed on the remaining work to reach the target, and what that means."""
    rows = _weights(assignments).join(courses.select("course_id", "target"), "course_id")
    open_work = rules.settled(F.col("remaining_weight")) > 0
    needed = F.when(
        F.col("remaining_weight") != 0,
        (F.col("target") - F.col("earned")) / (F.col("remaining_weight") / 100.0),
    ).otherwise(F.col("earned"))
    required = F.greatest(F.lit(0.0), needed)
    reached = rules.settled(F.col("earned")) >= F.col("target")
    status = (
        F.when(open_work & (rules.settled(required) > 100), "UNACHIEVABLE")
        .when(open_work & reached, "SECURED")
        .when(open_work, "NEEDS_SCORE")
        .when(reached, "MEETS_TARGET")
        .otherwise("BELOW_TARGET")
    )
    return rows.select(
        "course_id", "target", "earned", "remaining_weight", required.alias("required_score"), status.alias("status")
    )


def grade_trend(assignments: DataFrame) -> DataFrame:
    """Line through the completed grades in course order, read at the last assignment.

    Courses with fewer than two completed assignments have no prediction.
    """
    sums = indexed_sums(
        assignments,
        ["course_id"],
        [F.col("pos").asc()],
        F.when(_done(), F.col("grade")),
        {"assignments": (F.count("*"), F.sum)},
    )
    n = F.col("n").cast("double")
    slope = rules.slope_from_sums(F.col("n"), F.col("total"), F.col("index_total"))
    rows = sums.withColumn("slope", F.when(F.col("n") > 1, rules.settled(slope)))
    intercept = F.try_divide(F.col("total"), n) - F.col("slope") * (n - 1.0) / 2.0
    reading = intercept + F.col("slope") * (F.col("assignments") - 1)
    return rows.select(
        "course_id",
        F.col("n").alias("completed"),
        "slope",
        rules.clamp(reading, 0.0, 100.0).alias("predicted_grade"),
        F.when(F.col("n") < 2, "NEED_MORE_DATA")
        .when(F.col("slope") > 1, "IMPROVING")
        .when(F.col("slope") < -1, "DECLINING")
        .otherwise("STABLE")
        .alias("trend"),
    )


def goal_status(assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """Distance of the plain mean of completed grades from the target."""
    means = assignments.groupBy("course_id").agg(F.avg(F.when(_done(), F.col("grade"))).alias("mean_grade"))
    gap = F.col("target") - F.col("mean_grade")
    return means.join(courses.select("course_id", "target"), "course_id").select(
        "course_id",
        "mean_grade",
        gap.alias("gap"),
        F.when(gap.isNull(), "NO_DATA")
        .when(rules.settled(gap) <= 0, "ON_TRACK")
        .when(rules.settled(gap) <= _CLOSE_GAP, "CLOSE")
        .otherwise("NEEDS_IMPROVEMENT")
        .alias("status"),
    )


def study_time_allocation(assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """Share of the available hours for every remaining assignment, by weight.

    The total is aggregated and joined back: a window would hold a whole course in one task.
    """
    remaining = assignments.filter(~_done())
    totals = (
        remaining.groupBy("course_id")
        .agg(F.sum("weight").alias("total_weight"))
        .join(courses.select("course_id", "available_hours"), "course_id")
    )
    hours = F.try_divide(F.col("weight"), F.col("total_weight")) * F.col("available_hours")
    rows = remaining.select("course_id", "assignment_name", "weight")
    return join_totals(rows, totals, ["course_id"]).select(
        "course_id",
        "assignment_name",
        "weight",
        rules.half_even(rules.settled(hours), 1).alias("recommended_hours"),
    )


def grade_insights(assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """Mean against target, consistency, best and weakest assignment, points per study hour."""
    done = assignments.filter(_done())
    graded = F.col("grade").isNotNull()
    name, pos = F.col("assignment_name"), F.col("pos")
    facts = done.groupBy("course_id").agg(
        F.count("*").alias("completed"),
        F.avg("grade").alias("mean_grade"),
        F.stddev_samp("grade").alias("grade_std"),
        # Equal grades: the first assignment of the course counts.
        F.min_by(name, F.when(graded, F.struct(-F.col("grade"), pos))).alias("best"),
        F.min_by(name, F.when(graded, F.struct(F.col("grade"), pos))).alias("weakest"),
        F.avg(F.try_divide(F.col("grade"), F.col("study_hours"))).alias("points_per_hour"),
    )
    several = F.col("completed") > 1
    return facts.join(courses.select("course_id", "target"), "course_id").select(
        "course_id",
        "mean_grade",
        (rules.settled(F.col("mean_grade")) >= F.col("target")).alias("meets_target"),
        "grade_std",
        F.when(rules.settled(F.col("grade_std")) > _VARIED_STD, "VARIED").otherwise("CONSISTENT").alias("consistency"),
        F.when(several, F.col("best")).alias("best"),
        F.when(several, F.col("weakest")).alias("weakest"),
        "points_per_hour",
    )


def course_progress(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("course_id").agg(
        F.count_if(_done()).alias("completed"),
        F.count("*").alias("assignments"),
        (F.avg(_done().cast("int")) * 100.0).alias("percent_done"),
    )


def course_weight_check(assignments: DataFrame) -> DataFrame:
    """Courses whose weights do not add up to 100."""
    totals = assignments.groupBy("course_id").agg(F.sum("weight").alias("total_weight"))
    return totals.filter(rules.settled(F.col("total_weight")) != 100)


def grade_series(assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """Completed grades next to the course target, as plotted."""
    return (
        assignments.filter(_done())
        .select("course_id", "assignment_name", "grade")
        .join(courses.select("course_id", "target"), "course_id")
    )


def _on_scale(column: int, grade: Column) -> Column:
    """Entry of the grade scale: letter (0) or points (2); below the scale is its last row."""
    bands = [(row[1], row[column]) for row in K.GPA_SCALE]
    return rules.banded(grade, bands[:-1], bands[-1][1])


def letter_grade(assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """Letter and grade points of every course with completed work."""
    rows = course_grades(assignments).filter("completed_weight > 0")
    grade = rules.settled(F.col("display_grade"))
    return rows.join(courses.select("course_id", "user_id", "credits"), "course_id").select(
        "user_id",
        "course_id",
        "credits",
        "display_grade",
        _on_scale(0, grade).alias("letter"),
        _on_scale(2, grade).alias("grade_points"),
    )


def weighted_gpa(assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """Credit-weighted mean of the grade points per user."""
    points = F.sum(F.col("grade_points") * F.col("credits"))
    return (
        letter_grade(assignments, courses)
        .groupBy("user_id")
        .agg(
            F.try_divide(points, F.sum("credits")).alias("gpa"),
            F.sum("credits").alias("credits"),
            F.count("*").alias("courses"),
        )
    )
