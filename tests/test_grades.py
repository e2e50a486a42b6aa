import pytest

from studylattice.operators import grades as G

SCHEMA = "course_id long, pos int, type string, weight double, assignment_name string, grade double, completed boolean, study_hours double"
DEFAULT = [
    ("Homework", 20.0, "HW Average", 85.0, True, 10.0),
    ("Quiz", 15.0, "Quiz 1", 92.0, True, 3.0),
    ("Midterm", 25.0, "Midterm 1", 88.0, True, 15.0),
    ("Final Exam", 30.0, "Final Exam", None, False, None),
    ("Project", 10.0, "Term Project", None, False, None),
]


def tables(spark, courses, target=90.0, hours=15.0, credits=3.0):
    rows = [(cid, pos, *row) for cid, items in courses.items() for pos, row in enumerate(items)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(
        [(cid, 1, credits, target, hours) for cid in courses],
        "course_id long, user_id long, credits double, target double, available_hours double",
    )


def item(weight, grade, hours=None, name="A"):
    return ("Quiz", weight, name, grade, grade is not None, hours)


def test_default_course(spark):
    work, courses = tables(spark, {1: DEFAULT})
    row = G.course_grades(work).first()
    assert (row.projected_grade, row.display_grade) == pytest.approx((52.8, 88.0))
    row = G.required_scores(work, courses).first()
    assert (row.required_score, row.remaining_weight, row.status) == (pytest.approx(93.0), 40.0, "NEEDS_SCORE")
    row = G.grade_trend(work).first()
    assert (row.slope, row.predicted_grade, row.trend) == (pytest.approx(1.5), pytest.approx(92.8333, abs=1e-4), "IMPROVING")
    row = G.goal_status(work, courses).first()
    assert (row.mean_grade, row.status) == (pytest.approx(88.3333, abs=1e-4), "CLOSE")
    row = G.grade_insights(work, courses).first()
    assert row.grade_std == pytest.approx(3.5119, abs=1e-4) and row.consistency == "CONSISTENT"
    assert (row.best, row.weakest, row.points_per_hour) == ("Quiz 1", "HW Average", pytest.approx(15.0111, abs=1e-4))
    hours = {r.assignment_name: r.recommended_hours for r in G.study_time_allocation(work, courses).collect()}
    assert hours == {"Final Exam": 11.2, "Term Project": 3.8}
    row = G.course_progress(work).first()
    assert (row.completed, row.assignments, row.percent_done) == (3, 5, 60.0)
    assert G.course_weight_check(work).count() == 0
    assert G.grade_series(work, courses).count() == 3
    row = G.letter_grade(work, courses).first()
    assert (row.letter, row.grade_points) == ("B+", 3.3)


def test_weightless_course(spark):
    work, courses = tables(spark, {1: [item(0.0, 80.0), item(0.0, None)]})
    row = G.course_grades(work).first()
    assert (row.current_grade, row.projected_grade, row.completed_weight) == (0.0, 0.0, 0.0)
    assert G.required_scores(work, courses).first().status == "BELOW_TARGET"
    assert G.study_time_allocation(work, courses).first().recommended_hours is None
    assert [r.total_weight for r in G.course_weight_check(work).collect()] == [0.0]


@pytest.mark.parametrize(
    "items, status, required",
    [
        ([item(100.0, 95.0)], "MEETS_TARGET", 95.0),
        ([item(100.0, 60.0)], "BELOW_TARGET", 60.0),
        ([item(95.0, 96.0), item(5.0, None)], "SECURED", 0.0),
        ([item(50.0, 40.0), item(50.0, None)], "UNACHIEVABLE", 140.0),
        ([item(50.0, None), item(50.0, None)], "NEEDS_SCORE", 90.0),
    ],
)
def test_required_score_cases(spark, items, status, required):
    work, courses = tables(spark, {1: items})
    row = G.required_scores(work, courses).first()
    assert (row.status, row.required_score) == (status, pytest.approx(required))


def test_nothing_completed(spark):
    work, courses = tables(spark, {1: [item(50.0, None), item(50.0, None)]})
    assert G.goal_status(work, courses).first().status == "NO_DATA"
    row = G.grade_trend(work).first()
    assert (row.completed, row.slope, row.predicted_grade, row.trend) == (0, None, None, "NEED_MORE_DATA")
    assert G.grade_insights(work, courses).count() == 0
    assert G.letter_grade(work, courses).count() == 0


def test_first_assignment_wins_equal_grades_and_varied_grades(spark):
    items = [item(10.0, 90.0, None, "a"), item(10.0, 50.0, None, "b"), item(10.0, 90.0, None, "c"), item(10.0, 50.0, None, "d")]
    work, courses = tables(spark, {1: items, 2: [item(10.0, 70.0, None, "only")]})
    rows = {r.course_id: r for r in G.grade_insights(work, courses).collect()}
    assert (rows[1].best, rows[1].weakest, rows[1].consistency) == ("a", "b", "VARIED")
    assert (rows[2].best, rows[2].grade_std, rows[2].consistency) == (None, None, "CONSISTENT")


def test_trend_skips_open_work_and_spans_partitions(spark, many_partitions):
    grades = [float(40 + (i * 7) % 23 + i / 50) if i % 4 else None for i in range(900)]
    work, _ = tables(spark, {1: [item(1.0, g) for g in grades], 2: [item(1.0, 60.0), item(1.0, 58.0)]})
    rows = {r.course_id: r for r in G.grade_trend(work).collect()}
    done = [g for g in grades if g is not None]
    n, mean_x, mean_y = len(done), (len(done) - 1) / 2, sum(done) / len(done)
    slope = sum((i - mean_x) * (g - mean_y) for i, g in enumerate(done)) / sum((i - mean_x) ** 2 for i in range(n))
    assert rows[1].completed == n and rows[1].slope == pytest.approx(slope, abs=1e-8)
    assert rows[1].predicted_grade == pytest.approx(mean_y + slope * (899 - mean_x), abs=1e-5)
    assert (rows[2].trend, rows[2].predicted_grade) == ("DECLINING", 58.0)


def test_completed_follows_grade_and_gpa_weighs_credits(spark):
    work, courses = tables(spark, {1: [item(100.0, 95.0)], 2: [item(100.0, 59.0)]})
    assert [r.completed for r in G.completed_from_grade(work.drop("completed")).orderBy("course_id").collect()] == [True, True]
    weighted = courses.selectExpr("course_id", "user_id", "IF(course_id = 1, 4.0D, 1.0D) credits", "target")
    row = G.weighted_gpa(work, weighted).first()
    assert (row.gpa, row.credits, row.courses) == (pytest.approx(4.0 * 4 / 5), 5.0, 2)


@pytest.mark.parametrize("grade, letter", [(97.0, "A+"), (96.99, "A"), (90.0, "A-"), (60.0, "D"), (59.99, "F"), (0.0, "F")])
def test_letters(spark, grade, letter):
    work, courses = tables(spark, {1: [item(100.0, grade)]})
    assert G.letter_grade(work, courses).first().letter == letter
