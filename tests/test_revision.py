import pytest
from conftest import records
from pyspark.sql import functions as F
from samples import attempts, log

from studylattice.operators import revision as R
from studylattice.operators.quiz import attempt_numbering


def by_target(df):
    return {(r.user_id, r.subject, r.difficulty): r for r in df.collect()}


def test_summary_golden_and_fallback(spark):
    rows = by_target(R.revision_summary(attempts(spark)))
    row = rows[7, "Maths", "Hard"]
    assert row.avg_percent == pytest.approx((20 + 40 + 75) / 3)
    assert (row.attempts, row.avg_minutes, row.is_prediction_mode, row.performance) == (3, 10.0, False, "Needs Practice")
    row = rows[7, "Maths", "Intermediate"]  # none of its own: all five Maths attempts
    assert row.is_prediction_mode and row.attempts == 5
    assert row.avg_percent == pytest.approx((20 + 40 + 80 + 75 + 100) / 5)
    assert row.avg_minutes == pytest.approx((12 + 8 + 5 + 10 + 0.75) / 5)


def test_attempts_without_a_level_count_in_fallbacks(spark):
    rows = log(spark, [(1, "Art", None, 4), (2, "Art", None, 1), (2, "Art", "Easy", 5)])
    sets = by_target(R.training_set_fallback(rows))
    assert {k: r.training_rows for k, r in sets.items()} == {
        **{(1, "Art", level): 1 for level in ("Easy", "Intermediate", "Hard")},
        (2, "Art", "Easy"): 1,
        (2, "Art", "Intermediate"): 2,
        (2, "Art", "Hard"): 2,
    }
    assert by_target(R.revision_summary(rows))[2, "Art", "Hard"].avg_percent == pytest.approx(60.0)
    recent = R.recent_attempts(rows).filter("user_id = 1 and difficulty = 'Hard'").collect()
    assert [(r.score, r.taken_at, r.is_prediction_mode) for r in recent] == [(4, None, True)]
    features = by_target(R.fallback_features(rows.withColumn("attempt_no", rows.log_pos.cast("int"))))
    assert features[2, "Art", "Hard"].mean_percent == 100.0 and features[1, "Art", "Hard"].mean_percent is None


def test_targets_keep_levels_outside_the_standard_ones(spark):
    rows = by_target(R.training_set_fallback(log(spark, [(1, "Art", "Expert", 4), (1, "Art", "Easy", 2)])))
    assert {k[2]: (r.is_prediction_mode, r.training_rows, r.available) for k, r in rows.items()} == {
        "Easy": (False, 1, "Easy, Expert"),
        "Expert": (False, 1, "Easy, Expert"),
        "Intermediate": (True, 2, "Easy, Expert"),
        "Hard": (True, 2, "Easy, Expert"),
    }


def test_fallback_features_weigh_levels_equally(spark):
    row = by_target(R.fallback_features(attempts(spark)))[7, "Maths", "Intermediate"]
    hard, easy = (45.0, 4, 10.0), (90.0, 5, 2.875)
    assert (row.mean_percent, row.mean_max_attempt, row.mean_minutes) == pytest.approx(
        tuple((h + e) / 2 for h, e in zip(hard, easy))
    )


def test_recent_attempts_are_the_last_five_in_the_log(spark):
    rows = R.recent_attempts(attempts(spark))
    hard = rows.filter("user_id = 7 and subject = 'Maths' and difficulty = 'Hard'").orderBy("back")
    assert [(r.score, r.percent) for r in hard.collect()] == [(3, 75.0), (2, 40.0), (1, 20.0)]
    other = rows.filter("user_id = 7 and subject = 'Maths' and difficulty = 'Intermediate'").orderBy("back").collect()
    assert [r.score for r in other] == [5, 3, 4, 2, 1]
    assert all(r.is_prediction_mode for r in other)


def test_label_codes(spark):
    rows = R.difficulty_label_encode(log(spark, [(1, "Art", d, 1) for d in ("Hard", "Easy", "Hard", "Intermediate")]))
    assert records(rows, "difficulty", "code", "unseen_code") == [("Easy", 0, 1), ("Hard", 1, 1), ("Intermediate", 2, 1)]


@pytest.mark.parametrize("days, base, sessions, interval, rounded", [(14, 2.0, 7, 2.0, 2.0), (14, 3.0, 4, 3.5, 3.5), (14, 7.0, 2, 7.0, 7.0), (1, 7.0, 2, 0.5, 0.5), (90, 7.0, 12, 7.5, 7.5), (13, 5.0, 2, 6.5, 6.5), (10, 3.0, 3, 10 / 3, 3.5)])
def test_sessions(spark, days, base, sessions, interval, rounded):
    row = R.with_sessions(spark.createDataFrame([(base,)], "base_interval double"), days).first()
    assert (row.sessions, row.rounded_days) == (sessions, rounded)
    assert row.interval_days == pytest.approx(interval)


def test_days_outside_the_slider_are_refused(spark):
    with pytest.raises(ValueError):
        R.revision_plan(attempts(spark), days=0)


def test_schedule_rows(spark):
    plan = R.revision_plan(log(spark, [(1, "Art", "Easy", 3)]))
    rows = R.revision_schedule(plan).filter("difficulty = 'Easy'").orderBy("session").collect()
    assert [(r.date, r.day, r.days_until_quiz) for r in rows] == [
        ("2025-01-01", "Wednesday", 14),
        ("2025-01-04", "Saturday", 10),
        ("2025-01-08", "Wednesday", 7),
        ("2025-01-11", "Saturday", 3),
    ]


@pytest.mark.parametrize("score, minutes, codes", [(1, 5.0, ["FOCUS_FUNDAMENTALS", "SHORTER_FREQUENT", "EXTEND_SESSIONS"]), (3, 20.0, ["FOCUS_CHALLENGES", "MIX_PRACTICE_THEORY"]), (5, 50.0, ["MAINTAIN_KNOWLEDGE", "SPACED_REPETITION", "TAKE_BREAKS"])])
def test_recommendations(spark, score, minutes, codes):
    from pyspark.sql import functions as F

    one = log(spark, [(1, "Art", "Easy", score)]).withColumn("time_spent_mins", F.lit(minutes))
    rows = R.revision_recommendations(one).filter("difficulty = 'Easy'").orderBy("position").collect()
    assert [r.advice for r in rows] == codes


def test_model_predicts_within_the_label_range_and_repeats(spark):
    first = by_target(R.revision_interval_model(attempts(spark), trees=10))
    again = by_target(R.revision_interval_model(attempts(spark), trees=10))
    assert len(first) == 5 * 3
    assert all(2 <= r.base_interval <= 7 for r in first.values())
    assert {k: r.base_interval for k, r in first.items()} == {k: r.base_interval for k, r in again.items()}


def test_every_target_learns_from_its_own_attempts(spark):
    """A user with constant results gets the interval of that result; others have no part in it."""
    rows = [(1, "Art", "Easy", 5)] * 6 + [(2, "Art", "Easy", 0)] * 6 + [(3, "Art", "Easy", 4), (3, "Art", "Hard", 4)]
    got = by_target(R.revision_interval_model(attempt_numbering(log(spark, rows)), trees=20))
    want = {1: 7.0, 2: 2.0, 3: 5.0}
    assert {k: r.base_interval for k, r in got.items()} == {(u, "Art", d): want[u] for u in want for d in ("Easy", "Intermediate", "Hard")}


def test_the_model_needs_whole_questions(spark):
    numbered = attempt_numbering(log(spark, [(1, "Art", "Easy", 5), (2, "Art", "Easy", 3)]))
    lacking = numbered.withColumn("time_spent_mins", F.expr("CASE WHEN user_id = 1 THEN time_spent_mins END"))
    got = by_target(R.revision_interval_model(lacking, trees=20))
    assert all((r.base_interval is None) == (k[0] == 2) for k, r in got.items()) and len(got) == 6
    assert R.revision_interval_model(numbered.limit(0)).count() == 0


def test_a_hot_target_gives_the_forest_of_its_rows(spark, monkeypatch):
    rows = [(1, "Art", "Easy", (7 * i) % 6) for i in range(90)] + [(2, "Art", "Hard", 2)] * 3
    numbered = attempt_numbering(log(spark, rows))
    small = by_target(R.revision_interval_model(numbered, trees=12))
    monkeypatch.setattr(R.forests.answers, "__defaults__", (50,))
    spread = by_target(R.revision_interval_model(numbered, trees=12))
    assert small[2, "Art", "Hard"] == spread[2, "Art", "Hard"]
    assert abs(small[1, "Art", "Easy"].base_interval - spread[1, "Art", "Easy"].base_interval) < 1.5


def test_the_interval_of_a_hot_target_does_not_depend_on_its_size(spark, monkeypatch):
    rows = [(1, "Art", "Easy", (7 * i * i) % 6) for i in range(90)] + [(2, "Art", "Hard", 2)] * 3
    numbered = attempt_numbering(log(spark, rows))
    small = by_target(R.revision_interval_model(numbered, trees=12))
    monkeypatch.setattr(R.forests, "SMALL", 20)
    assert by_target(R.revision_interval_model(numbered, trees=12)) == small
