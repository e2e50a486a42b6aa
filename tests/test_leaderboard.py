import math
import random

import pytest
from conftest import records
from samples import log

from studylattice import constants as K
from studylattice.operators import leaderboard as L


def simulate(rows):
    """Weights updated attempt by attempt."""
    weights = {(s, d): K.BASE_WEIGHT[d] for s in K.WEIGHTED_SUBJECTS for d in K.LEVELS}
    for _, subject, level, score, *rest in rows:
        total = rest[0] if rest else 5
        if (subject, level) in weights:
            weights[subject, level] *= 1.05 if total > 0 and score / total >= 0.6 else 0.95
    return weights


def sample(seed, n=120):
    draw = random.Random(seed)
    subjects = [*K.WEIGHTED_SUBJECTS, "Music"]
    levels = [*K.LEVELS, "Expert"]
    return [(draw.randrange(1, 7), draw.choice(subjects), draw.choice(levels), draw.randrange(6), draw.choice([5, 5, 5, 0])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_equal_the_sequential_update_in_any_order(spark, seed):
    rows = sample(seed)
    want = simulate(rows)
    for order in (rows, rows[::-1]):
        got = {(r.subject, r.difficulty): r.weight for r in L.difficulty_weights(log(spark, order)).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_empty_log_has_base_weights_and_empty_boards(spark):
    empty = log(spark, sample(1)).limit(0)
    weights = [r.weight for r in L.difficulty_weights(empty).orderBy("subject", "weight").collect()]
    assert weights == pytest.approx([1.0, 1.3, 1.6] * 4)
    assert L.overall_leaderboard(empty).count() == 0
    assert L.platform_kpis(empty).first().asDict() == {"users": 0, "attempts": 0, "subjects": 0, "mean_score": None}
    assert records(L.difficulty_distribution(empty), "difficulty", "attempts", "share") == [("Easy", 0, 0.0), ("Hard", 0, 0.0), ("Intermediate", 0, 0.0)]


def test_boards_match_a_direct_computation(spark):
    rows = sample(5)
    weights = simulate(rows)
    best, count = {}, {}
    for user, subject, level, score, _ in rows:
        key = (subject, user)
        best[key] = max(best.get(key, 0.0), score * weights.get((subject, level), 1.0))
        count[key] = count.get(key, 0) + 1
    board = L.subject_leaderboard(log(spark, rows)).collect()
    for subject in {s for s, _ in best}:
        users = sorted((u for s, u in best if s == subject), key=lambda u: (-round(best[subject, u], 9), u))
        got = sorted((r for r in board if r.subject == subject), key=lambda r: r.rank)
        assert [r.user_id for r in got] == users
        assert [r.weighted_score for r in got] == pytest.approx([best[subject, u] for u in users])
        assert [r.attempts for r in got] == [count[subject, u] for u in users]
    means = {u: [v for (_, w), v in best.items() if w == u] for u in {u for _, u in best}}
    means = {u: sum(v) / len(v) for u, v in means.items()}
    overall = sorted(L.overall_leaderboard(log(spark, rows)).collect(), key=lambda r: r.rank)
    assert [r.user_id for r in overall] == sorted(means, key=lambda u: (-means[u], u))
    assert [r.average_best_score for r in overall] == pytest.approx(sorted(means.values(), reverse=True))


def test_ranking_survives_weights_beyond_the_range_of_a_double(spark):
    rows = [(1, "Maths", "Easy", 0)] * 15_000 + [(2, "Maths", "Easy", 3), (3, "Maths", "Easy", 5), (4, "Maths", "Easy", 4)]
    board = sorted(L.subject_leaderboard(log(spark, rows)).collect(), key=lambda r: r.rank)
    assert [r.user_id for r in board] == [3, 4, 2, 1]
    assert board[0].weighted_score == 0.0 and board[0].ln_weighted_score < -700
    assert board[-1].ln_weighted_score is None
    overall = sorted(L.overall_leaderboard(log(spark, rows)).collect(), key=lambda r: r.rank)
    assert [r.user_id for r in overall] == [3, 4, 2, 1]


def test_progress_of_enormous_weights_is_clamped(spark):
    rows = [(9, "Maths", "Hard", 5)] * 20_000 + [(1, "Maths", "Hard", 1), (1, "Maths", "Hard", 5), (2, "Maths", "Hard", 4), (2, "Maths", "Hard", 2), (3, "Maths", "Hard", 3), (3, "Maths", "Hard", 3)]
    got = {r.user_id: r.progress_percent for r in L.progress(log(spark, rows)).collect()}
    assert got == {1: 100.0, 2: -100.0, 3: 0.0, 9: 0.0}


def test_progress_uses_log_order_and_needs_two_attempts(spark):
    rows = [(1, "Art", "Easy", 1), (2, "Art", "Easy", 5), (1, "Art", "Easy", 5), (3, "Art", "Easy", 4, 0), (1, "Art", "Easy", 4), (3, "Art", "Easy", 0, 0)]
    got = {r.user_id: (r.progress_percent, r.attempts) for r in L.progress(log(spark, rows)).collect()}
    # User 3 has attempts without questions: the total counts as one, and the change is clamped.
    assert got == {1: (60.0, 3), 3: (-100.0, 2)}


def test_top_improved_limits_per_subject(spark):
    rows = [(u, s, "Easy", v) for s in ("Art", "Music") for u in range(1, 14) for v in (2, min(5, u % 6))]
    top = L.top_improved(log(spark, rows)).collect()
    assert {s: sum(r.subject == s for r in top) for s in ("Art", "Music")} == {"Art": 10, "Music": 10}
    assert max(r.bar_width for r in top) == 100.0
    assert all(r.improved == (r.progress_percent > 0) for r in top)


def test_kpis_participation_and_distribution(spark):
    rows = [(1, "Maths", "Easy", 5), (1, "Art", "Easy", 3), (2, "Maths", "Hard", 1), (2, "Maths", "Expert", 2)]
    attempts = log(spark, rows)
    assert L.platform_kpis(attempts).first().asDict() == {"users": 2, "attempts": 4, "subjects": 2, "mean_score": 2.75}
    assert records(L.subject_participation(attempts), "subject", "participants", "share") == [("Art", 1, 50.0), ("Maths", 2, 100.0)]
    assert records(L.difficulty_distribution(attempts), "difficulty", "attempts", "share") == [("Easy", 2, 50.0), ("Hard", 1, 25.0), ("Intermediate", 0, 0.0)]


def test_ln_weights_agree_with_weights(spark):
    for row in L.difficulty_weights(log(spark, sample(8))).collect():
        assert math.exp(row.ln_weight) == pytest.approx(row.weight)
