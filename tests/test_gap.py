import pytest
from samples import attempts, log

from studylattice.operators import gap as G


def plain_forecast(rows):
    """The forecast of one learner's attempts in a subject, an attempt at a time."""
    rows = sorted(rows, key=lambda r: (r.attempt_ts, r.log_pos))
    factor, rank = {"Easy": 0.8, "Intermediate": 1.0, "Hard": 1.2}, {"Easy": 1, "Intermediate": 2, "Hard": 3}
    scores, n = [r.score * factor[r.difficulty] for r in rows], len(rows)
    weights = [1 + i / max(n - 1, 1) for i in range(n)]

    def line(values):
        middle, mean = (len(values) - 1) / 2, sum(values) / len(values)
        spread = sum((i - middle) ** 2 for i in range(len(values)))
        return sum((i - middle) * (v - mean) for i, v in enumerate(values)) / spread if spread else 0.0

    mean, slope = sum(w * s for w, s in zip(weights, scores)) / sum(weights), line(scores)
    return {
        "path": " \u2192 ".join(str(r.score) for r in rows),
        "mean": mean,
        "slope": slope,
        "micro": line([r.score for r in rows[-3:]]),
        "predicted": min(5, max(0, round(round(mean + slope, 9)))),
        "trend": "Improving" if slope > 0.1 else "Declining" if slope < -0.1 else "Stable",
        "level": sum(rank[r.difficulty] for r in rows) / n,
        "last": rank[rows[-1].difficulty],
        "first": min(r.log_pos for r in rows),
    }


def plain_forecasts(df):
    groups = {}
    for row in df.collect():
        groups.setdefault((row.user_id, row.subject), []).append(row)
    return {key: plain_forecast(rows) for key, rows in groups.items()}


def by_key(df):
    return {(r.user_id, r.subject): r for r in df.collect()}


@pytest.fixture(params=["together", "split"])
def golden_log(spark, request):
    if request.param == "split":
        request.getfixturevalue("many_partitions")
    return attempts(spark)


def test_forecast_goldens(golden_log):
    rows = by_key(G.forecast(golden_log))
    micro = by_key(G.gap_micro_trend(golden_log))
    paths = by_key(G.gap_score_path(golden_log))
    wanted = plain_forecasts(golden_log)
    assert rows.keys() == wanted.keys()
    for key, want in wanted.items():
        row = rows[key]
        assert paths[key].score_path == want["path"]
        assert row.weighted_avg == pytest.approx(want["mean"])
        assert row.slope == pytest.approx(want["slope"], abs=1e-8)
        assert micro[key].micro_slope == pytest.approx(want["micro"], abs=1e-8)
        assert (row.predicted, row.trend, row.last_level) == (want["predicted"], want["trend"], want["last"])
        assert row.mean_level == pytest.approx(want["level"])


def test_long_paths_continue_on_pages(spark, many_partitions):
    rows = [(1, "Maths", "Easy", i % 6) for i in range(250)]
    pages = sorted(G.gap_score_path(log(spark, rows), page_size=100).collect(), key=lambda r: r.page)
    assert [r.page for r in pages] == [0, 1, 2]
    assert " → ".join(r.score_path for r in pages) == " → ".join(str(i % 6) for i in range(250))


@pytest.mark.parametrize(
    "scores, reason",
    [
        ([1, 2, 3, 4], "IMPROVING"),
        ([4, 3, 2, 1], "DIPPED"),
        ([2, 2, 2, 2, 1, 3], "STABLE_UP"),
        ([1], "STABLE_LOW"),
        ([2, 2, 2], "STABLE_FLAT"),
        ([3, 3, 3], "CONSISTENT"),
        ([5, 5], "STRONG"),
    ],
)
def test_reasons(spark, scores, reason):
    rows = [(1, "Maths", "Intermediate", s) for s in scores]
    assert G.gap_reason(log(spark, rows)).first().reason == reason


@pytest.mark.parametrize(
    "steps, context",
    [
        ([("Easy", 2), ("Easy", 2), ("Hard", 2)], "HARDER_HOLDING"),
        ([("Easy", 5), ("Easy", 5), ("Hard", 1)], "HARDER_DIP"),
        ([("Hard", 4), ("Hard", 4), ("Easy", 1)], "EASIER_DIP"),
        ([("Hard", 1), ("Hard", 1), ("Easy", 5)], None),
        ([("Easy", 3)], None),
    ],
)
def test_contexts(spark, steps, context):
    rows = [(1, "Maths", level, score) for level, score in steps]
    assert G.gap_difficulty_context(log(spark, rows)).first().context == context


def test_single_attempt_and_unknown_level(spark):
    row = G.gap_forecast(log(spark, [(1, "Art", "Expert", 4)])).first()
    assert (row.weighted_avg, row.slope, row.predicted, row.trend) == (4.0, 0.0, 4, "Stable")


def test_percentile_and_most_improved(spark):
    rows = attempts(spark)
    wanted = plain_forecasts(rows)
    for row in G.gap_percentile(rows).collect():
        own = [w["predicted"] for (user, _), w in wanted.items() if user == row.user_id]
        share = round(sum(own) / len(own) / 5 * 100, 1)
        assert (row.percentile, row.band) == (share, "EXCELLENT" if share >= 85 else "GOOD" if share >= 60 else "NEEDS_WORK")
    best = {r.user_id: (r.subject, r.status) for r in G.gap_most_improved(rows).collect()}
    for user in {u for u, _ in wanted}:
        slope, _, subject = max((w["slope"], -w["first"], s) for (u, s), w in wanted.items() if u == user)
        assert best[user] == (subject, "improved" if slope > 0.1 else "consistent")
    tied = [(1, "Late", "Easy", 3), (1, "Early", "Easy", 3)]
    assert G.gap_most_improved(log(spark, tied)).first().subject == "Late"  # first in the log
