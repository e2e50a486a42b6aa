from hashlib import md5
from random import Random

import pytest
from conftest import records
from pyspark.sql import functions as F
from samples import attempts, log

from studylattice.operators import groups as S
from studylattice.plans import lloyd
from studylattice.session import checkpointed


def test_profile_goldens(spark):
    rows = {r.user_id: r for r in S.student_profiles(attempts(spark)).collect()}
    percents = [20, 40, 80, 75, 100, 60, 80, 100, 40, 20]  # one of user 7's attempts had four questions
    assert rows[7].attempts == len(percents)
    assert (rows[7].avg_score, rows[7].avg_difficulty) == pytest.approx((sum(percents) / 10, 19 / 10), abs=1e-4)


def test_levels_are_normalised_and_unknown_ones_ignored(spark):
    rows = log(spark, [(1, "Art", " HARD ", 5), (1, "Art", "easy", 5), (1, "Art", "Expert", 0), (2, "Art", "Expert", 3)])
    assert records(S.student_profiles(rows), "user_id", "attempts", "avg_difficulty") == [(1, 3, 2.0), (2, 1, None)]


def profiles(spark, rows):
    return spark.createDataFrame(rows, "user_id long, avg_score double, attempts long, avg_difficulty double")


def test_scaling_uses_the_population_deviation(spark):
    rows = records(S.scaled_features(profiles(spark, [(1, 40.0, 5, 2.0), (2, 60.0, 5, 1.0)])), "user_id", "avg_score_z", "attempts_z", "avg_difficulty_z")
    assert rows == [(1, -1.0, 0.0, 1.0), (2, 1.0, 0.0, -1.0)]


def test_peer_goldens(spark):
    random = Random(4)
    rows = [(i, round(random.uniform(30, 90), 1), random.randint(1, 40), round(random.uniform(1, 3), 2)) for i in range(40)]

    def distance(a, b):
        return abs(a[3] - b[3]) + 0.4 * abs(a[1] - b[1])

    got = {r.user_id: r for r in S.peer_recommendation(profiles(spark, rows)).collect()}
    for row in rows:
        want = min((distance(row, other), other[0]) for other in rows if other[0] != row[0])
        assert distance(row, rows[got[row[0]].peer_id]) == pytest.approx(want[0])


def test_comparison_rows(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "first_user long, second_user long")
    rows = S.compare_users(profiles(spark, [(1, 50.126, 3, 2.0), (2, 61.0, 4, 1.334)]), pairs)
    assert records(rows, "metric", "first_value", "second_value") == [
        ("ATTEMPTS", 3.0, 4.0), ("AVG_DIFFICULTY", 2.0, 1.33), ("AVG_SCORE", 50.13, 61.0),
    ]


def blobs(spark):
    rows = []
    for group, (score, tries, level) in enumerate([(20.0, 5, 1.0), (55.0, 20, 2.0), (90.0, 40, 3.0)]):
        rows += [(100 * group + i, score + i % 3, tries + i % 2, level + 0.01 * (i % 4)) for i in range(20)]
    return profiles(spark, rows)


def test_clusters(spark):
    scores = S.cluster_k_selection(blobs(spark)).collect()
    assert [r.k for r in scores] == list(range(2, 10))
    assert [r.k for r in scores if r.best] == [3]
    assert all(-1 <= r.silhouette <= 1 for r in scores)
    groups = S.student_groups(blobs(spark), restarts=3)
    letters = {r.user_id: r.study_group for r in groups.collect()}
    assert len(letters) == 60
    assert {u // 100: g for u, g in letters.items()} == {0: "C", 1: "B", 2: "A"}
    pages = S.group_members(groups, page_size=15).orderBy("study_group", "page").collect()
    assert [(r.study_group, r.page, r.members) for r in pages] == [(g, p, n) for g in "ABC" for p, n in ((0, 15), (1, 5))]
    assert ", ".join(r.member_ids for r in pages if r.study_group == "C") == ", ".join(map(str, range(20)))


def test_too_few_users_for_groups(spark):
    one = profiles(spark, [(1, 50.0, 3, 2.0)])
    assert S.cluster_k_selection(one).count() == 0
    with pytest.raises(ValueError):
        S.student_groups(one)
    with pytest.raises(ValueError, match="26"):
        S.student_groups(one, k=27)


def plain_fits(points, ks, restarts, seed):
    """k-means with a loop for every model, place and centre."""
    places = sorted(set(points))
    weight = {p: points.count(p) for p in places}
    cheapest = {}
    for k in (k for k in ks if k <= len(places) and k < len(points)):
        for restart in range(restarts):
            key = lambda p: (md5(":".join(map(str, (seed, restart, *p))).encode()).hexdigest(), p)
            centres = [tuple(map(float, p)) for p in sorted(places, key=key)[:k]]

            def away(p, c):
                return sum((a - b) ** 2 for a, b in zip(p, c))

            def nearest(p):
                return min(range(k), key=lambda c: (away(p, centres[c]), c))

            for _ in range(lloyd.MOST_STEPS):
                groups = {}
                for p in places:
                    groups.setdefault(nearest(p), []).append(p)
                moved = [
                    tuple(sum(weight[p] * p[i] for p in groups[c]) / sum(weight[p] for p in groups[c]) for i in range(3)) if c in groups else centres[c]
                    for c in range(k)
                ]
                shift = sum(away(a, b) for a, b in zip(moved, centres))
                centres = moved
                if shift <= 1e-4 * 1e12:
                    break
            cost = sum(weight[p] * int(away(p, centres[nearest(p)])) for p in places)
            fit = (cost, restart, {p: nearest(p) for p in places})
            cheapest[k] = min(cheapest.get(k, fit), fit, key=lambda f: f[:2])
    return {k: f[2] for k, f in cheapest.items()}


def plain_silhouette(points, labels):
    def mean(p, c, own):
        others = [q for q in points if labels[q] == c]
        return sum(sum((a - b) ** 2 for a, b in zip(p, q)) for q in others) / (len(others) - own) if len(others) > own else None

    total = 0.0
    for p in points:
        inside = mean(p, labels[p], 1)
        outside = min(mean(p, c, 0) for c in set(labels.values()) if c != labels[p])
        total += 0 if inside is None or max(inside, outside) == 0 else (outside - inside) / max(inside, outside)
    return total / len(points)


def test_all_models_equal_plain_fits(spark):
    random = Random(9)
    points = [tuple(random.choice([-1, 1]) * 1_000_000 + random.randint(-700_000, 700_000) for _ in range(3)) for _ in range(60)]
    points += points[:7] * 2
    rows = spark.createDataFrame([(list(p),) for p in points], "p array<long>").repartition(5)
    places = checkpointed(lloyd.places(rows))
    best = lloyd.best_of_each(lloyd.fit_all(places, [2, 3, 5], 4, 7))
    want = plain_fits(points, [2, 3, 5], 4, 7)
    scores = lloyd.silhouettes(places, best.values())
    for k, model in best.items():
        literal = F.array(*[F.array(*map(F.lit, c)) for c in model.centres])
        found = places.select("p", lloyd.nearest(F.col("p"), literal)["cluster"].alias("c")).collect()
        assert {tuple(r.p): r.c for r in found} == want[k]
        assert scores[k] == pytest.approx(plain_silhouette(points, want[k]), abs=1e-9)


def test_fits_do_not_depend_on_the_partitioning(spark):
    random = Random(3)
    rows = [(i, random.uniform(0, 100), random.randint(1, 50), random.uniform(1, 3)) for i in range(300)]
    found = [records(S.student_groups(profiles(spark, rows).repartition(n), restarts=5), "user_id", "study_group") for n in (1, 7)]
    assert found[0] == found[1]


def test_one_job_a_step_whatever_the_models(spark, monkeypatch):
    """Thirty restarts of eight numbers of clusters take the steps of the slowest of them."""
    calls = []
    step = lloyd._step
    monkeypatch.setattr(lloyd, "_step", lambda *a: calls.append(len(a[1])) or step(*a))
    S.cluster_k_selection(blobs(spark), restarts=10)
    assert calls[0] == 80 and len(calls) <= lloyd.MOST_STEPS + 1
    assert calls[:-1] == sorted(calls[:-1], reverse=True)


def test_equal_profiles_form_no_groups(spark):
    same = profiles(spark, [(i, 50.0, 3, 2.0) for i in range(5)])
    assert S.cluster_k_selection(same).count() == 0
    nulls = profiles(spark, [(1, None, 3, 2.0), (2, 50.0, 3, None)])
    assert S.cluster_k_selection(nulls).count() == 0
    mixed = profiles(spark, [(1, None, 3, 2.0), (2, 50.0, 3, 1.0), (3, 10.0, 3, 1.0), (4, 10.5, 3, 1.0)])
    assert records(S.student_groups(mixed, k=2), "user_id", "study_group") == [(1, None), (2, "A"), (3, "B"), (4, "B")]
