import random
from statistics import mean

import numpy as np
import pytest

from studylattice.plans import forests


def plain_answer(rows, asked, trees, seed, bins=None):
    """One tree after the other, every cut of every feature tried; with ``bins`` cuts lie at quantiles."""
    leaves = []
    ids = np.array([r[0] for r in rows])
    drawn = forests.bootstrap(seed, np.arange(trees), ids)
    for tree in range(trees):
        node = [(x, y, w) for (_, x, y), w in zip(rows, drawn[tree].tolist()) if w]
        while node:
            weight, total = sum(w for *_, w in node), sum(w * y for _, y, w in node)
            best = None
            for f in range(len(asked)):
                values = sorted({x[f] for x, *_ in node})
                for low, high in zip(values, values[1:]):
                    left_w = sum(w for x, _, w in node if x[f] <= low)
                    left_t = sum(w * y for x, y, w in node if x[f] <= low)
                    score = left_t * left_t / left_w + (total - left_t) * (total - left_t) / (weight - left_w)
                    if best is None or score > best[0]:
                        best = score, f, (low + high) / 2 if bins is None else low
            if len({y for _, y, _ in node}) == 1 or best is None:
                leaves.append(total / weight)
                break
            _, f, cut = best
            node = [n for n in node if (n[0][f] <= cut) == (asked[f] <= cut)]
    return mean(leaves) if leaves else None


def groups(seed, sizes):
    made = random.Random(seed)
    rows, questions, at = {}, {}, 0
    for g, size in enumerate(sizes):
        key = f"k{g}"
        rows[key] = []
        for _ in range(size):
            x = [float(made.choice([0, 20, 40, 60, 80, 100])), float(at % 7), round(made.uniform(1, 60), 1), float(made.randint(0, 2))]
            rows[key].append((at * 1_000_003 - 10**12, x, float(made.choice([2, 3, 5, 7]) if made.random() < 0.3 else 2 + x[0] // 25)))
            at += 1
        questions[key] = [made.uniform(0, 100), made.uniform(0, 7), made.uniform(1, 60), float(made.randint(0, 2))]
    return rows, questions


def tables(spark, rows, questions):
    flat = [(k, i, x, y) for k, own in rows.items() for i, x, y in own]
    return (
        spark.createDataFrame(flat, "key string, id long, x array<double>, y double").repartition(5),
        spark.createDataFrame(list(questions.items()), "key string, asked array<double>"),
    )


def found(spark, rows, questions, **options):
    return {r.key: r.answer for r in forests.answers(*tables(spark, rows, questions), **options).collect()}


def test_small_keys_equal_plain_trees(spark):
    rows, questions = groups(1, [1, 2, 3, 5, 8, 40, 70, 0, 1])
    got = found(spark, rows, questions, trees=9, seed=5)
    want = {k: plain_answer(own, questions[k], 9, 5) for k, own in rows.items() if own}
    assert got == pytest.approx(want)


def test_chunks_hold_whole_keys(spark, monkeypatch):
    rows, questions = groups(2, [13] * 30)
    want = found(spark, rows, questions, trees=5, seed=1)
    assert len(want) == 30
    x, y, ids = (np.array([r[i] for own in rows.values() for r in own]) for i in (1, 2, 0))
    whole = forests.solved(x, y, ids, np.repeat(np.arange(30), 13), np.array(list(questions.values())), 5, 1)
    assert [want[k] for k in rows] == pytest.approx(whole.tolist())


def test_large_keys_equal_plain_trees_over_their_cuts(spark):
    """Every value is a cut here, so the histograms lose nothing."""
    rows, questions = groups(3, [60, 90, 4])
    got = found(spark, rows, questions, trees=6, seed=2, small=50)
    want = {k: plain_answer(own, questions[k], 6, 2, bins=50 if len(own) > 50 else None) for k, own in rows.items()}
    values = {len({x[f] for _, x, _ in own}) for own in rows.values() for f in (0, 1, 3)}
    assert max(values) <= 50 and got["k2"] == pytest.approx(want["k2"])
    for key in ("k0", "k1"):  # minutes have more values than there are bins
        own = [(i, [x[0], x[1], 0.0, x[3]], y) for i, x, y in rows[key]]
        asked = [*questions[key][:2], 0.0, questions[key][3]]
        exact = found(spark, {key: own}, {key: asked}, trees=6, seed=2, small=50)
        assert exact[key] == pytest.approx(plain_answer(own, asked, 6, 2, bins=50))
        assert 2 <= got[key] <= 7


def test_keys_without_rows_and_empty_tables(spark):
    rows, questions = groups(4, [3])
    assert found(spark, {}, questions, trees=3, seed=1) == {}
    assert found(spark, rows, {}, trees=3, seed=1) == {}


def test_counts_have_mean_and_variance_one():
    drawn = forests.bootstrap(42, np.arange(100), np.arange(1000))
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03


def test_rows_are_sorted_once_a_feature(monkeypatch):
    draw = np.random.default_rng(4)
    n, groups = 600, 5
    x, y, group = draw.integers(0, 40, (n, 3)).astype(float), draw.integers(1, 9, n).astype(float), np.sort(draw.integers(0, groups, n))
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda *a, **k: sorts.append(1) or lexsort(*a, **k))
    forests.solved(x, y, np.arange(n), group, x[:groups], 10, 7)
    assert len(sorts) == 3


def whole_answers(rows, questions, trees, seed):
    return {
        k: forests.solved(*(np.array([r[i] for r in own]) for i in (1, 2, 0)), np.zeros(len(own), int), np.array([questions[k]]), trees, seed)[0]
        for k, own in rows.items()
    }


def test_the_size_of_a_key_does_not_change_its_answer(spark):
    rows, questions = groups(5, [forests.SMALL + 400, 30])
    questions["k0"][0] = 25.0  # between the scores 20 and 40, before their middle
    assert found(spark, rows, questions, trees=8, seed=3) == whole_answers(rows, questions, 8, 3)


@pytest.mark.parametrize("bins, opened, held", [(3, 1, 1 << 20), (8, 8, 0), (64, 2, 1 << 20)])
def test_spread_rows_give_the_same_forest(spark, monkeypatch, bins, opened, held):
    """Few bins, so that splits lie inside them; boxes broadcast and joined."""
    for name, value in (("SMALL", 20), ("BINS", bins), ("OPENED", opened), ("BROADCAST_BYTES", held)):
        monkeypatch.setattr(forests, name, value)
    rows, questions = groups(6, [60, 150, 21, 5])
    # Labels that no feature tells, a feature with one value, and equal rows with different labels.
    rows["even"] = [(i, [float(i % 2), 1.0, float(i // 2 % 2), 0.0], float((i % 2) ^ (i // 2 % 2))) for i in range(64)]
    questions["even"] = [0.5, 1.0, 0.2, 0.0]
    rows["equal"] = [(i, [1.0, 2.0, 3.0, 0.0], float(i % 3)) for i in range(30)]
    questions["equal"] = [1.0, 2.0, 3.0, 0.0]
    got = found(spark, rows, questions, trees=6, seed=2)
    assert got == whole_answers(rows, questions, 6, 2)
    assert got == pytest.approx({k: plain_answer(own, questions[k], 6, 2) for k, own in rows.items()})


def test_bounds_hold_inside_bins():
    draw = np.random.default_rng(8)
    for _ in range(200):
        y, w = draw.integers(0, 8, 30).astype(float), draw.integers(1, 4, 30).astype(float)
        a, b = sorted(draw.choice(31, 2, replace=False))
        lefts = [(w[:i].sum(), (w * y)[:i].sum()) for i in range(31)]
        all_w, all_t = lefts[-1]
        best = max(t * t / v + (all_t - t) ** 2 / (all_w - v) for v, t in lefts[max(a, 1) : min(b, 29) + 1]) if b > 1 and a < 29 else 0
        one = [np.array([c]) for c in (*lefts[a], lefts[b][0] - lefts[a][0], lefts[b][1] - lefts[a][1], y[a:b].min(), y[a:b].max(), all_w, all_t)]
        assert forests._bounds(*one)[0] >= best * (1 - 1e-12)


def test_rows_of_a_key_stay_together_whatever_join_is_chosen(spark):
    """A join planned by shuffles that is found small enough to broadcast reads the rows where they lie."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4KB"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows, questions = groups(7, [300, 40, 200, 90])
        flat, asked = tables(spark, rows, questions)
        found = forests.answers(flat.localCheckpoint(), asked.dropDuplicates(["key"]), 6, 2)
        got = found.collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "REPARTITION_BY_NUM" in plan.split("BroadcastHashJoin")[0]
    assert sorted(map(tuple, got)) == sorted(whole_answers(rows, questions, 6, 2).items())
