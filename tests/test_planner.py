import random
from itertools import combinations

import pytest
from conftest import records
from pyspark.sql import functions as F

from studylattice.operators import planner as P

SCHEMA = "request_id long, pos int, name string, priority int, difficulty_level int, min_hours double, total_hours double"


def table(spark, requests):
    """requests: id -> (hours, [(priority, difficulty, min_hours), ...])"""
    rows = [
        (rid, pos, f"S{pos}", p, d, m, hours)
        for rid, (hours, items) in requests.items()
        for pos, (p, d, m) in enumerate(items)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    out = {}
    for r in df.orderBy("request_id", "pos").collect():
        out.setdefault(r.request_id, {})[r.pos] = r.hours
    return out


def brute(hours, items):
    """Best subset by trying all of them, in the documented order of preference."""
    highest = max(p for p, _, _ in items)
    best = None
    for size in range(1, len(items) + 1):
        for chosen in combinations(range(len(items)), size):
            points = sum(items[i][0] for i in chosen)
            base = max(points, highest)
            if any(items[i][2] * base > hours * items[i][0] + 1e-9 for i in chosen):
                continue
            counts = [sum(items[i][0] == p for i in chosen) for p in (5, 4, 3, 2, 1)]
            demand = max(items[i][2] / items[i][0] for i in chosen)
            mask = sum(1 << i for i in chosen)
            rank = (-size, -min(points, highest), demand, points, counts, mask)
            if best is None or rank < best[0]:
                best = (rank, {i: round(2 * round(items[i][0] * hours / base, 9)) / 2 for i in chosen})
    return best and best[1]


def random_requests(seed, count):
    draw = random.Random(seed)
    return {
        rid: (
            draw.choice([0.5, 1.0, 2.0, 3.5, 6.0, 8.0]),
            [(draw.randint(1, 5), draw.randint(1, 5), draw.choice([0.0, 0.5, 0.5, 1.0, 1.5, 3.0])) for _ in range(draw.randint(1, 7))],
        )
        for rid in range(count)
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_proportional_plan_equals_subset_search(spark, many_partitions, seed):
    requests = random_requests(seed, 400)
    got = plan(P.allocate_proportional(table(spark, requests)))
    for rid, (hours, items) in requests.items():
        assert got.get(rid) == brute(hours, items), (hours, items)


def test_proportional_defaults_and_impossible_request(spark):
    requests = {1: (6.0, [(3, 3, 0.5)] * 3), 2: (0.5, [(3, 3, 1.0)])}
    assert plan(P.allocate_proportional(table(spark, requests))) == {1: {0: 2.0, 1: 2.0, 2: 2.0}}


def test_one_huge_request_is_planned_exactly(spark, many_partitions):
    draw = random.Random(4)
    items = [(draw.randint(1, 5), 3, 0.5 * draw.randint(0, 40)) for _ in range(4000)]
    got = plan(P.allocate_proportional(table(spark, {1: (500.0, items), 2: (6.0, [(3, 3, 0.5)] * 3)})))
    best = 0
    for m, p in {(m, p) for p, _, m in items}:
        budget = 1e9 if m == 0 else 500.0 * p // m
        if budget < 5:
            continue
        used, size = 0, 0
        for q in sorted(q for q, _, n in items if n / q <= m / p):
            if used + q > budget:
                break
            used, size = used + q, size + 1
        best = max(best, size)
    assert len(got[1]) == best
    assert len(got[2]) == 3


def test_softmax_goldens(spark):
    items = table(spark, {1: (6.0, [(5, 2, 1.0), (3, 5, 0.5), (1, 3, 0.5)]), 2: (1.0, [(3, 3, 2.0)])})
    assert plan(P.allocate_softmax(items)) == {1: {0: 4.5, 1: 1.0, 2: 0.5}}
    assert plan(P.allocate_balanced(items)) == {1: {0: 2.5, 1: 2.0, 2: 1.0}}


def test_summary_and_shares(spark):
    chosen = P.allocate_balanced(table(spark, {1: (6.0, [(5, 2, 1.0), (3, 5, 0.5), (1, 3, 0.5)])}))
    row = P.plan_summary(chosen).first()
    assert (row.subjects, row.hours) == (3, 5.5) and row.utilisation == pytest.approx(5.5 / 6 * 100)
    assert sum(r.share for r in P.plan_shares(chosen).collect()) == pytest.approx(100)


def walk(hours_by_subject, block, pause):
    """A clock that is advanced block by block."""
    clock, out = 0.0, []
    for name, hours in hours_by_subject:
        left = hours
        while left > 0:
            step = min(left, block)
            out.append((name, "study", clock, step))
            clock, left = clock + step, left - step
            if left > 0:
                out.append((name, "break", clock, pause))
                clock += pause
    return out


@pytest.mark.parametrize("block, pause", [(1.5, 0.25), (0.5, 0.5), (3.0, 0.1)])
def test_block_schedule_follows_the_clock(spark, many_partitions, block, pause):
    draw = random.Random(9)
    hours = [0.5 * draw.randint(0, 9) for _ in range(60)]
    rows = [(1, i, f"S{i:02}", 3, 100.0, h) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "request_id long, pos int, name string, priority int, total_hours double, hours double")
    got = P.block_schedule(df, "2025-01-01 09:00:00", block, pause)
    start = F.timestamp_diff("MICROSECOND", F.lit("2025-01-01 09:00:00").cast("timestamp_ntz"), "starts_at") / 3600e6
    got = got.withColumn("at", start).orderBy("at").collect()
    want = walk([(f"S{i:02}", h) for i, h in enumerate(hours)], block, pause)
    assert [(r.name, r.kind) for r in got] == [(n, k) for n, k, _, _ in want]
    assert [r.at for r in got] == pytest.approx([a for _, _, a, _ in want])
    assert [r.duration for r in got] == pytest.approx([d for _, _, _, d in want])
    assert got[0].start_label == "09:00 AM"


def test_labels_pass_noon_and_midnight(spark):
    rows = [(1, i, f"S{i:02}", 3, 100.0, 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "request_id long, pos int, name string, priority int, total_hours double, hours double")
    got = P.block_schedule(df, "2025-01-01 10:45:30.5").withColumn("want", F.date_format("starts_at", "hh:mm a")).collect()
    assert len(got) == 60 and all(r.start_label == r.want for r in got)
    assert {"11:45 AM", "12:15 PM", "11:45 PM", "12:15 AM"} <= {r.end_label for r in got}


def test_schedule_shuffles_a_joined_plan_no_further_and_formats_no_dates(spark):
    plan = P.allocate_softmax(table(spark, {i: (6.0, [(3, 3, 0.5)] * 4) for i in range(200)}))
    text = P.block_schedule(plan)._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" not in text and "date_format" not in text and "decimal" not in text


def test_proportional_plan_keeps_no_copy_of_the_items(spark, monkeypatch):
    """Items are not written out, the shapes of small plans are no table, and joined rows are not dealt out again."""
    kept = []
    monkeypatch.setattr(P, "checkpointed", lambda df: kept.append(df.columns) or df)
    requests = {i: (6.0, [(5, 1, 0.5), (1, 1, 9.0), (1 + i % 5, 1, 0.25)]) for i in range(20)}
    text = P.allocate_proportional(table(spark, requests).filter("pos >= 0"))._jdf.queryExecution().executedPlan().toString()
    assert not any("name" in columns for columns in kept)
    last = text[: text.index("SortMergeJoin")]
    assert "shufflepartitionidpassthrough" not in last and "shape" not in last


def test_schedule_of_nothing(spark):
    empty = spark.createDataFrame([(1, 0, "S", 3, 6.0, 0.0)], "request_id long, pos int, name string, priority int, total_hours double, hours double")
    assert records(P.block_schedule(empty), "name") == []


def test_a_quotient_just_below_a_whole_number_counts_as_it(spark):
    got = plan(P.allocate_proportional(table(spark, {1: (1.2, [(1, 1, 0.4)] * 3)})))
    assert len(got[1]) == 3


@pytest.mark.parametrize("priority", [0, 6, None])
def test_unknown_priorities_are_refused(spark, priority):
    with pytest.raises(Exception, match="priority must be 1 to 5"):
        P.allocate_proportional(table(spark, {1: (6.0, [(3, 1, 0.5), (priority, 1, 0.5), (2, 1, 0.5)])})).collect()


def test_minimums_off_the_half_hour(spark):
    requests = {i: (1.0 + i / 7, [(1 + (i + k) % 5, 1, round(0.1 * ((3 * i + k) % 7), 1)) for k in range(4)]) for i in range(1, 40)}
    got = plan(P.allocate_proportional(table(spark, requests)))
    for rid, (hours, items) in requests.items():
        want = brute(hours, items)
        assert len(got.get(rid, {})) == (0 if want is None else len(want)), rid
