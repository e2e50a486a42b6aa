import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from studylattice.operators import planner
from studylattice.plans import ordered, skew
from studylattice.plans.nearest import nearest
from studylattice.plans.ordered import indexed_sums, with_position, with_running_sums


def skewed(spark, n=3000, seed=3):
    """A third of all rows in one key, one key per row at the other end, and a NULL key."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 101 == 0 else f"k{draw.randrange(400)}"
        rows.append((key, draw.randrange(50), i, float(draw.randrange(10)) if draw.random() < 0.9 else None))
    pdf = pd.DataFrame(rows, columns=["key", "t", "id", "v"])
    df = spark.createDataFrame(rows, "key string, t int, id int, v double").repartition(5)
    return df, pdf


def by_time():
    return [F.col("t").asc(), F.col("id").asc()]


def test_a_hot_key_is_spread_over_partitions(spark, many_partitions):
    df, _ = skewed(spark)
    placed = ordered._placed(df, ["key"], by_time())
    parts = placed.filter("key = 'hot'").select("_part").distinct().count()
    assert parts >= 2
    assert placed.groupBy("_part").count().agg(F.max("count")).first()[0] < 3000 / 3


def test_positions_match_a_sort(spark, many_partitions):
    df, pdf = skewed(spark)
    got = with_position(df, ["key"], by_time(), "place").toPandas()
    pdf = pdf.sort_values(["t", "id"])
    pdf["place"] = pdf.groupby("key", dropna=False).cumcount() + 1
    assert dict(zip(got.id, got.place)) == dict(zip(pdf.id, pdf.place))


def test_global_rank_is_dense_and_ordered(spark, many_partitions):
    df, pdf = skewed(spark)
    got = with_position(df, [], [F.col("t").desc(), F.col("id").asc()], "place").toPandas()
    want = pdf.sort_values(["t", "id"], ascending=[False, True]).id.tolist()
    assert got.sort_values("place").id.tolist() == want
    assert sorted(got.place) == list(range(1, len(pdf) + 1))


def test_running_sums_match_a_loop(spark, many_partitions):
    df, pdf = skewed(spark)
    got = with_running_sums(df.fillna(0.0, ["v"]), ["key"], by_time(), {"s": F.col("v"), "n": F.lit(1)}).toPandas()
    pdf = pdf.fillna({"v": 0.0}).sort_values(["t", "id"])
    pdf["s"] = pdf.groupby("key", dropna=False)["v"].cumsum()
    assert dict(zip(got.id, got.s)) == dict(zip(pdf.id, pdf.s))


def test_indexed_sums_skip_null_values(spark, many_partitions):
    df, pdf = skewed(spark)
    got = indexed_sums(df, ["key"], by_time(), F.col("v"), {"rows": (F.count("*"), F.sum)}).toPandas()
    for key, group in pdf.sort_values(["t", "id"]).groupby("key", dropna=False):
        row = got[got.key.isna()] if pd.isna(key) else got[got.key == key]
        values = group.v.dropna().tolist()
        assert row.n.item() == len(values)
        assert row.total.item() == sum(values)
        assert row.index_total.item() == sum(i * v for i, v in enumerate(values))
        assert row.rows.item() == len(group)


def brute(points, weight):
    best = {}

    def settled(value):
        return None if value is None else round(value, 9)

    points = [(k, settled(None if x is None else weight * x), settled(y)) for k, x, y in points]
    for key, x, y in points:
        others = [
            (abs(y2 - y) + abs(x2 - x), k2)
            for k2, x2, y2 in points
            if k2 != key and None not in (x, y, x2, y2)
        ]
        distance, peer = min(others, default=(None, None))
        best[key] = (peer, distance)
    return best


def clouds(kind, draw):
    if kind == "spread":
        return [(i, draw.uniform(0, 100), draw.uniform(1, 3)) for i in range(300)]
    if kind == "grid":  # many equal distances
        return [(i, 20.0 * draw.randrange(6), draw.randrange(3) / 2 + 1) for i in range(150)]
    if kind == "hot":  # a third at one place, a dense ball, and far points
        same = [(i, 60.0, 2.0) for i in range(60)]
        ball = [(100 + i, 50 + draw.uniform(0, 1e-5), 2 + draw.uniform(0, 1e-5)) for i in range(60)]
        noise = [(300 + i, 30 + i * 1e-12, 1.5 - i * 1e-12) for i in range(60)]
        return same + ball + noise + [(900, 0.0, 1.0), (901, 100.0, 3.0), (902, -5000.0, 1.0), (903, 1e6, 9.0)]
    if kind == "null":
        return [(1, None, 1.0), (2, 10.0, 1.0), (3, 20.0, None), (4, 90.0, 1.0)]
    return [(7, 50.0, 2.0)]


@pytest.mark.parametrize("kind", ["spread", "grid", "hot", "null", "single"])
@pytest.mark.parametrize("weight", [0.4, 0.0])
def test_nearest_is_exact(spark, kind, weight):
    points = clouds(kind, random.Random(11))
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {r.key: (r.peer, r.distance) for r in nearest(df, "id", "x", "y", weight).collect()}
    want = brute(points, weight)
    assert got.keys() == want.keys()
    for key, (peer, distance) in want.items():
        assert got[key][0] == peer, key
        assert got[key][1] == pytest.approx(distance, abs=1e-12) if distance is not None else got[key][1] is None


@pytest.fixture
def small_splits(spark):
    """Let AQE split partitions of a few hundred rows."""
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture
def nothing_is_small(spark, many_partitions):
    """Shuffle joins only."""
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in settings}
    for name in settings:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_totals_reach_all_rows_and_a_hot_key_stays_spread(spark, nothing_is_small, small_splits):
    df, pdf = skewed(spark)
    df = df.filter("key is not null")
    totals = df.groupBy("key").agg(F.sum("t").alias("sum_t"), F.count("*").alias("n"), F.max(F.lit(None)).alias("nothing"))
    joined = skew.join_totals(df, totals, ["key"]).withColumn("part", F.spark_partition_id()).toPandas()
    want = pdf.dropna(subset=["key"])
    sums = want.groupby("key").t.sum()
    assert sorted(joined.id) == sorted(want.id)
    assert (joined.sum_t == joined.key.map(sums)).all()
    assert joined.nothing.isna().all()
    assert joined[joined.key == "hot"].part.nunique() > 1


def test_identical_rows_of_a_hot_key_stay_spread(spark, nothing_is_small, small_splits):
    df = spark.range(3000).selectExpr("'hot' AS key", "1 AS t").repartition(5)
    joined = skew.join_totals(df, df.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    assert joined.filter("n = 3000").count() == 3000
    assert joined.withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 1


def test_bucketed_sums_shuffle_the_rows_once(spark, many_partitions):
    df, pdf = skewed(spark)
    sums = {"s": F.col("v"), "n": F.lit(1)}
    got = with_running_sums(df.fillna(0.0, ["v"]), ["key"], by_time(), sums, F.col("t"))
    rows = got.toPandas().set_index("id")
    want = pdf.fillna({"v": 0.0}).sort_values(["t", "id"])
    want["s"] = want.groupby("key", dropna=False).v.cumsum()
    want["n"] = want.groupby("key", dropna=False).cumcount() + 1
    want = want.set_index("id").loc[rows.index]
    assert (rows.n == want.n).all() and (rows.s - want.s).abs().max() < 1e-9
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Checkpoint" not in text and "ExternalRDD" not in text


def parts_of(df, place, keys=("key",), parts=8):
    rows, _ = ordered._with_pieces(df, list(keys), place, parts)
    placed = rows.repartitionById(parts, F.col("_slot").cast("int")).withColumn("part", F.spark_partition_id())
    return {r.part: r["count"] for r in placed.groupBy("part").count().collect()}


@pytest.mark.parametrize("leading", ["1", "id % 3", "id"])
def test_a_key_with_any_leading_numbers_lies_evenly(spark, leading):
    """The cuts follow the whole order tuple, and pieces are dealt in turn, not hashed."""
    df = spark.range(200_000).selectExpr("'hot' AS key", f"struct({leading} AS lead, concat('x', id) AS rest) AS pos", "id")
    sizes = parts_of(df, F.col("pos"))
    assert len(sizes) == 8 and max(sizes.values()) < 1.5 * 200_000 / 8


def test_a_third_of_the_rows_in_one_key_lies_evenly(spark):
    df = spark.range(90_000).selectExpr("IF(id % 3 = 0, NULL, id % 5000) AS key", "struct(0 AS a, id AS b) AS pos")
    sizes = parts_of(df, F.col("pos"))
    assert len(sizes) == 8 and max(sizes.values()) < 1.5 * 90_000 / 8


@pytest.mark.parametrize("values", [[None, None], [1.0], [5, 5, 5, 5], list(range(100)), [-2.5, None, 3.5, 3.5, 9.0], [None] * 50 + [1.5] * 50])
def test_pieces_never_fall_along_the_order(spark, values):
    df = spark.createDataFrame([(1, None if v is None else float(v)) for v in values], "key int, p double")
    rows, _ = ordered._with_pieces(df, ["key"], F.col("p"), 4)
    found = [r.b for r in rows.select("p", F.col("_piece._bucket").alias("b")).orderBy(F.col("p").asc_nulls_first(), "b").collect()]
    assert found == sorted(found)


def test_sums_over_struct_places_equal_a_loop(spark, many_partitions):
    df, pdf = skewed(spark)
    df = df.fillna(0.0, ["v"]).withColumn("pos", F.struct("t", "id"))
    got = with_running_sums(df, ["key"], [F.col("pos").asc()], {"s": F.col("v")}, F.col("pos")).toPandas()
    pdf = pdf.fillna({"v": 0.0}).sort_values(["t", "id"])
    pdf["s"] = pdf.groupby("key", dropna=False)["v"].cumsum()
    assert dict(zip(got.id, got.s)) == dict(zip(pdf.id, pdf.s))
    assert with_running_sums(df.limit(0), ["key"], [F.col("pos").asc()], {"s": F.col("v")}, F.col("pos")).count() == 0


def test_hot_keys_are_found_without_a_sample_of_every_task(spark, monkeypatch):
    """Keys are counted; only if one is hot are rows drawn, by a share and not the first ones of each task."""
    df = spark.range(4000).selectExpr("id % 1000 AS key", "id AS p")
    monkeypatch.setattr(type(df), "sample", None)
    assert ordered._hot_cuts(df, ["key"], F.col("p"), 4) == []
    monkeypatch.undo()
    limits, limit = [], type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: limits.append(n) or limit(self, n))
    (key, cuts), = ordered._hot_cuts(df.withColumn("key", F.expr("IF(p < 2000, -1, key)")), ["key"], F.col("p"), 4)
    assert key.key == -1 and cuts == sorted(cuts) and set(limits) <= {1}


def test_joined_rows_of_a_hot_key_are_cut(spark, many_partitions):
    df, pdf = skewed(spark)
    df = df.fillna(0.0, ["v"]).withColumn("pos", F.struct("t", "id"))
    for rows in (df, df.filter("key <> 'hot' AND key < 'k2'")):
        got = with_running_sums(rows, ["key"], [F.col("pos").asc()], {"s": F.col("v")}, F.col("pos"), joined=True)
        cut = "shufflepartitionidpassthrough" in got._jdf.queryExecution().executedPlan().toString()
        got = got.toPandas()
        want = pdf[pdf.id.isin(got.id)].fillna({"v": 0.0}).sort_values(["t", "id"])
        want["s"] = want.groupby("key", dropna=False)["v"].cumsum()
        assert dict(zip(got.id, got.s)) == dict(zip(want.id, want.s))
        assert cut == ("hot" in set(want.key))


def test_rows_without_totals_are_left_out(spark):
    df, _ = skewed(spark)
    totals = df.filter("key = 'hot'").groupBy("key").agg(F.count("*").alias("n"))
    assert {r.key for r in skew.join_totals(df, totals, ["key"]).collect()} == {"hot"}


def test_a_hot_request_is_planned_like_any_other(spark, nothing_is_small):
    items = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 7L, 1000 + id % 300) AS request_id",
        "id AS pos",
        "concat('S', id) AS name",
        "CAST(1 + id % 5 AS INT) AS priority",
        "CAST(1 + id % 4 AS INT) AS difficulty_level",
        "0.5D * (id % 4) AS min_hours",
        "2000.0D AS total_hours",
    )
    plan = planner.allocate_softmax(items).toPandas()
    assert sorted(plan.pos) == list(range(3000))
    assert plan[plan.request_id == 7].hours.sum() == pytest.approx(2000, rel=0.05)
    assert len(planner.allocate_proportional(items).filter("request_id = 7").collect()) > 500
    shares = planner.plan_shares(planner.allocate_softmax(items)).groupBy("request_id").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(100) for r in shares.collect())
