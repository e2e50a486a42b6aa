"""Learner profiles, clusters, comparisons and study peers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylattice import constants as K
from studylattice.functions import rules
from studylattice.plans import lloyd
from studylattice.plans.nearest import nearest
from studylattice.plans.ordered import with_position
from studylattice.session import checkpointed

FEATURES = ("avg_score", "attempts", "avg_difficulty")


def student_profiles(attempts: DataFrame) -> DataFrame:
    """Mean score percentage, attempts and mean level per user; one aggregation."""
    named = {level.lower(): rank for level, rank in K.LEVEL_RANK.items()}
    level = rules.lookup(F.lower(F.trim("difficulty")), named)
    return attempts.groupBy("user_id").agg(
        F.avg(rules.score_percent()).alias("avg_score"),
        F.count(rules.score_percent()).alias("attempts"),
        F.avg(level).alias("avg_difficulty"),
    )


def scaled_features(profiles: DataFrame) -> DataFrame:
    """z-scores with the population deviation; a constant feature becomes 0.

    All means and deviations come from one scalar subquery: one row, no join.
    """
    facts = [
        f(name).alias(f"{name}_{kind}")
        for name in FEATURES
        for f, kind in ((F.avg, "mean"), (F.stddev_pop, "spread"))
    ]
    whole = profiles.agg(*facts).select(F.struct("*")).scalar()

    def scaled(name: str) -> Column:
        mean, spread = F.col(f"whole.{name}_mean"), F.col(f"whole.{name}_spread")
        return (F.col(name) - mean) / F.when(spread > 0, spread).otherwise(1.0)

    return profiles.withColumn("whole", whole).select("user_id", *[scaled(name).alias(f"{name}_z") for name in FEATURES])


def _points(profiles: DataFrame) -> DataFrame:
    """(user_id, p): scaled features in whole millionths, kept because every step rereads them. Users
    without a feature cannot be clustered and are left out here."""
    features = [lloyd.settle(F.col(f"{name}_z")) for name in FEATURES]
    complete = F.lit(True)
    for name in FEATURES:
        complete &= F.col(f"{name}_z").isNotNull()
    return checkpointed(scaled_features(profiles).filter(complete).select("user_id", F.array(*features).alias("p")))


def _fits(points: DataFrame, ks: Iterable[int], restarts: int, seed: int) -> tuple[DataFrame, dict[int, lloyd.Model]]:
    """The places of the points, and the cheapest fit for every admissible number of clusters."""
    rows = checkpointed(lloyd.places(points))
    users = rows.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    allowed = [k for k in ks if k < users]
    return rows, lloyd.best_of_each(lloyd.fit_all(rows, allowed, restarts, seed)) if allowed else {}


def _scores(rows: DataFrame, fits: dict[int, lloyd.Model]) -> tuple[dict[int, float], int | None]:
    """Silhouettes, and the number of clusters with the best one, of equally good ones the lowest."""
    scores = lloyd.silhouettes(rows, fits.values())
    return scores, min(scores, key=lambda k: (-round(scores[k], 9), k)) if scores else None


def _selectable() -> range:
    low, high = K.CLUSTER_RANGE
    return range(low, high + 1)


def cluster_k_selection(
    profiles: DataFrame, restarts: int = K.CLUSTER_RESTARTS, seed: int = K.MODEL_SEED
) -> DataFrame:
    """Silhouette per number of clusters and the best of them. Runs jobs.

    All fits of all numbers of clusters share their steps. Silhouettes are by squared distance. Too many
    clusters for the users or for their distinct profiles have no row.
    """
    scores, best = _scores(*_fits(_points(profiles), _selectable(), restarts, seed))
    rows = [(k, float(s), k == best) for k, s in sorted(scores.items())]
    return profiles.sparkSession.createDataFrame(rows, "k int, silhouette double, best boolean")


def student_groups(
    profiles: DataFrame,
    k: int | None = None,
    restarts: int = K.CLUSTER_RESTARTS,
    seed: int = K.MODEL_SEED,
) -> DataFrame:
    """Every user's group letter. Runs jobs.

    Of ``restarts`` fits the one with the lowest cost wins; without ``k`` the fits of all numbers of clusters
    are made together and the best silhouette decides. Letters follow the clusters by falling mean score, so
    that equal inputs give equal letters. Users without a feature (no known level, say) get no letter.
    """
    if k is not None and k > 26:
        raise ValueError("groups are named by one letter: at most 26")
    points = _points(profiles)
    rows, fits = _fits(points, _selectable() if k is None else [k], restarts, seed)
    if k is None:
        k = _scores(rows, fits)[1]
    if k not in fits:
        raise ValueError("too few distinct users to form groups")
    model = fits[k]
    filled = [c for c in range(k) if model.sizes[c]]
    ranked = sorted(filled, key=lambda c: (-model.means[c][0], model.means[c]))
    letters = {cluster: chr(ord("A") + place) for place, cluster in enumerate(ranked)}
    centres = F.array(*[F.array(*map(F.lit, centre)) for centre in model.centres])
    grouped = points.select(
        "user_id", rules.lookup(lloyd.nearest(F.col("p"), centres)["cluster"], letters).alias("study_group")
    )
    lacking = F.lit(False)
    for name in FEATURES:
        lacking |= F.col(name).isNull()
    rest = profiles.filter(lacking).select("user_id", F.lit(None).cast("string").alias("study_group"))
    return grouped.unionByName(rest)


def group_positions(groups: DataFrame) -> DataFrame:
    """Members of every group with their place in it by id, one row each, from 1. Runs jobs."""
    grouped = groups.filter("study_group is not null").select("study_group", "user_id")
    return with_position(grouped, ["study_group"], [F.col("user_id").asc()], "position")


def group_members(groups: DataFrame, page_size: int = 1000) -> DataFrame:
    """``group_positions`` as text for display: rows are pages of ``page_size`` members, the key is
    (study_group, page). Runs jobs."""
    return (
        group_positions(groups).withColumn("page", F.expr(f"(position - 1) div {page_size}"))
        .groupBy("study_group", "page")
        .agg(F.array_sort(F.collect_list("user_id")).alias("ids"))
        .select(
            "study_group",
            "page",
            F.size("ids").cast("bigint").alias("members"),
            F.array_join(F.col("ids").cast("array<string>"), ", ").alias("member_ids"),
        )
    )


def compare_users(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Metric by metric comparison, two decimals, for every (first_user, second_user) pair."""
    metrics = F.array(
        F.struct(F.lit("AVG_SCORE").alias("metric"), _two("avg_score").alias("value")),
        F.struct(F.lit("ATTEMPTS").alias("metric"), F.col("attempts").cast("double").alias("value")),
        F.struct(F.lit("AVG_DIFFICULTY").alias("metric"), _two("avg_difficulty").alias("value")),
    )
    cards = profiles.select("user_id", metrics.alias("metrics"))
    first = cards.select(F.col("user_id").alias("first_user"), F.col("metrics").alias("first_metrics"))
    second = cards.select(F.col("user_id").alias("second_user"), F.col("metrics").alias("second_metrics"))
    both = pairs.join(first, "first_user").join(second, "second_user")
    return both.select(
        "first_user", "second_user", F.explode(F.arrays_zip("first_metrics", "second_metrics")).alias("m")
    ).select(
        "first_user",
        "second_user",
        F.col("m.first_metrics.metric").alias("metric"),
        F.col("m.first_metrics.value").alias("first_value"),
        F.col("m.second_metrics.value").alias("second_value"),
    )


def _two(name: str) -> Column:
    return rules.half_even(rules.settled(F.col(name)), 2)


def peer_comparison(profiles: DataFrame, groups: DataFrame | None = None, weight: float = K.PEER_LAMBDA) -> DataFrame:
    """Every user next to the recommended peer, metric by metric; with ``groups`` (user_id,
    study_group) also the group letters of both."""
    pairs = checkpointed(
        peer_recommendation(profiles, weight)
        .filter("peer_id is not null")
        .select(F.col("user_id").alias("first_user"), F.col("peer_id").alias("second_user"))
    )
    rows = compare_users(profiles, pairs)
    return rows if groups is None else with_groups(rows, groups)


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A comparison with the study group of both users."""
    for side in ("first", "second"):
        letters = groups.select(F.col("user_id").alias(f"{side}_user"), F.col("study_group").alias(f"{side}_group"))
        rows = rows.join(letters, f"{side}_user", "left")
    return rows


def peer_recommendation(profiles: DataFrame, weight: float = K.PEER_LAMBDA) -> DataFrame:
    """The closest other user by |difficulty gap| + weight * |score gap|; ties to the lowest id."""
    closest = nearest(profiles, "user_id", "avg_score", "avg_difficulty", weight)
    return closest.select(
        F.col("key").alias("user_id"), F.col("peer").alias("peer_id"), F.col("distance").alias("match_score")
    )
