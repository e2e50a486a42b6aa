"""Study hours for many planning requests at once, and the day plan built from them.

``items`` has one row per subject of a request: request_id, pos (its place in the request),
name, priority (1..5), difficulty_level (1..5), min_hours and total_hours (of the request).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylattice import constants as K
from studylattice.functions import rules
from studylattice.plans.ordered import with_position, with_running_sums
from studylattice.plans.skew import join_totals
from studylattice.session import checkpointed

PRIORITIES = (1, 2, 3, 4, 5)
_PLAN = ["request_id", "pos", "name", "priority", "total_hours", "hours"]


def _softmax(items: DataFrame, score: Column) -> DataFrame:
    """Minimum hours plus a softmax share of what is left; requests whose minimums exceed
    their hours have no plan. Totals are joined back, so a large request stays spread."""
    totals = items.groupBy("request_id").agg(
        F.sum("min_hours").alias("needed"), F.sum(F.exp(score)).alias("mass")
    )
    share = (F.col("total_hours") - F.col("needed")) * F.exp(score) / F.col("mass")
    return (
        join_totals(items, totals, ["request_id"])
        .filter(rules.settled(F.col("needed")) <= rules.settled(F.col("total_hours")))
        .withColumn("hours", rules.half_steps(F.col("min_hours") + share))
        .select(*_PLAN)
    )


def allocate_softmax(items: DataFrame) -> DataFrame:
    return _softmax(items, F.col("priority").cast("double"))


def allocate_balanced(items: DataFrame) -> DataFrame:
    """Softmax over a mix of priority and difficulty."""
    mix = 0.6 * (F.col("priority") / 5.0) + 0.4 * (F.col("difficulty_level") / 5.0)
    return _softmax(items, 2.0 * mix)


def _budget() -> Column:
    """Most priority points a plan may hold if this item's minimum is to be met.

    Hours are shared in proportion to priority, so an item gets its minimum m when
    (points * m / p) fits into the request's hours.
    """
    points = F.col("total_hours") * F.col("priority") / F.col("min_hours")
    # 1.2 / 0.4 is a little under 3: settle the quotient before it is cut.
    whole = F.floor(rules.settled(points)).cast("double")
    return F.when(F.col("min_hours") <= 0, F.lit(float("inf"))).otherwise(whole)


def _demand() -> Column:
    return F.col("min_hours") / F.col("priority")


def allocate_proportional(items: DataFrame) -> DataFrame:
    """As many subjects as possible, then as many hours as possible, hours proportional to
    priority.

    A set S can use t = H / max(points(S), highest priority) hours per point, and is possible
    when every demand m/p in S is at most t. It uses all H hours unless points(S) is below
    the highest priority. Sets of equal size and hours: the lowest demand wins, then the
    fewest points, then the fewest subjects of priority 5, of 4, and so on, then the first
    subjects of the request.

    Per request the work is one ordered pass over its distinct demands; no subsets of the
    request are formed. Runs jobs.
    """
    known = F.coalesce(F.col("priority").isin(*PRIORITIES), F.lit(False))
    priority = F.when(known, F.col("priority")).otherwise(
        F.raise_error(F.concat(F.lit("priority must be 1 to 5, not "), F.coalesce(F.col("priority").cast("string"), F.lit("NULL")))).cast("int")
    )
    # Read three times with few columns each, which costs less than a copy of all of them.
    measured = items.withColumn("priority", priority).withColumns({"demand": _demand(), "budget": _budget()})
    counts = [F.count_if(F.col("priority") == p).alias(f"n{p}") for p in PRIORITIES]
    bands = checkpointed(
        measured.groupBy("request_id", "demand").agg(
            F.max("budget").alias("budget"), F.max("priority").alias("band_highest"), *counts
        )
    )
    highest = bands.groupBy("request_id").agg(F.max("band_highest").alias("highest"))
    bands = bands.drop("band_highest")
    upto = with_running_sums(
        bands, ["request_id"], [F.col("demand").asc()], {f"upto{p}": F.col(f"n{p}") for p in PRIORITIES}, F.col("demand")
    )
    upto = join_totals(upto, highest, ["request_id"]).filter("budget >= highest")

    # The most subjects within the budget: the cheapest priorities first.
    left = F.col("budget")
    for p in PRIORITIES:
        upto = upto.withColumn(f"c{p}", F.floor(F.least(F.col(f"upto{p}").cast("double"), left / p)).cast("bigint"))
        left = left - p * F.col(f"c{p}")
    picked = [f"c{p}" for p in PRIORITIES]
    size = sum((F.col(c) for c in picked[1:]), F.col(picked[0]))
    points = sum((p * F.col(f"c{p}") for p in PRIORITIES[1:]), F.col("c1"))
    best = F.struct(size.alias("size"), (-F.col("demand")).alias("ease"))
    rest = F.struct("demand", "highest", points.alias("points"), *picked)
    widest = (
        upto.groupBy("request_id")
        .agg(F.max(best).alias("best"), F.max_by(rest, best).alias("set"))
        .select("request_id", F.col("best.size").alias("size"), "set.*")
    )
    widest = checkpointed(widest)  # one row per request
    sets, unfilled = widest.filter("points >= highest").drop("size"), widest.filter("points < highest")
    if not unfilled.isEmpty():
        sets = checkpointed(sets.unionByName(_fullest_small_sets(measured, unfilled)))

    taken = F.element_at(F.array(*picked), F.col("priority"))
    eligible = (
        join_totals(measured, sets.withColumnRenamed("demand", "limit"), ["request_id"])
        .filter("demand <= limit")
        .withColumn("taken", taken)
        .filter("taken > 0")
    )
    ranked = with_position(
        eligible.select("request_id", "pos", "name", "priority", "total_hours", "points", "highest", "taken"),
        ["request_id", "priority"],
        [F.col("pos").asc()],
        "place",
        F.col("pos"),
        joined=True,
    ).filter("place <= taken")
    per_point = F.col("total_hours") / F.greatest("points", "highest")
    return ranked.withColumn("hours", rules.half_steps(F.col("priority") * per_point)).select(*_PLAN)


def _fullest_small_sets(measured: DataFrame, widest: DataFrame) -> DataFrame:
    """Best sets for requests whose cheapest set leaves hours unused.

    Such a set has fewer points than the highest priority, so at most four subjects; the
    possible numbers of subjects per priority are a fixed list of 125.
    """
    most = PRIORITIES[-1] - 1
    shapes = [s for s in product(range(most + 1), repeat=len(PRIORITIES)) if 0 < sum(s) <= most]
    # Only the least demanding few of every priority can matter. The limit comes first: Spark
    # applies it before the shuffle, so a large request never reaches the join whole.
    least = Window.partitionBy("request_id", "priority").orderBy("demand", "pos")
    lists = (
        measured.withColumn("nth", F.row_number().over(least))
        .filter(F.col("nth") <= most)
        .join(widest.select("request_id", "size", "highest"), "request_id")
        .groupBy("request_id", "size", "highest")
        .agg(*[
            F.array_sort(F.collect_list(F.when(F.col("priority") == p, F.struct("demand", "budget")))).alias(f"d{p}")
            for p in PRIORITIES
        ])
    )
    # 125 shapes; a request meets those of its own size only.
    of_size = [F.array(*[F.array(*map(F.lit, s)) for s in shapes if sum(s) == n]) for n in range(1, most + 1)]
    tried = lists.withColumn("shape", F.explode(F.get(F.array(*of_size), F.col("size").cast("int") - 1)))
    counts = {p: F.col("shape")[i] for i, p in enumerate(PRIORITIES)}
    points = sum((p * counts[p] for p in PRIORITIES[1:]), counts[1])
    available = F.lit(True)
    for p in PRIORITIES:
        available &= counts[p] <= F.size(f"d{p}")
    tried = tried.filter(available)

    def hardest(field: str) -> list[Column]:
        return [F.when(counts[p] > 0, F.get(F.col(f"d{p}"), counts[p] - 1)[field]) for p in PRIORITIES]

    tried = tried.select(
        "request_id",
        "highest",
        points.cast("bigint").alias("points"),
        F.greatest(*hardest("demand")).alias("demand"),
        F.least(*hardest("budget")).alias("budget"),
        *[counts[p].cast("bigint").alias(f"c{p}") for p in PRIORITIES],
    ).filter(F.col("budget") >= F.greatest("points", "highest"))
    choice = F.struct(
        (-F.least("points", "highest")).alias("unused"),
        "demand",
        "points",
        *[f"c{p}" for p in reversed(PRIORITIES)],
        "highest",
    )
    return tried.groupBy("request_id").agg(F.min(choice).alias("set")).select(
        "request_id", "set.demand", "set.highest", "set.points", *[f"set.c{p}" for p in PRIORITIES]
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    """Subjects, hours and use of the available time per request."""
    return plan.groupBy("request_id").agg(
        F.count("*").alias("subjects"),
        F.sum("hours").alias("hours"),
        (F.try_divide(F.sum("hours"), F.max("total_hours")) * 100.0).alias("utilisation"),
    )


def plan_shares(plan: DataFrame) -> DataFrame:
    """Every subject's share of its request's planned hours."""
    totals = plan.groupBy("request_id").agg(F.sum("hours").alias("planned"))
    return join_totals(plan, totals, ["request_id"]).select(
        "request_id", "name", "hours", (F.try_divide(F.col("hours"), F.col("planned")) * 100.0).alias("share")
    )


def block_schedule(
    plan: DataFrame,
    start: str = K.AS_OF,
    block_hours: float = K.STUDY_BLOCK_HOURS,
    break_hours: float = K.BREAK_HOURS,
) -> DataFrame:
    """Study blocks, with breaks between the blocks of one subject, on a running clock.

    A subject's blocks follow from its start, so only the starts need a running sum, over the
    subjects and not over the blocks. Runs a job.
    """
    blocks = F.ceil(rules.settled(F.col("hours") / block_hours)).cast("int")
    length = F.col("hours") + (F.col("blocks") - 1) * break_hours
    subjects = plan.filter("hours > 0").withColumn("blocks", blocks).withColumn("length", length)
    timed = with_running_sums(
        subjects.select("request_id", "pos", "name", "hours", "blocks", "length"),
        ["request_id"],
        [F.col("pos").asc()],
        {"until": F.col("length")},
        F.col("pos"),
        joined=True,
    )
    begin = F.col("until") - F.col("length") + F.col("block") * (block_hours + break_hours)
    study = F.struct(
        F.lit("study").alias("kind"),
        begin.alias("offset"),
        F.least(F.lit(block_hours), F.col("hours") - F.col("block") * block_hours).alias("duration"),
    )
    pause = F.struct(
        F.lit("break").alias("kind"), (begin + block_hours).alias("offset"), F.lit(break_hours).alias("duration")
    )
    last = F.col("block") == F.col("blocks") - 1
    slots = timed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "request_id", "name", "block", F.explode(F.when(last, F.array(study)).otherwise(F.array(study, pause))).alias("slot")
    )

    # Whole microseconds: a decimal and two date formats for every block would cost more than all the rest.
    opening = F.lit(start).cast("timestamp_ntz")
    second = F.date_part(F.lit("SECOND"), opening).cast("double")
    midnight = F.rint((F.hour(opening) * 3600 + F.minute(opening) * 60 + second) * 1e6).cast("bigint")
    microsecond = F.make_dt_interval(secs=F.lit("0.000001").cast("decimal(18, 6)"))

    def micros(offset: Column) -> Column:
        return F.rint(offset * 3600e6).cast("bigint")

    def label(moment: Column) -> Column:
        """The time of day as ``hh:mm a``."""
        minute = F.floor(F.pmod(midnight + moment, F.lit(86_400_000_000)) / 60e6).cast("int")
        hour = F.floor(minute / 60).cast("int")
        digits = [F.lpad(n.cast("string"), 2, "0") for n in (F.pmod(hour + 11, F.lit(12)) + 1, minute % 60)]
        return F.concat(digits[0], F.lit(":"), digits[1], F.when(hour < 12, " AM").otherwise(" PM"))

    offset, duration = F.col("slot.offset"), F.col("slot.duration")
    return slots.select(
        "request_id",
        "name",
        "block",
        F.col("slot.kind").alias("kind"),
        (opening + microsecond * micros(offset)).alias("starts_at"),
        label(micros(offset)).alias("start_label"),
        label(micros(offset + duration)).alias("end_label"),
        duration.alias("duration"),
    )
