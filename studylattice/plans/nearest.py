"""Exact nearest neighbours in the plane under |dx| + |dy|, without comparing all pairs.

Points are laid on nested square grids whose cells halve in width from level to level. A
point's *search level* is two above the first level at which it is alone in its cell: one
level below that it shared a cell of width w, so its nearest neighbour is closer than 2w, and
all points that close lie in the 3x3 cells around it on the grid of width 2w.

A searching point is alone in a cell a quarter as wide as the grid it searches, so a cell
serves at most 16 searching points per neighbour cell, however many points it holds: the
candidate pairs grow with the number of points, not with its square. Points at the very same
place are merged first and need no search at all.

Coordinates are settled to nine decimals first, so averages that differ by float noise are the same
place. Two places are then further apart than a cell of the finest grid, and everyone is alone there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylattice.functions import rules
from studylattice.session import checkpointed

# Cell widths run from 2^7 down to 2^-32, below the 1e-9 that settled places are apart; level 0 is one
# cell that holds everything.
_WIDEST_EXPONENT = 7
_LEVELS = 40


def _cell(value: Column, level: Column) -> Column:
    """Grid coordinate at ``level``; dividing by a power of two is exact."""
    width = F.pow(F.lit(2.0), F.lit(_WIDEST_EXPONENT + 1.0) - level)
    return F.when(level == 0, F.lit(0).cast("bigint")).otherwise(F.floor(value / width))


def nearest(points: DataFrame, key: str, x: str, y: str, x_weight: float) -> DataFrame:
    """For every row of ``points`` (unique ``key``, position ``x``, ``y``): the other row
    nearest to it by |dy| + x_weight * |dx|, to nine decimals of y and of x_weight * x, ties to the
    lowest key, as (key, peer, distance).

    A row with a NULL coordinate, and a row without any other, gets a NULL peer. ``points``
    is read three times; hand in a kept table rather than a long computation. Runs a job.
    """
    weight = F.lit(float(x_weight))
    points = points.select(
        F.col(key).alias("key"),
        rules.settled(weight * F.col(x)).alias("x"),
        rules.settled(F.col(y).cast("double")).alias("y"),
    )
    located = points.filter("x is not null and y is not null")

    # The two lowest keys of every place; Spark prunes to two per place before the shuffle.
    lowest = Window.partitionBy("x", "y").orderBy("key")
    places = (
        located.withColumn("n", F.row_number().over(lowest))
        .filter("n <= 2")
        .groupBy("x", "y")
        .agg(F.min("key").alias("first"), F.max("key").alias("second"))
    )
    places = checkpointed(places)  # read four times below
    together = located.join(places.filter("first <> second"), ["x", "y"]).select(
        "key",
        F.when(F.col("key") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("peer"),
        F.lit(0.0).alias("distance"),
    )

    level = F.col("level").cast("double")

    def cells(levels: Column) -> DataFrame:
        on_grids = places.withColumn("level", F.explode(levels))
        return on_grids.withColumns({"cx": _cell(F.col("x"), level), "cy": _cell(F.col("y"), level)})

    alone = (
        cells(F.sequence(F.lit(0), F.lit(_LEVELS)))
        .groupBy("level", "cx", "cy")
        .agg(F.count("*").alias("n"), F.min(F.struct("first", "second")).alias("p"))
        .filter("n = 1 and p.first = p.second")
        .groupBy("p")
        .agg(F.min("level").alias("alone_from"))
    )
    seekers = checkpointed(
        places.filter("first = second")
        .join(alone.select(F.col("p.first").alias("first"), "alone_from"), "first", "left")
        .select(
            F.col("first").alias("key"),
            F.col("x").alias("sx"),
            F.col("y").alias("sy"),
            F.greatest(F.coalesce("alone_from", F.lit(_LEVELS + 1)) - 2, F.lit(0)).alias("level"),
        )
    )
    around = F.when(F.col("level") == 0, F.array(F.lit(0))).otherwise(
        F.array(F.lit(-1), F.lit(0), F.lit(1))
    )
    reach = (
        seekers.withColumn("dx", F.explode(around))
        .withColumn("dy", F.explode(around))
        .select(
            "key",
            "sx",
            "sy",
            "level",
            (_cell(F.col("sx"), level) + F.col("dx")).alias("cx"),
            (_cell(F.col("sy"), level) + F.col("dy")).alias("cy"),
        )
    )
    distance = F.abs(F.col("y") - F.col("sy")) + F.abs(F.col("x") - F.col("sx"))
    # At most one level number per grid: the places are laid on the grids somebody searches only.
    used = sorted(r[0] for r in seekers.select("level").distinct().collect())
    searched = cells(F.array(*[F.lit(n) for n in used]).cast("array<int>"))
    found = (
        reach.join(searched.select("level", "cx", "cy", "x", "y", "first"), ["level", "cx", "cy"])
        .filter(F.col("first") != F.col("key"))
        .groupBy("key")
        .agg(F.min(F.struct(distance.alias("distance"), F.col("first").alias("peer"))).alias("best"))
        .select("key", "best.peer", "best.distance")
    )
    answered = together.unionByName(found)
    return points.select("key").join(answered, "key", "left")
