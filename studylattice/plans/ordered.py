"""Ordered work inside groups of any size.

A ``Window`` partitioned by a hot key sorts that key's rows in one task. Here rows are
range-partitioned by (key, order) instead, so one key can spread over many partitions, and
the pieces of a key (its *runs*) are stitched together from one small row per run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylattice.session import checkpointed

# A row's place: the partition it is in, and its index there after sorting.
PART, INDEX = "_part", "_index"
# Sampled rows, and pieces of hot keys, for each partition, and the most rows of a sample.
_SAMPLED, _PIECES, _MOST_SAMPLED = 64, 2, 1 << 17
_INDEX_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    sort = [F.col(k).asc() for k in keys] + list(order)
    spot = F.monotonically_increasing_id()
    return (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_spot", spot)
        .withColumn(PART, F.shiftright("_spot", _INDEX_BITS))
        .withColumn(INDEX, F.col("_spot").bitwiseAND((1 << _INDEX_BITS) - 1))
        .drop("_spot")
    )


def _before(column: str, keys: Sequence[str]) -> Column:
    """Sum of ``column`` over the earlier runs of the same key."""
    window = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def indexed_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    extra: Mapping[str, tuple[Column, Callable[[Column], Column]]] | None = None,
) -> DataFrame:
    """Per key: ``n``, ``total`` = sum(value), ``index_total`` = sum(index * value).

    ``index`` is the 0-based position of the row among the key's rows with a non-null
    ``value``, by ``order`` (which must be a total order). Rows with a NULL value take no
    index but still reach ``extra``: name -> (aggregate per run, function merging runs). An
    aggregate may use ``INDEX``, the row's place in its run, and a merge ``PART``, the run's
    place in its key.

    One shuffle of the rows; after it only one row per (key, partition) moves.
    """
    extra = extra or {}
    valued = F.col("_value").isNotNull()
    rows = df.withColumn("_value", value.cast("double"))
    # NULL values sort last in their key, so a run's valued rows are its first rows.
    runs = (
        _placed(rows, keys, [F.col("_value").isNull().asc(), *order])
        .groupBy(*keys, PART)
        .agg(
            F.count("_value").alias("_n"),
            F.min(INDEX).alias("_first"),
            F.coalesce(F.sum("_value"), F.lit(0.0)).alias("_total"),
            F.coalesce(F.sum(F.when(valued, F.col(INDEX) * F.col("_value"))), F.lit(0.0)).alias(
                "_index_total"
            ),
            *[partial.alias(name) for name, (partial, _) in extra.items()],
        )
        .withColumn("_shift", _before("_n", keys) - F.col("_first"))
    )
    return runs.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.sum("_total").alias("total"),
        F.sum(F.col("_index_total") + F.col("_shift") * F.col("_total")).alias("index_total"),
        *[merge(F.col(name)).alias(name) for name, (_, merge) in extra.items()],
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, place: Column | None = None, joined: bool = False
) -> DataFrame:
    """Add the 1-based position of each row in its key by a total ``order``; without keys, a
    global rank. Runs a job."""
    return with_running_sums(df, keys, order, {name: F.lit(1)}, place, joined)


def _hot_cuts(df: DataFrame, keys: Sequence[str], place: Column, parts: int) -> list[tuple[Row, list[Row]]]:
    """Keys with more than half a partition's share of the rows, and the places to cut each at, so that
    a piece holds about half a partition. Runs a job.

    The counts of all keys tell whether there are any; only then the places come from a uniform sample of about
    _SAMPLED rows a partition, _MOST_SAMPLED in all. The sample decides how evenly rows lie, never a result.
    Neither step brings more than a row a key, or the sample, to one task.
    """
    total, largest = df.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    if not total or round(largest / max(1.0, total / (_PIECES * parts))) <= 1:
        return []
    share = min(1.0, min(_SAMPLED * parts, _MOST_SAMPLED) / total)
    sample = df.select(F.struct(*keys).alias("key"), F.struct(place.alias("place")).alias("place")).sample(share, seed=parts)
    drawn = sample.repartition(1).sortWithinPartitions("key", "place").collect()
    half = max(1.0, len(drawn) / (_PIECES * parts))
    found = []
    for key, rows in groupby(drawn, lambda r: r.key):
        places = [r.place for r in rows]
        pieces = round(len(places) / half)
        if pieces > 1:
            cuts = [places[i * len(places) // pieces - 1] for i in range(1, pieces)]
            found.append((key, [c for c, _ in groupby(cuts)]))
    return found


def _with_pieces(df: DataFrame, keys: Sequence[str], place: Column, parts: int) -> tuple[DataFrame, bool]:
    """Add ``_slot``, the partition of a row, and ``_piece``, its key and which of the key's pieces it
    lies in; also whether any key has several. Pieces follow each other along ``place`` and are dealt to the
    partitions in turn; a key in one piece goes by its hash. Runs a job.

    The cuts have at most a row for each sampled row, so they are broadcast.
    """
    hot = _hot_cuts(df, keys, place, parts)
    slot = F.pmod(F.hash(*keys), F.lit(parts))
    if not hot:
        return df.withColumns({"_slot": slot, "_piece": F.struct(*keys, F.lit(0).alias("_bucket"))}), False
    table, base = [], 0
    for key, cuts in hot:
        # Two steps of about the square root each, instead of looking at every cut.
        width = max(1, int(len(cuts) ** 0.5))
        table.append((key, base, width, [cuts[i : i + width] for i in range(0, len(cuts), width)]))
        base += len(cuts) + 1
    spot = F.struct(place.alias("place"))
    kinds = df.select(F.struct(*keys).alias("key"), spot.alias("place")).schema
    schema = T.StructType(
        [
            T.StructField("_key", kinds["key"].dataType),
            T.StructField("_base", T.IntegerType()),
            T.StructField("_width", T.IntegerType()),
            T.StructField("_steps", T.ArrayType(T.ArrayType(kinds["place"].dataType))),
        ]
    )
    cuts = F.broadcast(df.sparkSession.createDataFrame(table, schema))
    above = F.greatest(F.size(F.filter("_steps", lambda step: step[0] < F.col("_spot"))) - 1, F.lit(0))
    own = F.get("_steps", F.col("_above"))
    bucket = F.col("_above") * F.col("_width") + F.size(F.filter(own, lambda cut: cut < F.col("_spot")))
    rows = (
        df.withColumns({"_key_of": F.struct(*keys), "_spot": spot})
        .join(cuts, F.col("_key_of") == F.col("_key"), "left")
        .withColumn("_above", above)
        .withColumn("_bucket", F.when(F.col("_base").isNotNull(), bucket).otherwise(0))
        .withColumn("_slot", F.when(F.col("_base").isNotNull(), F.pmod(F.col("_base") + F.col("_bucket"), F.lit(parts))).otherwise(slot))
        .withColumn("_hot", F.col("_base").isNotNull())
        .withColumn("_piece", F.struct(*keys, "_bucket"))
    )
    return rows.select(*df.columns, "_slot", "_piece", "_hot"), True


def _bucketed_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], place: Column, joined: bool
) -> DataFrame:
    """Running sums inside a piece of a key, plus the sums of the key's earlier pieces.

    The rows are shuffled once, to the partition of their piece; ``joined`` rows without hot keys stay where they
    are. Only keys in several pieces are added up beforehand, a row a piece, no more than a fixed number for each
    partition.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = {f"_v_{name}": column for name, column in sums.items()}
    rows, several = _with_pieces(df.withColumns(values), keys, place, parts)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if joined and not several:
        own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return rows.select(*df.columns, *[F.sum(v).over(own).alias(name) for name, v in zip(sums, values)])
    # The keys come first: a sort compares them before it looks into structs.
    inside = Window.partitionBy(*keys, "_slot", "_piece").orderBy(*order).rowsBetween(*upto)
    placed = rows.repartitionById(parts, F.col("_slot").cast("int"))
    running = placed.withColumns({f"{v}_here": F.sum(v).over(inside) for v in values})
    if not several:
        return running.select(*df.columns, *[F.col(f"{v}_here").alias(name) for name, v in zip(sums, values)])
    pieces = rows.filter("_hot").groupBy("_piece").agg(*[F.sum(v).alias(f"{v}_sum") for v in values])
    earlier = (
        Window.partitionBy(*[F.col(f"_piece.{k}") for k in keys])
        .orderBy("_piece._bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = pieces.select(
        F.col("_piece").alias("_of"), *[F.sum(f"{v}_sum").over(earlier).alias(f"{v}_base") for v in values]
    )
    totals = [
        (F.col(f"{v}_here") + F.coalesce(F.col(f"{v}_base"), F.lit(0))).alias(name) for name, v in zip(sums, values)
    ]
    return running.join(F.broadcast(bases), F.col("_piece") == F.col("_of"), "left").select(*df.columns, *totals)


def with_running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    place: Column | None = None,
    joined: bool = False,
) -> DataFrame:
    """Add, per row, the sums over the rows of its key up to and including itself.

    ``order`` must be a total order inside a key. Given a ``place`` that never falls along ``order`` (NULLs
    first; a number, a text or a struct), rows are shuffled once, and the keys that many rows have are cut at
    sampled places. Give it the whole order: rows with equal places stay together. Say ``joined`` if the rows come
    out of a join by ``keys`` or some of them: without hot keys they are not shuffled again. Without a place rows
    are placed by range: inside a run the sum is a window over
    (key, partition), so no task holds more than one partition of a key. The placed rows are
    checkpointed, because their partition numbers are used twice and must not change between
    the two. Runs a job.
    """
    if place is not None and keys:
        return _bucketed_sums(df, keys, order, sums, place, joined)
    values = {f"_v_{name}": column for name, column in sums.items()}
    placed = checkpointed(_placed(df.withColumns(values), keys, order))
    runs = placed.groupBy(*keys, PART).agg(*[F.sum(v).alias(f"{v}_run") for v in values])
    for v in values:
        runs = runs.withColumn(f"{v}_base", _before(f"{v}_run", keys))
    # Only the first key of a partition can continue from an earlier one, so at most one row
    # per partition passes this filter: a bound that does not grow with the rows.
    continued = F.row_number().over(Window.partitionBy(*keys).orderBy(PART)) > 1
    moved = (
        runs.withColumn("_continued", continued)
        .filter("_continued")
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col(PART).alias("_p"),
            *[f"{v}_base" for v in values],
        )
    )
    match = F.col(PART) == F.col("_p")
    for key in keys:
        match &= F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    inside = (
        Window.partitionBy(*keys, PART)
        .orderBy(INDEX)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = [
        (F.sum(v).over(inside) + F.coalesce(F.col(f"{v}_base"), F.lit(0))).alias(name)
        for name, v in zip(sums, values)
    ]
    return placed.join(F.broadcast(moved), match, "left").select(*df.columns, *totals)
