"""Near-duplicate embeddings: collision-counting projections.

Vectors are projected on many random directions. Two vectors collide in a projection if the one
lies in a window centred on the other; the window is as wide as one standard deviation of the
difference of two vectors that are just similar enough, so those collide in 68 % of the projections
and unrelated ones in far fewer. Pairs that collide often enough, with the bar set so that a true
link is missed once in a million, are verified by their exact cosine.

A label's vectors are sorted by their first projection and cut into blocks; tiles of two blocks
are compared in matrix form. A pair whose first projections differ by more than its distance can
allow is no link, so tiles of blocks that far apart are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylattice.llm.components import UnionFind, components
from studylattice.session import checkpointed

PROJECTIONS = 48
MISSES = 1e-6
BLOCK_VECTORS = 1024
# Cut points of a label's first projections; blocks that stay too large are split by a hash.
CUTS = 256


def directions(dimensions: int, count: int = PROJECTIONS) -> np.ndarray:
    """Random unit vectors as columns, the same for every task."""
    columns = np.random.default_rng(dimensions).normal(size=(dimensions, count))
    return columns / np.linalg.norm(columns, axis=0)


def least_collisions(count: int, misses: float = MISSES) -> int:
    """The largest bar below which a pair at the threshold falls with chance ``misses`` at most."""
    chance, missed = erf(1 / sqrt(2)), 0.0
    for bar in range(count + 1):
        missed += comb(count, bar) * chance**bar * (1 - chance) ** (count - bar)
        if missed > misses:
            return bar
    return count


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """In how many projections (columns) each row of ``right`` lies in the window around each row of
    ``left``: a window is a range of ranks in the sorted projection."""
    counts = np.zeros((len(left), len(right)), np.uint8)
    for mine, others in zip(left.T, right.T):
        order = np.argsort(others, kind="stable")
        ranks = np.empty(len(others), np.uint32)
        ranks[order] = np.arange(len(others), dtype=np.uint32)
        ranked = others[order]
        low = np.searchsorted(ranked, mine - window, "left").astype(np.uint32)
        width = np.searchsorted(ranked, mine + window, "right").astype(np.uint32) - low
        counts += (ranks[None, :] - low[:, None]) < width[:, None]
    return counts


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right`` whose cosine reaches the threshold; of a block with itself
    (``same``) each pair once."""
    dimensions = left.shape[1]
    columns = directions(dimensions)
    window = sqrt(max(0.0, 2 - 2 * threshold)) / sqrt(dimensions) + 1e-9
    units, others = _unit(left), _unit(right)
    bar = least_collisions(PROJECTIONS)
    found = [np.empty((0, 2), np.int64)]
    ahead = others @ columns
    for start in range(0, len(left), BLOCK_VECTORS):
        part = units[start : start + BLOCK_VECTORS] @ columns
        for begin in range(0, len(right), BLOCK_VECTORS):
            counts = _collisions(part, ahead[begin : begin + BLOCK_VECTORS], window)
            i, j = np.nonzero(counts >= bar)
            i, j = i + start, j + begin
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 100_000):
                a, b = left[i[at : at + 100_000]], right[j[at : at + 100_000]]
                cosine = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                good = cosine >= threshold
                found.append(np.stack([i[at : at + 100_000][good], j[at : at + 100_000][good]], 1))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _tile(table: pa.Table, threshold: float) -> pa.Table:
    """Of a tile: per vector the copies it is linked with (links), and a forest of links (b)."""
    sides = []
    for side in (0, 1):
        rows = table.filter(pc.equal(table["side"], side)).sort_by("rep")
        if rows.num_rows:
            vectors = rows["vector"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            sides.append((rows["rep"].to_numpy(), rows["copies"].to_numpy(), vectors))
    same = len(sides) == 1
    (reps, copies, left), (others, more, right) = sides[0], sides[-1]
    i, j = tile_links(left, right, threshold, same)
    counts: dict[int, int] = {}
    for names, rows, weights in ((reps, i, more[j]), (others, j, copies[i])):
        total = np.bincount(rows, weights, len(names)).astype(np.int64)
        for at in np.flatnonzero(total):
            counts[int(names[at])] = counts.get(int(names[at]), 0) + int(total[at])
    forest = UnionFind()
    for a, b in zip(reps[i].tolist(), others[j].tolist()):
        forest.join(a, b)
    nodes = list(counts)
    return pa.table(
        {
            "a": pa.array(nodes, pa.int64()),
            "b": pa.array([forest.find(n) for n in nodes], pa.int64()),
            "links": pa.array([counts[n] for n in nodes], pa.int64()),
        }
    )


@lru_cache(maxsize=64)
def _first_direction(size: int) -> np.ndarray:
    return directions(size, PROJECTIONS)[:, 0]


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the first projection of each unit vector."""
    for batch in batches:
        vectors = batch["vector"]
        sizes, places = np.asarray(pc.list_value_length(vectors)), np.zeros(batch.num_rows)
        # Vectors of one length are one matrix; the first direction of a length is drawn once.
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            table = vectors.take(pa.array(own)).flatten().to_numpy().reshape(len(own), size)
            places[own] = _unit(table) @ _first_direction(int(size))
        yield batch.append_column("place", pa.array(places, pa.float64()))


def linked_vectors(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, embedding, label).

    Two vectors are linked when their labels are equal, their lengths too, and their cosine, in double
    precision, is at least ``threshold``. n_links counts the other vectors a vector is linked with,
    component_id is the smallest vec_id it reaches, kept marks that one.

    A vector that is null, empty or all zero, or that holds a null or a non-finite number, and one
    without a label or an id, is linked with nothing. A null id has a null component and is not
    kept. Rows that repeat a vec_id count as further vectors. Other columns are ignored; an empty table
    gives an empty result.
    """
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    usable = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), vector.alias("vector")
    ).withColumn("usable", usable)
    # Equal vectors of a label are one class; the key has 128 bits.
    keyed = rows.withColumns(
        {
            "key_high": F.when(F.col("usable"), F.xxhash64("label", "vector")),
            "key_low": F.when(F.col("usable"), F.xxhash64("vector", F.lit("low"), "label")),
        }
    )
    classes = checkpointed(
        keyed.filter("usable")
        .groupBy("key_high", "key_low")
        .agg(
            F.min("vec_id").alias("rep"),
            F.count("*").alias("copies"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        )
        .withColumn("size", F.size("vector"))
    )
    # Rows that repeat an id with another vector still need a name of their own.
    named = classes.select("key_high", "key_low", "rep", "copies", "label", "size", "vector").withColumn(
        "name", F.xxhash64("key_high", "key_low")
    )
    schema = T.StructType([*named.schema.fields, T.StructField("place", T.DoubleType())])
    placed = checkpointed(named.mapInArrow(_project, schema))
    grid = [(i + 1) / CUTS for i in range(CUTS - 1)]
    groups = placed.groupBy("label", "size").agg(
        F.count("*").alias("total"), F.percentile_approx("place", grid, 4 * CUTS).alias("cuts")
    )
    parts = F.least(F.lit(CUTS), F.ceil(F.col("total") / BLOCK_VECTORS))
    cell = F.size(F.filter("cuts", lambda c: c < F.col("place")))
    blocked = placed.join(groups, ["label", "size"]).withColumn(
        "block", F.floor(cell * parts / CUTS).cast("int")
    )
    sizes = blocked.groupBy("label", "size", "block").agg(
        F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    blocks = checkpointed(
        sizes.withColumn("split", F.ceil(F.col("n") / (2 * BLOCK_VECTORS)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
        .withColumn("box", F.xxhash64("label", "size", "block", "part"))
    )
    one, two = (
        blocks.select("label", "size", *(F.col(c).alias(f"{c}_{x}") for c in ("box", "low", "high"))) for x in "ab"
    )
    # The first projection is on a unit direction, so it differs by the vectors' distance at most.
    reach = sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    tiles = (
        one.join(two, ["label", "size"])
        .filter(F.col("box_a") <= F.col("box_b"))
        .filter((F.col("low_b") - F.col("high_a") <= reach) & (F.col("low_a") - F.col("high_b") <= reach))
        .select("box_a", "box_b", F.xxhash64("box_a", "box_b").alias("tile"))
    )
    first = tiles.select(F.col("box_a").alias("box"), "tile", F.lit(0).alias("side"))
    second = tiles.filter("box_a <> box_b").select(F.col("box_b").alias("box"), "tile", F.lit(1).alias("side"))
    boxed = blocked.join(
        blocks.groupBy("label", "size", "block").agg(F.first("split").alias("split")), ["label", "size", "block"]
    ).withColumn("box", F.expr("xxhash64(label, size, block, cast(pmod(xxhash64(name), split) as int))"))
    found = checkpointed(
        boxed.select("box", F.col("name").alias("rep"), "copies", "vector")
        .join(first.union(second), "box")
        .groupBy("tile")
        .applyInArrow(lambda table: _tile(table, threshold), "a long, b long, links long")
    )
    names = placed.select("name", "key_high", "key_low", "rep", "copies")
    groups = components(found.select("a", "b"))
    lowest = (
        groups.join(names.select(F.col("name").alias("node"), "rep"), "node")
        .groupBy("component")
        .agg(F.min("rep").alias("lowest"))
    )
    reached = groups.join(lowest, "component").select(F.col("node").alias("name"), "lowest")
    linked = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "name")
    summary = (
        names.join(linked, "name", "left")
        .join(reached, "name", "left")
        .filter("copies > 1 or links is not null")
        .select(
            "key_high",
            "key_low",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("lowest", "rep").alias("component"),
        )
    )
    return keyed.join(summary, ["key_high", "key_low"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
