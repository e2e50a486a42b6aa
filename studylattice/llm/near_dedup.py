"""Near-duplicate documents: SuperMinHash signatures, banding, exact checks, union-find groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylattice.llm.common import (
    BROADCAST_BYTES,
    batches_of,
    broadcast_if_small,
    lists,
    mixed,
    shingle_sets,
    texts_of,
)
from studylattice.llm.components import UnionFind, components
from studylattice.session import checkpointed

# 30 bands of 5 values: a pair at similarity 0.8 shares no band with probability 7e-6.
BANDS, BAND_ROWS = 30, 5
THRESHOLD_PERCENT = 80

# Blocks that documents are compared in are about so large at most.
_BLOCK_DOCS, _BLOCK_SHINGLES = 512, 250_000

_LEVEL_STEP = np.uint64(0xD1B54A32D192ED03)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def superminhash(elements: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """The SuperMinHash signatures of sets of 64-bit hashes that lie between ``bounds``.

    Every element draws one random permutation of the ``size`` positions; at its j-th position it
    offers j plus a fraction, and each position keeps the lowest offer of its set. All elements
    take step j together, which allows the early stop: once all positions of a set hold less than
    j + 1, its elements drop out. Permutations are Fisher-Yates shuffles of which only the swaps
    taken so far are kept. Values are 32.32 fixed point.
    """
    count = len(bounds) - 1
    lowest = np.full(count * size, np.iinfo(np.uint64).max)
    owner = np.repeat(np.arange(count) * size, np.diff(bounds))
    swaps: list[np.ndarray] = []
    for j in range(size):
        draw = mixed(elements + _LEVEL_STEP * np.arange(j + 1, j + 2, dtype=np.uint64))
        swap = (j + (((draw >> _HALF) * np.uint64(size - j)) >> _HALF)).astype(np.int64)
        position = swap.copy()
        for earlier in range(j - 1, -1, -1):
            position[swaps[earlier] == position] = earlier
        np.minimum.at(lowest, owner + position, np.uint64(j << 32) | (draw & _LOW))
        open_sets = lowest.reshape(count, size).max(1) >= np.uint64((j + 1) << 32)
        going = open_sets[owner // size]
        if not going.any():
            break
        elements, owner = elements[going], owner[going]
        swaps = [s[going] for s in swaps] + [swap[going]]
    return lowest.reshape(count, size)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each signature and band; the band's number is part of it."""
    table = signatures[:, : bands * rows].reshape(-1, bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(table), 1))
    for row in range(rows):
        keys = mixed(keys * _LEVEL_STEP + table[:, :, row])
    return keys


def _sign(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int, smallest: int):
    """Per document: set size, a 128-bit key of the set, band keys (none below ``smallest``)."""
    for whole in batches:
        for batch in batches_of(whole, "text", 1 << 20):
            found, bounds = shingle_sets(batch["text"], words)
            sizes = np.diff(bounds)
            digests = _set_keys(found, bounds)
            linkable = sizes >= smallest
            kept = np.repeat(linkable, sizes)
            ends = np.concatenate([[0], np.cumsum(sizes[linkable])])
            keys = band_keys(superminhash(found[kept], ends, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(sizes),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    lists(keys.reshape(-1), np.concatenate([[0], np.cumsum(linkable * bands)])),
                ],
                ["doc_id", "n_shingles", "key_high", "key_low", "bands"],
            )


def _set_keys(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The two halves of a 128-bit key of every set."""
    digests = [xxhash.xxh3_128_digest(found[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    for whole in batches:
        for batch in batches_of(whole, "text"):
            found, bounds = shingle_sets(batch["text"], words)
            high, low = _set_keys(found, bounds).T
            columns = [batch["doc_id"], pa.array(high), pa.array(low), lists(found, bounds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key_high", "key_low", "shingles"])


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of both full sets and of their intersection."""
    count = pairs.count()
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if 2 * count * 32 <= BROADCAST_BYTES:
        # Few pairs: only the sets they name are moved.
        sets = sets.join(F.broadcast(named), "doc_id", "left_semi")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return checkpointed(
        joined.select(
            "a",
            "b",
            F.size("set_a").cast("long").alias("n_a"),
            F.size("set_b").cast("long").alias("n_b"),
            F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("shared"),
        )
    )


def _tile_links(table: pa.Table, threshold: int) -> pa.Table:
    """Links between the two sides of a tile whose documents are in different groups so far, as a
    spanning forest. Intersections come from products of 0/1 matrices over the shared shingles."""
    sides, forest = [], UnionFind()
    for side in (0, 1):
        rows = table.filter(pc.equal(table["side"], side))
        lists = rows["shingles"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        found = lists.flatten().to_numpy()
        sides.append((rows["doc"].to_numpy(), rows["component"].to_numpy(), sizes, owner, found))
    (doc_a, group_a, n_a, owner_a, found_a), (doc_b, group_b, n_b, owner_b, found_b) = sides
    both = np.intersect1d(found_a, found_b)
    shared = np.zeros((len(doc_a), len(doc_b)), np.float32)
    for start in range(0, len(both), 2048):
        part, matrices = both[start : start + 2048], []
        for documents, owner, found in ((doc_a, owner_a, found_a), (doc_b, owner_b, found_b)):
            at = np.minimum(np.searchsorted(part, found), len(part) - 1)
            hit = part[at] == found
            matrix = np.zeros((len(documents), len(part)), np.float32)
            matrix[owner[hit], at[hit]] = 1
            matrices.append(matrix)
        shared += matrices[0] @ matrices[1].T
    union = n_a[:, None] + n_b[None, :] - shared
    linked = (100 * shared >= threshold * union) & (group_a[:, None] != group_b[None, :])
    for i, j in zip(*np.nonzero(linked)):
        forest.join(int(doc_a[i]), int(doc_b[j]))
    nodes = list(forest.parent)
    return pa.table({"a": pa.array([forest.find(n) for n in nodes], pa.int64()), "b": pa.array(nodes, pa.int64())})


def _stray_links(found: DataFrame, groups: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links of documents that were compared with a leader and stayed out of its group.

    Each is compared with all others that were compared with leaders of the same group, in tiles of
    bounded blocks. Linked sets have similar sizes, so blocks are cut by size and only neighbouring
    sizes meet.
    """
    of_doc = groups.select(F.col("node").alias("doc"), F.col("component").alias("group_doc"))
    of_leader = groups.select(F.col("node").alias("leader"), F.col("component").alias("group_leader"))
    stratum = F.floor(F.log("n") / -np.log(threshold / 100)).cast("int")
    placed = checkpointed(
        found.join(of_doc, "doc", "left")
        .join(of_leader, "leader", "left")
        .select(
            F.coalesce("group_leader", "leader").alias("hub"),
            "doc",
            "n",
            stratum.alias("stratum"),
            F.coalesce("group_doc", "doc").alias("component"),
        )
        .distinct()
        .withColumn("stray", F.col("component") != F.col("hub"))
    )
    parts = F.ceil(F.greatest(F.count("*") / _BLOCK_DOCS, F.sum("n") / _BLOCK_SHINGLES)).cast("int")
    blocks = checkpointed(
        placed.groupBy("hub", "stratum", "stray").agg(parts.alias("parts"), F.count("*").alias("docs"))
    )
    crowded = blocks.groupBy("hub").agg(F.sum("docs").alias("docs")).filter("docs > 1").select("hub")
    sides = [
        blocks.select("hub", F.col("stratum").alias(x), F.col("parts").alias(f"{x}_parts"), F.col("stray").alias(f"{x}_stray"))
        for x in ("s", "o")
    ]
    tiles = (
        sides[0].filter("s_stray")
        .join(sides[1], "hub")
        .join(crowded, "hub")
        .filter(F.abs(F.col("s") - F.col("o")) <= 1)
        .withColumn("s_part", F.explode(F.sequence(F.lit(0), F.col("s_parts") - 1)))
        .withColumn("o_part", F.explode(F.sequence(F.lit(0), F.col("o_parts") - 1)))
        .withColumn("tile", F.xxhash64("hub", "s", "s_part", "o", "o_part", "o_stray"))
    )
    tiles = checkpointed(tiles)
    key = ["hub", "stratum", "stray", "part"]
    spread = placed.join(blocks.drop("docs"), ["hub", "stratum", "stray"]).withColumn(
        "part", F.expr("cast(pmod(xxhash64(doc), parts) as int)")
    )
    rows = None
    for side, (name, stray) in enumerate((("s", F.lit(True)), ("o", F.col("o_stray")))):
        own = tiles.select(
            "hub", F.col(name).alias("stratum"), stray.alias("stray"), F.col(f"{name}_part").alias("part"), "tile"
        )
        part = spread.join(own, key).select("tile", "doc", "component", F.lit(side).alias("side"))
        rows = part if rows is None else rows.union(part)
    return checkpointed(
        rows.join(sets.withColumnRenamed("doc_id", "doc"), "doc")
        .groupBy("tile")
        .applyInArrow(lambda table: _tile_links(table, threshold), "a long, b long")
        .filter("a <> b")
    )


def _groups(buckets: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of documents linked within buckets (band, doc, n).

    In every bucket all documents are compared with the smallest one, the leader: one comparison a
    member, however large a group of near copies. Documents that stay outside the leader's
    group are then compared with the rest of the bucket.
    """
    leaders = (
        buckets.groupBy("band")
        .agg(F.min("doc").alias("leader"), F.count("*").alias("size"))
        .filter("size > 1")
        .drop("size")
    )
    pairs = checkpointed(
        buckets.join(leaders, "band")
        .filter("doc <> leader")
        .select(F.col("leader").alias("a"), F.col("doc").alias("b"))
        .distinct()
    )
    found = _similarities(pairs, sets).select(
        F.col("a").alias("leader"),
        F.col("b").alias("doc"),
        F.col("n_b").alias("n"),
        F.expr(f"100 * shared >= {threshold} * (n_a + n_b - shared)").alias("linked"),
    )
    links = found.filter("linked").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    groups = checkpointed(components(links))
    return components(links.union(_stray_links(found, groups, sets, threshold)))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    threshold: int = THRESHOLD_PERCENT,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * shared >= threshold * union over their sets of distinct word
    shingles. ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks it.

    A text without words, or null, has an empty set and links with nothing. A null doc_id links
    with nothing either: its component is null and it is not kept. Rows that repeat a doc_id are
    all returned; with another text each is a document of its own, which only its own text links. Other columns are
    ignored; an empty table gives an empty result.
    """
    return _grouped(docs, words, threshold, bands, rows).drop("key_high", "key_low")


def _ids_with_several_sets(signed: DataFrame) -> DataFrame:
    """The doc_ids that rows with different sets share."""
    halves = [f(c).alias(f"{name}_{c}") for c in ("key_high", "key_low") for name, f in (("low", F.min), ("high", F.max))]
    return (
        signed.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(*halves)
        .filter("low_key_high <> high_key_high or low_key_low <> high_key_low")
        .select("doc_id")
    )


def _grouped(docs: DataFrame, words: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """``near_duplicates`` with the key of every row's set.

    Classes of equal sets are named by their smallest doc_id, or, where rows with other sets have that
    id too, by a hash of the set's key.
    """
    # A set of n elements can only link with another one if n / (n + 1) reaches the threshold.
    smallest = -(-threshold // (100 - threshold)) if threshold < 100 else 1 << 60
    signed = checkpointed(
        texts_of(docs).mapInArrow(
            partial(_sign, words=words, bands=bands, rows=rows, smallest=smallest),
            "doc_id long, n_shingles long, key_high long, key_low long, bands array<long>",
        )
    )
    several = checkpointed(_ids_with_several_sets(signed))
    several = broadcast_if_small(several, several.count(), 32)
    # Equal sets are one class, known by its smallest document.
    classes = (
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("key_high", "key_low")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"))
    )
    unclear = classes.join(several, "doc_id", "left_semi").withColumn("doc", F.xxhash64("key_high", "key_low"))
    clear = classes.join(several, "doc_id", "left_anti").withColumn("doc", F.col("doc_id"))
    classes = checkpointed(clear.unionByName(unclear))
    key = ["key_high", "key_low", "doc_id"]
    banded = (
        signed.filter("size(bands) > 0")
        .join(classes.select(*key, "doc", "n"), key)
        .dropDuplicates(["doc"])
        .select("doc", "n", F.explode("bands").alias("band"))
    )
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band")
    buckets = checkpointed(banded.join(shared, "band").select("band", "doc", "n"))
    named = classes.join(buckets.select("doc").distinct(), "doc", "left_semi").select(*key, "doc")
    wanted = checkpointed(named)
    made = (
        texts_of(docs)
        .join(broadcast_if_small(wanted.select("doc_id"), wanted.count(), 32), "doc_id", "left_semi")
        .mapInArrow(partial(_sets, words=words), "doc_id long, key_high long, key_low long, shingles array<long>")
    )
    # Only where an id has several sets must a row's set be looked at to know whose it is.
    own = made.join(several, "doc_id", "left_semi").join(wanted, key).select("doc", "shingles")
    plain = made.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "shingles")
    sets = checkpointed(
        plain.unionByName(own).groupBy(F.col("doc").alias("doc_id")).agg(F.first("shingles").alias("shingles"))
    )
    groups = _groups(buckets, sets, threshold).withColumnRenamed("node", "doc")
    lowest = (
        groups.join(classes.select("doc", "doc_id"), "doc")
        .groupBy("component")
        .agg(F.min("doc_id").alias("lowest"))
    )
    reached = groups.join(lowest, "component").select("doc", "lowest")
    names = (
        classes.join(reached, "doc", "left")
        .filter("copies > 1 or lowest is not null")
        .select("key_high", "key_low", F.coalesce("lowest", "doc_id").alias("component"))
    )
    found = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "doc_id"))
    return (
        signed.drop("bands")
        .join(names, ["key_high", "key_low"], "left")
        .select("doc_id", "n_shingles", F.coalesce(found, "doc_id").alias("component_id"), "key_high", "key_low")
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _with_set_keys(docs: DataFrame, names: list[str], words: int) -> DataFrame:
    """All columns of ``docs`` and the two halves of the key of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pa.RecordBatch.from_arrays([whole["text"].cast(pa.binary())], ["text"])
            at = 0
            for part in batches_of(texts, "text"):
                rows = whole.slice(at, part.num_rows)
                at += part.num_rows
                halves = _set_keys(*shingle_sets(part["text"], words)).T
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *map(pa.array, halves)], [*rows.schema.names, *names]
                )

    halves = [T.StructField(name, T.LongType()) for name in names]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *halves]))


def without_duplicates(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each group left, the one with the smallest doc_id, and
    with all their columns. Rows without an id all stay; rows that repeat both an id and its set of
    shingles stay once. Rows that share an id but not their set stay or go by their own set."""
    grouped = checkpointed(_grouped(docs, words, threshold, BANDS, BAND_ROWS))
    repeated = checkpointed(
        grouped.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    )
    rows = repeated.count()
    dropped = grouped.filter("not kept and doc_id is not null").select("doc_id").distinct()
    if not rows:
        return docs.join(broadcast_if_small(dropped, dropped.count(), 32), "doc_id", "left_anti").select(docs.columns)
    several = broadcast_if_small(repeated, rows, 32)
    dropped = dropped.join(several, "doc_id", "left_anti")
    once = docs.join(several, "doc_id", "left_anti")
    once = once.join(broadcast_if_small(dropped, dropped.count(), 32), "doc_id", "left_anti").select(docs.columns)
    taken = {name.lower() for name in docs.columns}
    names = [next(n for n in (f"_{half}{i}" for i in range(len(taken) + 1)) if n not in taken) for half in ("high", "low")]
    kept = grouped.filter("kept").join(several, "doc_id", "left_semi").select(
        "doc_id", F.col("key_high").alias(names[0]), F.col("key_low").alias(names[1])
    )
    again = _with_set_keys(docs.join(several, "doc_id", "left_semi").select(docs.columns), names, words)
    again = again.join(kept.distinct(), ["doc_id", *names], "left_semi").dropDuplicates(["doc_id", *names])
    return once.union(again.select(docs.columns))
