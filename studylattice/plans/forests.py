"""A random forest for every key at once, asked one question each.

Each tree is followed along the path of its key's question only: the node that holds the question is a box in
the features, and a level cuts all boxes of all trees of all keys by the split that lowers the squared
error most. Splits are searched over all features, nodes are cut until their labels are equal or no feature tells
their rows apart, and a forest's answer is the mean of its trees' leaves. Bootstrap counts are Poisson
numbers drawn from a hash of (seed, tree, row id), so they need no group to be in one place, and a run repeats.

Keys of up to SMALL rows are solved side by side in partitions sorted by key. For larger keys the rows stay
where they are: a level adds up histograms of the boxes (tree, feature, bin) map-side, and only those
are shuffled. A bin is a range between quantiles. Splits between bins are known from the histograms; those inside a bin are no
better than its labels allow, which bounds them. Bins whose bound reaches the best known split are opened: the next
pass adds up each value in them by itself. So the split is the best of all, the same as for small keys, and the answer
does not depend on the size. Only who asks for quantile cuts, by ``small``, gets splits that lie at bins' ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylattice.session import checkpointed, package_for_workers

SMALL = 1024
# Quantiles of a feature of a larger key, and bins of a tree that are opened at once.
BINS, OPENED = 1024, 8
# Bytes of boxes that are broadcast; more are joined to the rows.
BROADCAST_BYTES = 8 << 20
# Rows solved side by side; one more key may come on top.
CHUNK_ROWS = 2048
# Poisson(1): the probability of a count of 0, of 0 or 1, ...
POISSON = [sum(exp(-1) / factorial(i) for i in range(n + 1)) for n in range(12)]
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

_ANSWER = "key string, answer double"


def bootstrap(seed: int, trees: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How often each tree (a row) draws each id (a column)."""
    row, tree = (np.uint64(m) for m in MULTIPLIERS)
    mixed = ids.astype(np.int64).view(np.uint64)[None, :] * row + (trees.astype(np.uint64) * tree + np.uint64(seed))[:, None]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(POISSON, share, "right")


def best_splits(
    node: np.ndarray, value: np.ndarray, weight: np.ndarray, total: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best cut of every node along one feature: node, score and the entry before the cut.

    Entries are sorted by node and value. The score, the sum over both sides of total^2 / weight, is highest where the
    squared error is lowest; of equal ones the lowest cut counts.
    """
    weights, totals = np.cumsum(weight), np.cumsum(total)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    last = np.append(first[1:], len(node)) - 1
    group = np.repeat(np.arange(len(first)), last - first + 1)
    base_w, base_t = weights[first] - weight[first], totals[first] - total[first]
    at = np.flatnonzero((node[1:] == node[:-1]) & (value[1:] != value[:-1]))
    own = group[at]
    left_w, left_t = weights[at] - base_w[own], totals[at] - base_t[own]
    right_w, right_t = weights[last[own]] - weights[at], totals[last[own]] - totals[at]
    score = left_t * left_t / left_w + right_t * right_t / right_w
    if not len(at):
        return node[at], score, at
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    highest = np.flatnonzero(score == np.repeat(np.fmax.reduceat(score, starts), np.diff(np.append(starts, len(own)))))
    chosen = highest[np.append(True, own[highest][1:] != own[highest][:-1])] if len(highest) else highest
    return node[at[chosen]], score[chosen], at[chosen]


def solved(x: np.ndarray, y: np.ndarray, ids: np.ndarray, group: np.ndarray, asked: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Answers for the groups 0, 1, ... of some rows; ``asked`` has a row for each group."""
    groups = len(asked)
    drawn = bootstrap(seed, np.arange(trees), ids)
    tree, row = np.nonzero(drawn)
    weight = drawn[tree, row].astype(np.float64)
    node = tree * groups + group[row]
    leaf = np.full(trees * groups, np.nan)
    # A tree goes on in one box only, so a row never changes its node: sorted once, rows just leave.
    orders = [np.lexsort((x[row, f], node)) for f in range(x.shape[1])]
    while len(node):
        total = weight * y[row]
        weights = np.bincount(node, weight, trees * groups)
        totals = np.bincount(node, total, trees * groups)
        squares = np.bincount(node, total * y[row], trees * groups)
        score = np.full(trees * groups, -np.inf)
        feature, cut = np.zeros(trees * groups, np.int64), np.zeros(trees * groups)
        for f in range(x.shape[1]):
            order = orders[f]
            value = x[row[order], f]
            found, gain, at = best_splits(node[order], value, weight[order], total[order])
            better = gain > score[found]
            found, at = found[better], at[better]
            score[found], feature[found] = gain[better], f
            cut[found] = (value[at] + value[at + 1]) / 2
        ends = (weights > 0) & ((weights * squares == totals * totals) | ~np.isfinite(score))
        leaf[ends] = totals[ends] / weights[ends]
        question = asked[np.arange(trees * groups) % groups, feature] <= cut
        kept = ~ends[node] & ((x[row, feature[node]] <= cut[node]) == question[node])
        place = np.cumsum(kept) - 1
        orders = [place[order[kept[order]]] for order in orders]
        row, weight, node = row[kept], weight[kept], node[kept]
    return np.nanmean(leaf.reshape(trees, groups), axis=0)


def _solve_partitions(trees: int, seed: int):
    def answers(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = rows["key"].combine_chunks().dictionary_encode()
        group = keys.indices.to_numpy()
        first = np.unique(group, return_index=True)[1]
        x, asked = (np.array(rows[c].to_pylist(), float) for c in ("x", "asked"))
        found = solved(x, rows["y"].to_numpy().astype(float), rows["id"].to_numpy(), group, asked[first], trees, seed)
        known = pa.array(found, mask=np.isnan(found))
        return pa.RecordBatch.from_arrays([keys.dictionary, known], ["key", "answer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK_ROWS:
                continue
            # The last key may go on in the next batch.
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole["key"].to_pylist()
            last = keys.index(keys[-1])
            if last:
                yield answers(whole.slice(0, last).to_batches())
                held = whole.slice(last).to_batches()
        if held:
            yield answers(held)

    return run


def answers(
    rows: DataFrame, questions: DataFrame, trees: int, seed: int, small: int | None = None
) -> DataFrame:
    """(key, answer) of the forest of every key in ``questions`` (key string, asked array<double>) that has ``rows``
    (key string, id long, x array<double>, y double of whole numbers). Runs jobs.

    Keys without rows have no answer. With ``small`` the features of keys with more rows are cut at so many quantiles
    only, a coarser forest; without, all cuts count. Both tables are read several times; hand in kept ones.
    """
    package_for_workers(rows.sparkSession)
    sizes = rows.groupBy("key").count()
    large = checkpointed(sizes.filter(F.col("count") > (SMALL if small is None else small)).select("key"))
    few = rows.join(large, "key", "left_anti").join(questions, "key")
    # A fixed number of partitions: the work is in the trees, which AQE does not see in the few bytes of the rows.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash of its own: a shuffle by the key would be left out after the join, whose rows AQE may read where they lie.
    spread = few.repartition(partitions, F.xxhash64("key")).sortWithinPartitions("key")
    solved_few = spread.mapInArrow(_solve_partitions(trees, seed), _ANSWER)
    if large.isEmpty():
        return solved_few
    many, asked = (df.join(large, "key", "left_semi") for df in (rows, questions))
    return solved_few.unionByName(_large_answers(many, asked, trees, seed, small or BINS, small is None))


# One row a large key: cuts of every feature, the question, and the boxes of its trees as bytes: values above
# ``low`` and up to ``high`` (trees x features), leaves (NaN while unknown), which trees go on, and which bins are
# opened (trees x features x bins, a bit each; empty if none).
_STATE = "key string, cuts array<array<double>>, asked array<double>, low binary, high binary, leaf binary, active binary, opened binary, going boolean"
_PART = "key string, tree int, feature int, bin int, point double, weight double, total double, square double, least double, most double, first double, last double"
_PART_NAMES = [c.split()[0] for c in _PART.split(", ")]
_HELD_KEYS = 8
# Values of opened bins that a task holds before it adds them up.
_HELD_POINTS = 1 << 20


class _Boxes:
    def __init__(self, row: dict) -> None:
        self.key, self.asked = row["key"], row["asked"]
        self.cuts = [np.array(c) for c in row["cuts"]]
        features = len(self.cuts)
        self.low, self.high = (np.frombuffer(row[c], np.float64).reshape(-1, features).copy() for c in ("low", "high"))
        self.leaf = np.frombuffer(row["leaf"], np.float64).copy()
        self.active = np.frombuffer(row["active"], bool).copy()
        shape = len(self.leaf), features, max(map(len, self.cuts)) + 1
        bits = np.frombuffer(row["opened"], np.uint8)
        self.opened = np.unpackbits(bits, count=int(np.prod(shape))).astype(bool).reshape(shape) if len(bits) else np.zeros(shape, bool)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1)

    def row(self) -> list:
        packed = [a.tobytes() for a in (self.low, self.high, self.leaf, self.active)]
        opened = np.packbits(self.opened).tobytes() if self.opened.any() else b""
        return [self.key, [c.tolist() for c in self.cuts], self.asked, *packed, opened, bool(self.active.any())]


def _first_boxes(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for row in batch.to_pylist():
                features = len(row["cuts"])
                row |= {
                    "cuts": [sorted(set(c)) for c in row["cuts"]],
                    "low": np.full((trees, features), -np.inf).tobytes(),
                    "high": np.full((trees, features), np.inf).tobytes(),
                    "leaf": np.full(trees, np.nan).tobytes(),
                    "active": np.ones(trees, bool).tobytes(),
                    "opened": b"",
                }
                for column, cell in zip(columns, _Boxes(row).row()):
                    column.append(cell)
            yield _state_batch(columns)

    return run


def _state_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), *[pa.binary()] * 5, pa.bool_()]
    names = [c.split()[0] for c in _STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class _Sums:
    """What a task's rows add to the bins of a key's boxes, and to the values in opened bins."""

    def __init__(self, boxes: _Boxes) -> None:
        self.boxes = boxes
        shapes = [(len(boxes.active), len(c) + 1) for c in boxes.cuts]
        self.added = [np.zeros((3, *s)) for s in shapes]
        self.least, self.most = ([np.full((2, *s), v) for s in shapes] for v in (np.inf, -np.inf))
        self.points: list[tuple[np.ndarray, ...]] = []

    def add(self, seed: int, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        boxes = self.boxes
        trees = np.flatnonzero(boxes.active)
        bins = boxes.bins(x)
        drawn = bootstrap(seed, trees, ids)
        for f in range(x.shape[1]):
            drawn *= (x[None, :, f] > boxes.low[trees, f, None]) & (x[None, :, f] <= boxes.high[trees, f, None])
        tree, row = np.nonzero(drawn)
        weight, tree = drawn[tree, row].astype(float), trees[tree]
        for f, table in enumerate(self.added):
            place = bins[row, f]
            opened = boxes.opened[tree, f, place]
            if opened.any():
                own = row[opened]
                self.points.append((tree[opened], np.full(len(own), f), place[opened], x[own, f], weight[opened], y[own]))
            shut = ~opened
            at, own, w = tree[shut] * table.shape[2] + place[shut], row[shut], weight[shut]
            for kind, part in enumerate((w, w * y[own], w * y[own] ** 2)):
                table[kind] += np.bincount(at, part, table[kind].size).reshape(table[kind].shape)
            for kind, part in enumerate((y[own], x[own, f])):
                np.minimum.at(self.least[f][kind].reshape(-1), at, part)
                np.maximum.at(self.most[f][kind].reshape(-1), at, part)

    def told(self) -> Iterator[pa.RecordBatch]:
        yield from self.told_points()
        for f, (table, least, most) in enumerate(zip(self.added, self.least, self.most)):
            tree, place = np.nonzero(table[0])
            sums = [*(t[tree, place] for t in table), least[0][tree, place], most[0][tree, place], least[1][tree, place], most[1][tree, place]]
            yield self._batch(tree, np.full(len(tree), f), place, pa.nulls(len(tree), pa.float64()), sums)

    def told_points(self) -> Iterator[pa.RecordBatch]:
        if not self.points:
            return
        tree, feature, place, x, weight, y = (np.concatenate(c) for c in zip(*self.points))
        self.points = []
        order = np.lexsort((x, place, feature, tree))
        tree, feature, place, x, weight, y = (c[order] for c in (tree, feature, place, x, weight, y))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (tree[1:] != tree[:-1]) | (feature[1:] != feature[:-1]) | (x[1:] != x[:-1])
        first = np.flatnonzero(fresh)
        sums = [np.add.reduceat(c, first) for c in (weight, weight * y, weight * y * y)]
        ends = [np.minimum.reduceat(y, first), np.maximum.reduceat(y, first), x[first], x[first]]
        yield self._batch(tree[first], feature[first], place[first], pa.array(x[first]), [*sums, *ends])

    def _batch(self, tree: np.ndarray, feature: np.ndarray, place: np.ndarray, point: pa.Array, sums: list) -> pa.RecordBatch:
        where = [pa.array(c, pa.int32()) for c in (tree, feature, place)]
        key = pa.array([self.boxes.key] * len(tree), pa.string())
        return pa.RecordBatch.from_arrays([key, *where, point, *(pa.array(c, pa.float64()) for c in sums)], _PART_NAMES)


def _histograms(seed: int, boxes_of):
    """Weight, total and square of every bin of the boxes that go on, added up over a task's rows, with the least and
    most label and value. ``boxes_of`` is a broadcast of the boxes; without, the rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Sums] = {}
        for batch in batches:
            keys = np.array(batch["key"].to_pylist(), object)
            x = np.array(batch["x"].to_pylist(), float)
            y, ids = batch["y"].to_numpy().astype(float), batch["id"].to_numpy()
            for key, first in zip(*np.unique(keys.astype(str), return_index=True)):
                if key not in held:
                    told = {n: batch[n][int(first)].as_py() for n in batch.schema.names} if boxes_of is None else boxes_of.value[key]
                    held[key] = _Sums(_Boxes(told))
                own = keys == key
                held[key].add(seed, x[own], y[own], ids[own])
                if sum(len(p[0]) for p in held[key].points) > _HELD_POINTS:
                    yield from held[key].told_points()
            while len(held) > _HELD_KEYS:
                yield from held.pop(next(iter(held))).told()
        for kept in held.values():
            yield from kept.told()

    return run


def _bounds(weights: np.ndarray, totals: np.ndarray, weight: np.ndarray, total: np.ndarray, least: np.ndarray, most: np.ndarray, all_w: np.ndarray, all_t: np.ndarray) -> np.ndarray:
    """What the score of a cut inside a bin cannot exceed: ``weights`` and ``totals`` lie before the bin.

    The score is convex in the weight and total of the left side, and those of the bin's rows lie in a parallelogram:
    labels all ``least`` or all ``most`` first. So its corners bound it.
    """

    def score(w: np.ndarray, t: np.ndarray) -> np.ndarray:
        sides = [np.divide(b * b, a, out=np.zeros_like(a), where=a > 0) for a, b in ((w, t), (all_w - w, all_t - t))]
        return sides[0] + sides[1]

    width = most - least
    upper = np.divide(total - least * weight, width, out=np.zeros_like(weight), where=width > 0)
    lower = np.where(width > 0, weight - upper, 0.0)
    corners = ((0.0, 0.0), (weight, total), (upper, most * upper), (lower, least * lower))
    return np.max([score(weights + w, totals + t) for w, t in corners], axis=0)


def _advance(exact: bool):
    """Cut every box of a key by its best split; a box that is pure or cannot be cut becomes a leaf. If all cuts are to
    count, a box in whose bins a better or equal split may lie waits until those bins are opened."""

    def run(parts: pa.Table, states: pa.Table) -> pa.Table:
        boxes = _Boxes(states.to_pylist()[0])
        names = [n for n in _PART_NAMES if n not in ("key", "point")]
        tree, feature, place, weight, total, square, least, most, first, last = (parts[c].to_numpy() for c in names)
        trees = len(boxes.active)
        one = feature == 0
        weights, totals, squares = (np.bincount(tree[one], c[one], trees) for c in (weight, total, square))
        score, best, cut = np.full(trees, -np.inf), np.zeros(trees, np.int64), np.zeros(trees)
        inside: list[tuple[np.ndarray, ...]] = []
        for f in range(len(boxes.cuts)):
            own = np.flatnonzero(feature == f)
            own = own[np.lexsort((first[own], place[own], tree[own]))]
            if not len(own):
                continue
            found, gain, at = best_splits(tree[own], np.arange(len(own)), weight[own], total[own])
            better = gain > score[found]
            found, at = found[better], at[better]
            score[found], best[found] = gain[better], f
            cut[found] = (last[own][at] + first[own][at + 1]) / 2 if exact else boxes.cuts[f][place[own][at]]
            wide = own[first[own] < last[own]]
            if exact and len(wide):
                before = [np.cumsum(c[own]) - c[own] for c in (weight, total)]
                # Sums of the trees before are whole numbers, so taking them off loses nothing.
                start = np.searchsorted(tree[own], tree[own])
                before = [(c - c[start])[first[own] < last[own]] for c in before]
                t = tree[wide]
                limit = _bounds(*before, weight[wide], total[wide], least[wide], most[wide], weights[t], totals[t])
                inside.append((t, np.full(len(wide), f), place[wide], limit))
        pure = weights * squares == totals * totals
        waits = np.zeros(trees, bool)
        if inside:
            t, f, b, limit = (np.concatenate(c) for c in zip(*inside))
            # A little less than the best, as bounds are rounded; equal ones count, the lowest cut may be there.
            may = ~pure[t] & (limit >= np.where(np.isfinite(score[t]), score[t] * (1 - 1e-9), -np.inf))
            t, f, b, limit = t[may], f[may], b[may], limit[may]
            order = np.lexsort((-limit, t))
            nth = np.arange(len(order)) - np.searchsorted(t[order], t[order])
            order = order[nth < OPENED]
            boxes.opened[t[order], f[order], b[order]] = True
            waits[t] = True
        ends = boxes.active & ~waits & (pure | ~np.isfinite(score))
        known = ends & (weights > 0)
        boxes.leaf[known] = totals[known] / weights[known]
        boxes.active &= ~ends
        boxes.opened[~waits] = False
        go = np.flatnonzero(boxes.active & ~waits)
        below = np.array(boxes.asked, float)[best[go]] <= cut[go]
        boxes.high[go[below], best[go[below]]] = cut[go[below]]
        boxes.low[go[~below], best[go[~below]]] = cut[go[~below]]
        return pa.Table.from_batches([_state_batch([[cell] for cell in boxes.row()])])

    return run


def _read_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaves = [np.frombuffer(b, np.float64) for b in batch["leaf"].to_pylist()]
        means = [float(np.nanmean(v)) if np.isfinite(v).any() else None for v in leaves]
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(means, pa.float64())], ["key", "answer"])


def _large_answers(
    rows: DataFrame, questions: DataFrame, trees: int, seed: int, bins: int, exact: bool
) -> DataFrame:
    """Forests of the keys whose rows stay spread. A level is a pass over the rows with the small table of
    boxes, a sum of histograms, and a step for each key, and further passes where bins are opened; boxes that are
    leaves need no more passes. Runs jobs."""
    spark, rows = rows.sparkSession, checkpointed(rows)
    features = len(questions.first()["asked"])
    shares = [i / bins for i in range(1, bins + 1)]
    cuts = [F.percentile_approx(F.get("x", F.lit(f)), shares, 10 * bins) for f in range(features)]
    tables = rows.groupBy("key").agg(F.array(*cuts).alias("cuts")).join(questions, "key").select("key", "cuts", "asked")
    state = checkpointed(tables.mapInArrow(_first_boxes(trees), _STATE))
    parts_of = ("key", "tree", "feature", "bin", "point")
    while True:
        going = state.filter("going")
        if going.isEmpty():
            return state.mapInArrow(_read_leaves, _ANSWER)
        held = going.agg(F.sum(sum(F.octet_length(c) for c in ("key", "low", "high", "opened")) + features * 8 * bins)).first()[0]
        if held <= BROADCAST_BYTES:
            boxes = spark.sparkContext.broadcast({r["key"]: r.asDict() for r in going.collect()})
            own = rows.join(F.broadcast(going.select("key")), "key", "left_semi")
        else:
            boxes, own = None, rows.join(going, "key")
        parts = own.mapInArrow(_histograms(seed, boxes), _PART)
        sums = [F.sum(c).alias(c) for c in ("weight", "total", "square")]
        ends = [f(c).alias(c) for c, f in (("least", F.min), ("most", F.max), ("first", F.min), ("last", F.max))]
        moved = parts.groupBy(*parts_of).agg(*sums, *ends).groupBy("key").cogroup(going.groupBy("key")).applyInArrow(_advance(exact), _STATE)
        state = checkpointed(state.filter("not going").unionByName(moved))
