"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and so have the chosen pairs of features. Training
boosts shallow trees in turn, feature by feature, and adds them to the tables; a score is the sum of the
looked-up values. Only the text is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylattice.llm.common import (
    SCORED_BYTES,
    batches_of,
    distinct,
    filter_texts,
    hashed_words,
    held_out_rows,
    labelled_sample,
    shingles,
    texts_of,
)

# Training reads at most about this many labelled documents.
TRAINING_ROWS = 16_000
MODULUS, LEFT_OUT = 4, 2
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
MIN_HESSIAN, SHRINK = 2.0, 1.0

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" ",
    "line": b"\n",
    "stop": b".",
    "comma": b",",
    "bang": b"!?",
    "bar": b"|/\\",
    "symbol": b"#$%&*@^~+=",
    "mark": b"<>{}[]();:_-\"'",
    "high": bytes(range(128, 256)),
}
_GROUP_OF = np.full(256, len(_GROUPS), np.int64)
for _number, _members in enumerate(_GROUPS.values()):
    _GROUP_OF[list(_members)] = _number
FEATURES = (
    *_GROUPS,
    "log_bytes",
    "log_words",
    "bytes_per_word",
    "words_per_line",
    "words_per_stop",
    "distinct_words",
    "distinct_pairs",
    "distinct_fives",
    "commonest_word",
    "same_as_previous",
)


def _commonest(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each text's most frequent word occurs."""
    most = np.zeros(len(bounds) - 1)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            part = np.sort(hashes[a:b])
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            most[i] = np.diff(edges).max()
    return most


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of a binary array; all zero for a null or empty text."""
    n = len(texts)
    sizes = np.array([len(t) if t else 0 for t in texts.to_pylist()], np.float64)
    data = np.frombuffer(b"".join(t or b"" for t in texts.to_pylist()), np.uint8)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    width = len(_GROUPS) + 1
    counts = np.bincount(owner * width + _GROUP_OF[data], minlength=n * width).reshape(n, width)[:, :-1]
    hashes, bounds = hashed_words(texts)
    words = np.diff(bounds).astype(np.float64)
    some = np.maximum(words, 1)
    kinds = [np.diff(distinct(*shingles(hashes, bounds, k))[1]) for k in (1, 2, 5)]
    repeated = np.zeros(len(hashes))
    repeated[1:] = hashes[1:] == hashes[:-1]
    repeated[bounds[:-1][words > 0]] = 0
    same = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), repeated, n)
    lines = counts[:, list(_GROUPS).index("line")]
    stops = counts[:, list(_GROUPS).index("stop")]
    return np.column_stack(
        [
            counts / np.maximum(sizes, 1)[:, None],
            np.log1p(sizes),
            np.log1p(words),
            sizes / some,
            words / (lines + 1),
            words / (stops + 1),
            kinds[0] / some,
            kinds[1] / np.maximum(words - 1, 1),
            kinds[2] / np.maximum(words - 4, 1),
            _commonest(hashes, bounds) / some,
            same / some,
        ]
    )


def _best_cut(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut along a vector of bins."""
    left_g, left_h = np.cumsum(gradient)[:-1], np.cumsum(hessian)[:-1]
    right_g, right_h = gradient.sum() - left_g, hessian.sum() - left_h
    gain = left_g**2 / (left_h + SHRINK) + right_g**2 / (right_h + SHRINK)
    gain -= gradient.sum() ** 2 / (hessian.sum() + SHRINK)
    gain[(left_h < MIN_HESSIAN) | (right_h < MIN_HESSIAN)] = -1
    if not len(gain):
        return -1.0, 0
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _shallow_tree(gradient: np.ndarray, hessian: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree over the bins of one feature: a value for each bin."""
    gain, place = _best_cut(gradient, hessian)
    if not depth or gain <= 0:
        return np.full(len(gradient), -gradient.sum() / (hessian.sum() + SHRINK))
    sides = (slice(None, place), slice(place, None))
    return np.concatenate([_shallow_tree(gradient[s], hessian[s], depth - 1) for s in sides])


def _quadrants(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """The tree over two features that cuts both once: a value for each cell, and the gain. Both cuts
    are chosen together, since one alone may gain nothing."""
    best = (0.0, 0, 0)
    if min(gradient.shape) > 1:
        sums = [np.cumsum(np.cumsum(x, 0), 1) for x in (gradient, hessian)]
        corners = []
        for s in sums:
            low, across, down = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1]
            corners.append((low, across - low, down - low, s[-1, -1] - across - down + low))
        gain = sum(g * g / (h + SHRINK) for g, h in zip(*corners)) - gradient.sum() ** 2 / (hessian.sum() + SHRINK)
        gain[np.minimum.reduce(corners[1]) < MIN_HESSIAN] = 0
        at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best = (float(gain[at]), int(at[0]) + 1, int(at[1]) + 1)
    value = np.full(gradient.shape, -gradient.sum() / (hessian.sum() + SHRINK))
    if best[0] > 0:
        for rows in (slice(None, best[1]), slice(best[1], None)):
            for columns in (slice(None, best[2]), slice(best[2], None)):
                value[rows, columns] = -gradient[rows, columns].sum() / (hessian[rows, columns].sum() + SHRINK)
    return value, best[0]


@dataclass
class AdditiveModel:
    """Cut points and tables; ``pairs`` maps two features to cuts of each and their table."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, rows[:, j], "right")]
        for a, b, cuts_a, cuts_b, values in self.pairs:
            at_a = np.searchsorted(cuts_a, rows[:, a], "right")
            total += values[at_a, np.searchsorted(cuts_b, rows[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


class _Trainer:
    """Logistic boosting on rows with weights; keeps the current scores."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        self.rows, self.labels, self.weights = rows, labels, weights
        share = (weights[labels == 1].sum() + 1) / (weights.sum() + 2)
        self.model = AdditiveModel(float(np.log(share / (1 - share))))
        self.total = np.full(len(rows), self.model.intercept)

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-self.total))
        return self.weights * (chance - self.labels), self.weights * chance * (1 - chance)

    def step(self, cells: np.ndarray, shape: tuple[int, ...], table: np.ndarray) -> None:
        gradient, hessian = self.slopes()
        size = int(np.prod(shape))
        grids = [np.bincount(cells, s, size).reshape(shape) for s in (gradient, hessian)]
        tree = _shallow_tree(*grids) if len(shape) == 1 else _quadrants(*grids)[0]
        table += RATE * tree
        self.total += RATE * tree.reshape(-1)[cells]

    def train(self) -> AdditiveModel:
        model, columns = self.model, self.rows.T
        model.cuts = [_cut_points(c, BINS) for c in columns]
        model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
        cells = [np.searchsorted(c, x, "right") for c, x in zip(model.cuts, columns)]
        for _ in range(ROUNDS):
            for j, table in enumerate(model.tables):
                self.step(cells[j], table.shape, table)
        coarse = [_cut_points(c, PAIR_BINS) for c in columns]
        places = [np.searchsorted(c, x, "right") for c, x in zip(coarse, columns)]
        gradient, hessian = self.slopes()
        gains = []
        for a in range(len(columns)):
            for b in range(a):
                shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
                joint, size = places[a] * shape[1] + places[b], shape[0] * shape[1]
                grids = [np.bincount(joint, s, size).reshape(shape) for s in (gradient, hessian)]
                gains.append((_quadrants(*grids)[1], a, b))
        for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
            grid = np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))
            model.pairs.append((a, b, coarse[a], coarse[b], grid))
        for _ in range(PAIR_ROUNDS):
            for a, b, _, _, table in model.pairs:
                self.step(places[a] * table.shape[1] + places[b], table.shape, table)
        return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> AdditiveModel:
    """The model for ``labels.quality``, from rows whose crc32(doc_id) mod 4 is not 2.

    Features of the sample are computed on the executors; the driver gets ``rows`` short rows at
    most. Without usable labels the model scores 0.5.
    """
    sample = labelled_sample(docs, labels, "quality", MODULUS, LEFT_OUT, rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", SCORED_BYTES):
                table = features(batch["text"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(table), pa.list_(pa.float64())), batch["label"], batch["weight"]],
                    ["features", "label", "weight"],
                )

    found = sample.mapInArrow(measure, "features array<double>, label int, weight double").toArrow()
    if not found.num_rows:
        return AdditiveModel(0.0)
    table = found["features"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    order = np.lexsort(table.T)  # the same sums whatever order rows arrive in
    return _Trainer(
        table[order], found["label"].to_numpy()[order].astype(float), found["weight"].to_numpy()[order]
    ).train()


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    A null text counts as empty, a null doc_id is kept and not held out, repeated rows are scored
    each; other columns are ignored and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", SCORED_BYTES):
                scores = model.score(features(batch["text"]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores)], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        held_out_rows(MODULUS, LEFT_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    return filter_texts(docs, lambda texts: model.score(features(texts)) >= threshold)
