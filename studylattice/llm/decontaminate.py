"""Benchmark decontamination: size-partitioned MinHash containment search.

MinHash sees Jaccard similarity, which is tiny between a short test item and a long document. So
items are partitioned by size, and for the partition of up to u shingles the document is seen as
overlapping windows of 2u shingles: every run of u shingles lies within one. An item with over u/2
shingles of which 80 % are in such a window has a similarity of at least 0.19 with it, and shares
none of 64 minimum values with probability 1.4e-6. Candidates are then checked on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylattice.llm.common import (
    batches_of,
    distinct,
    filter_texts,
    hashed_words,
    mixed,
    shingles,
    texts_of,
)

MINIMA = 64
# Items go through the documents in blocks of so many at most, and of so many bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20

_SEEDS = mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
_FLIPS = (_SEEDS[:MINIMA] >> np.uint64(32)).astype(np.uint32)
_FACTORS = (_SEEDS[MINIMA:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@dataclass
class _Partition:
    """The minimum values of the items of one size class."""

    items: np.ndarray
    minima: np.ndarray  # a row for each item
    sieve: list[np.ndarray] = field(default_factory=list)
    order: list[np.ndarray] = field(default_factory=list)

    def prepare(self) -> None:
        size = 1 << max(12, int(16 * len(self.items)).bit_length())
        for values in self.minima.T:
            sieve = np.zeros(size, bool)
            sieve[values & np.uint32(size - 1)] = True
            self.sieve.append(sieve)
            self.order.append(np.argsort(values, kind="stable"))

    def hits(self, which: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` and the items that have the value as their minimum."""
        sieve = self.sieve[which]
        at = np.flatnonzero(sieve[values & np.uint32(len(sieve) - 1)])
        if not len(at):
            return at, at
        order = self.order[which]
        known = self.minima[order, which]
        low = np.searchsorted(known, values[at], "left")
        counts = np.searchsorted(known, values[at], "right") - low
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(at, counts), self.items[order[np.repeat(low, counts) + within]]


class ItemIndex:
    """A block of test items: their shingle sets, and their minima by shingle length and size."""

    def __init__(self, rows: list[tuple[int, bytes]], words: int) -> None:
        self.ids = np.array([i for i, _ in rows], np.int64)
        texts = pa.array([t for _, t in rows], pa.binary())
        hashes, bounds = hashed_words(texts)
        values, ends = distinct(*shingles(hashes, bounds, words))
        self.sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        length = np.minimum(np.diff(bounds), words)
        self.partitions: dict[int, dict[int, _Partition]] = {}
        for item, found in enumerate(self.sets):
            if len(found):
                width = 1 << (len(found) - 1).bit_length()
                minima = _hashed(found)[:, None] ^ _FLIPS[None, :]
                classes = self.partitions.setdefault(int(length[item]), {})
                classes.setdefault(width, []).append((item, (minima * _FACTORS[None, :]).min(0)))
        for classes in self.partitions.values():
            for width, members in classes.items():
                part = _Partition(np.array([m[0] for m in members]), np.stack([m[1] for m in members]))
                part.prepare()
                classes[width] = part


def _hashed(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.uint32)


def _halved(values: np.ndarray) -> np.ndarray:
    """Minima of neighbouring pairs."""
    if len(values) % 2:
        values = np.append(values, values[-1])
    return np.minimum(values[0::2], values[1::2])


def _candidates(sequence: np.ndarray, bounds: np.ndarray, classes: dict[int, _Partition]) -> np.ndarray:
    """(document, item) pairs of which a window and an item share a minimum.

    Windows run over the documents of a batch without regard to their borders; a window that
    touches several documents makes a candidate of each.
    """
    found = []
    keys = _hashed(sequence)
    for which in range(MINIMA):
        lowest, size = (keys ^ _FLIPS[which]) * _FACTORS[which], 1
        for width, part in sorted(classes.items()):
            while size < width:
                lowest, size = _halved(lowest), 2 * size
            windows = np.minimum(lowest[:-1], lowest[1:]) if len(lowest) > 1 else lowest
            at, items = part.hits(which, windows)
            if len(at):
                found.append(np.stack([at * width, at * width + 2 * width, items], 1))
    if not found:
        return np.empty((0, 2), np.int64)
    found = np.unique(np.concatenate(found), axis=0)
    first = np.searchsorted(bounds, found[:, 0], "right") - 1
    last = np.searchsorted(bounds, np.minimum(found[:, 1], len(sequence)), "left")
    counts = last - first
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    pairs = np.stack([np.repeat(first, counts) + within, np.repeat(found[:, 2], counts)], 1)
    return np.unique(pairs, axis=0)


def _contained(texts: pa.Array, index: ItemIndex, words: int, threshold: int) -> np.ndarray:
    """Rows (document, item, shared) whose share of the item's shingles reaches the threshold."""
    hashes, bounds = hashed_words(texts)
    rows = []
    for length, classes in index.partitions.items():
        sequence, ends = shingles(hashes, bounds, length)
        pairs = _candidates(sequence, ends, classes) if len(sequence) else np.empty((0, 2), np.int64)
        document, known = -1, None
        for text, item in pairs.tolist():
            if text != document:
                document, known = text, np.sort(sequence[ends[text] : ends[text + 1]])
            wanted = index.sets[item]
            if len(known):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                shared = int((known[at] == wanted).sum())
                if 100 * shared >= threshold * len(wanted):
                    rows.append((text, item, shared))
    return np.array(rows, np.int64).reshape(-1, 3)


def _blocks(items: DataFrame, words: int) -> Iterator[ItemIndex]:
    """The items in blocks of bounded size, read one by one."""
    rows, size = [], 0
    wanted = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).filter(
        "item_id is not null and text is not null"
    )
    for item_id, text in wanted.toLocalIterator():
        if rows and (len(rows) == BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield ItemIndex(rows, words)
            rows, size = [], 0
        rows.append((item_id, bytes(text)))
        size += len(text)
    if rows:
        yield ItemIndex(rows, words)


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): items of which at least ``threshold`` per
    cent of the distinct word shingles are in the document.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. An item with
    fewer than ``words`` words is one shingle, found as a run of words. Null or empty texts contain
    nothing and are contained in nothing; items without an id are left out. A document without
    an id is reported with a null. Repeated rows are reported as often as they occur, repeated
    items too.
    """
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    context, result = docs.sparkSession.sparkContext, None
    for block in _blocks(items, words):
        shared_index = context.broadcast(block)

        def search(batches, shared_index=shared_index):
            index = shared_index.value
            for whole in batches:
                for batch in batches_of(whole, "text", 1 << 20):
                    found = _contained(batch["text"], index, words, threshold)
                    if len(found):
                        sizes = np.array([len(index.sets[i]) for i in found[:, 1]])
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch["doc_id"].take(pa.array(found[:, 0])),
                                pa.array(index.ids[found[:, 1]]),
                                pa.array(sizes),
                                pa.array(found[:, 2]),
                                pa.array(found[:, 2] / sizes),
                            ],
                            ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                        )

        part = texts_of(docs).mapInArrow(search, schema)
        result = part if result is None else result.union(part)
    return result if result is not None else docs.sparkSession.createDataFrame([], schema)


def without_items(docs: DataFrame, items: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain none of the items, with all their columns."""
    context, kept = docs.sparkSession.sparkContext, docs
    for block in _blocks(items, words):
        shared_index = context.broadcast(block)

        def clean(texts: pa.Array, shared_index=shared_index) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[_contained(texts, shared_index.value, words, threshold)[:, 0]] = False
            return keep

        kept = filter_texts(kept, clean)
    return kept
