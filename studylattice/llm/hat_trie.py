"""Counts of word-id sequences: burstable hash containers under a shallow trie over word ids.

A node splits the ids at one depth into ranges. A range belongs to a hash container, which holds
the rest of the sequences, or, for a single id, to a node one level deeper. A container that grows too
large bursts: its range is cut in two, or, where one id makes up most of it, that id gets a node of
its own. When the whole trie is full, its largest subtrees leave it as sorted runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from studylattice.llm.common import mixed

BURST = 1 << 14  # sequences in a container
FULL = 1 << 19  # sequences in a trie
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(2**64 - 1)


def folded(rows: np.ndarray) -> np.ndarray:
    """One hash for each row of ids."""
    value = np.full(len(rows), np.uint64(rows.shape[1]))
    for column in rows.T:
        value = mixed(value * _MULTIPLIER + column)
    return value


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with equal neighbours in hash order added up; nearly all repeats are gone."""
    if not len(rows):
        return rows, counts
    hashes = folded(rows)
    order = np.argsort(hashes)
    rows = rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(fresh)
    return rows[first], np.add.reduceat(counts[order], first)


class Container:
    """A hash table with linear probing; count 0 marks a free slot."""

    def __init__(self, width: int) -> None:
        self.size = 0
        self._open(width, 64)

    def _open(self, width: int, slots: int) -> None:
        self.keys = np.zeros((slots, width), np.uint64)
        self.counts = np.zeros(slots, np.int64)
        self.owner = np.zeros(slots, np.int64)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        slots = len(self.counts)
        while 2 * (self.size + len(rows)) > slots:
            slots *= 2
        if slots > len(self.counts):
            old_rows, old_counts = self.rows()
            self._open(rows.shape[1], slots)
            self.size = 0
            self._place(old_rows, old_counts)
        self._place(rows, counts)

    def _place(self, rows: np.ndarray, counts: np.ndarray) -> None:
        mask = np.uint64(len(self.counts) - 1)
        waiting = np.arange(len(rows))
        slot = (folded(rows) & mask).astype(np.int64)
        while len(waiting):
            at = slot[waiting]
            used = self.counts[at] > 0
            # Of the rows that want a free slot the last one gets it.
            self.owner[at] = waiting
            placed = ~used & (self.owner[at] == waiting)
            self.keys[at[placed]] = rows[waiting[placed]]
            self.counts[at[placed]] = counts[waiting[placed]]
            self.size += int(placed.sum())
            same = ~placed & (self.keys[at] == rows[waiting]).all(axis=1)
            np.add.at(self.counts, at[same], counts[waiting[same]])
            left = ~placed & ~same
            waiting = waiting[left]
            slot[waiting] = (at[left] + 1) & int(mask)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.counts > 0
        return self.keys[used], self.counts[used]

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sequences in order."""
        rows, counts = self.rows()
        if len(rows):
            order = np.lexsort(rows.T[::-1])
            yield rows[order], counts[order]


class Node:
    """Children by ranges of the id at this depth; range i begins at ``starts[i]``."""

    def __init__(self, width: int, burst: int) -> None:
        self.width, self.burst = width, burst
        self.starts = np.zeros(1, np.uint64)
        self.children: list[Container | Node] = [Container(width)]

    @property
    def size(self) -> int:
        return sum(child.size for child in self.children)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        spot = np.searchsorted(self.starts, rows[:, 0], "right") - 1
        order = np.argsort(spot, kind="stable")
        edges = np.searchsorted(spot[order], np.arange(len(self.children) + 1))
        # From the right, because a burst moves the ranges after it.
        for i in reversed(range(len(self.children))):
            own = order[edges[i] : edges[i + 1]]
            if not len(own):
                continue
            child = self.children[i]
            if isinstance(child, Node):
                child.add(rows[own, 1:], counts[own])
                continue
            child.add(rows[own], counts[own])
            if child.size > self.burst:
                self._burst(i)

    def _burst(self, i: int) -> None:
        """Replace container ``i`` by smaller ones, as often as needed."""
        rows, counts = self.children[i].rows()
        ids, sizes = np.unique(rows[:, 0], return_counts=True)
        top = int(np.argmax(sizes))
        heavy = ids[top] if self.width > 1 and 2 * sizes[top] > len(rows) else None
        if heavy is None:
            cuts = [ids[np.searchsorted(np.cumsum(sizes), len(rows) // 2) or 1]]
        else:
            cuts = [heavy, heavy + np.uint64(1)] if heavy < _LAST else [heavy]
        starts = np.array([self.starts[i], *(c for c in cuts if c > self.starts[i])], np.uint64)
        spot = np.searchsorted(starts, rows[:, 0], "right") - 1
        made: list[Container | Node] = []
        for k, start in enumerate(starts):
            own = spot == k
            if heavy is not None and start == heavy:
                made.append(Node(self.width - 1, self.burst))
                made[-1].add(rows[own, 1:], counts[own])
            else:
                made.append(Container(self.width))
                made[-1].add(rows[own], counts[own])
        self.starts = np.concatenate([self.starts[:i], starts, self.starts[i + 1 :]])
        self.children[i : i + 1] = made
        for k in reversed(range(i, i + len(made))):
            if isinstance(self.children[k], Container) and self.children[k].size > self.burst:
                self._burst(k)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(len(self.children)):
            yield from self.child_runs(i)

    def child_runs(self, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sequences under child ``i`` in order, in pieces of a container each."""
        for rows, counts in self.children[i].runs():
            if isinstance(self.children[i], Node):
                rows = np.column_stack([np.full(len(rows), self.starts[i]), rows])
            yield rows, counts


class HatTrie:
    """A trie of bounded size for sequences of ``width`` ids."""

    def __init__(self, width: int, full: int = FULL, burst: int = BURST) -> None:
        self.root, self.full, self.burst = Node(width, burst), full, burst

    def add(self, rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count sequences; yields the sorted runs of the subtrees that had to leave."""
        if len(rows):
            self.root.add(*summed(rows, counts))
        if self.root.size <= self.full:
            return
        sizes = [child.size for child in self.root.children]
        left = sum(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if 2 * left <= self.full:
                break
            yield from self.root.child_runs(i)
            left -= sizes[i]
            child = self.root.children[i]
            width = self.root.width
            self.root.children[i] = Node(width - 1, self.burst) if isinstance(child, Node) else Container(width)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self.root.runs()
