"""Burrows-Wheeler transforms of shards, merged by refining their interleave.

Texts are read as strings of five-byte symbols, one string for each of the five phases, so that a run of LENGTH
bytes is a run of twenty symbols at every start. A shard is sorted by itself. The merge never
compares suffixes: from the order of all suffixes by their first k symbols, a stable pass over the merged transform by
its symbols gives the order by k + 1. Where two neighbours part in round k their common prefix has k - 1
symbols, so the blocks that are left after twenty rounds are the intervals of equal runs.
"""

from __future__ import annotations

import numpy as np

LENGTH = 100  # bytes of a run
WIDTH = 5  # bytes of a symbol
SHARD_BYTES = 1 << 18
_BEYOND = 1 << 60


class Shard:
    """Suffixes of some texts in order, and for each the symbol before it.

    Suffixes are numbered: first the ends of all symbol strings, then the text positions. Ends sort first, by
    number, so the order is total.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        starts, sizes = bounds[:-1], np.maximum(np.diff(bounds) - WIDTH + 1, 0)
        texts = np.repeat(np.arange(len(starts)), sizes)
        offset = np.arange(len(texts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = starts[texts] + offset
        symbols = np.zeros(len(at), np.uint64)
        for i in range(WIDTH):
            symbols = (symbols << np.uint64(8)) | data[at + i]
        # The string of a position is the phase it lies in; short texts have fewer strings.
        self.ends = ends = len(starts) * WIDTH
        last = offset + WIDTH >= sizes[texts]
        string = texts * WIDTH + offset % WIDTH
        following = np.where(last, string, ends + np.arange(len(at)) + WIDTH)
        before = np.where(offset < WIDTH, -1, ends + np.arange(len(at)) - WIDTH)
        count = ends + len(at)
        order, own = sorted_places(symbols, 8 * WIDTH)
        ranks = np.arange(count)
        ranks[ends + order] = ends + np.cumsum(np.append(False, own[1:] != own[:-1]))
        following = np.concatenate([np.arange(ends), following])
        bits = max(1, int(count).bit_length())
        while True:
            keys = (ranks.astype(np.uint64) << np.uint64(bits)) | ranks[following].astype(np.uint64)
            order, own = sorted_places(keys, 2 * bits)
            ranks = np.empty(count, np.int64)
            ranks[order] = np.cumsum(np.append(False, own[1:] != own[:-1]))
            if ranks[order[-1]] == count - 1:
                break
            following = following[following]
        # Text and offset of every suffix in order; an end lies beyond any text.
        self.text = np.concatenate([np.repeat(np.arange(len(starts)), WIDTH), texts])[order]
        self.offset = np.concatenate([np.full(ends, _BEYOND), offset])[order]
        # Before a string's end stands its last position, before its first position nothing.
        previous = np.full(count, -1)
        previous[ends:] = before
        previous[string[last]] = ends + np.flatnonzero(last)
        self.first = previous[order] < 0
        self.symbol = np.where(self.first, 0, np.concatenate([np.zeros(ends, np.uint64), symbols])[previous[order]])
        self.step = np.where(self.first, 0, ranks[previous[order]])


def sorted_places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of values of so many bits, and the values in it."""
    place_bits = max(1, int(len(values)).bit_length())
    if bits + place_bits > 64:
        order = np.argsort(values, kind="stable")
        return order, values[order]
    # A value and its place share a number, so a plain sort is stable.
    keys = np.sort((values << np.uint64(place_bits)) | np.arange(len(values), dtype=np.uint64))
    return (keys & np.uint64((1 << place_bits) - 1)).astype(np.int64), keys >> np.uint64(place_bits)


def merged_blocks(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of the shards that share their first ``rounds`` symbols with another one, in order, as
    numbers into the shards' orders one after the other, and the number of the block of equal ones that each
    lies in.

    A suffix that is alone in its block leaves: what stands before it is alone in the next round. Ends differ from all
    others, so they are looked at before the first round only.
    """
    bases = np.cumsum([0, *(len(s.text) for s in shards)])
    symbol = np.concatenate([s.symbol for s in shards])
    first = np.concatenate([s.first for s in shards])
    step = np.concatenate([s.step + b for s, b in zip(shards, bases)])
    merged = np.arange(len(symbol))
    block = np.zeros(len(merged), np.int64)
    for _ in range(rounds):
        inner = np.flatnonzero(~first[merged])
        numbers = merged[inner]
        order, own = sorted_places(symbol[numbers], 8 * WIDTH)
        was = block[inner[order]]
        fresh = np.ones(len(order) + 1, bool)
        fresh[1:-1] = (own[1:] != own[:-1]) | (was[1:] != was[:-1])
        shared = ~(fresh[:-1] & fresh[1:])
        block = np.cumsum(fresh[:-1])[shared]
        merged = step[numbers[order[shared]]]
    return merged, block


def repeated_runs(
    data: np.ndarray, bounds: np.ndarray, shard_bytes: int = SHARD_BYTES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of LENGTH bytes that occur more than once in the texts: text, offset, and the number of
    the class of equal runs, one entry an occurrence, classes one after the other."""
    empty = np.empty(0, np.int64)
    if len(bounds) < 2:
        return empty, empty, empty
    cuts = np.unique(np.searchsorted(bounds, np.arange(0, bounds[-1] - bounds[0], shard_bytes) + bounds[0]))
    cuts = np.unique([0, *cuts.tolist(), len(bounds) - 1])
    shards = [Shard(data, bounds[a : b + 1]) for a, b in zip(cuts[:-1], cuts[1:])]
    merged, block = merged_blocks(shards, LENGTH // WIDTH)
    text = np.concatenate([s.text + first for s, first in zip(shards, cuts)])[merged]
    offset = np.concatenate([s.offset for s in shards])[merged]
    # Blocks are runs of symbols, so all of a block's suffixes are long enough.
    return text, offset, block
