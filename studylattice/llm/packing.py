"""Packing documents into training sequences: first-fit decreasing in randomised groups.

Every partition of the input is packed where it is; nothing is shuffled and no task holds more than
a few groups of document ends.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from studylattice.llm.common import batches_of, texts_of

SEQUENCE_TOKENS = 1024
# Documents in a group, and groups that a partition fills side by side.
GROUP_DOCS, OPEN_GROUPS = 1024, 4
# Words whose ids a worker keeps, and the longest of them in characters.
CACHED_WORDS, CACHED_LENGTH = 200_000, 64

# A pre-token never runs from a non-space over a space, so texts may be cut at single spaces that
# stand between non-spaces. Texts with other spaces are encoded whole.
_ODD_SPACE = re.compile(r"(?:^|\s) | (?:\s|$)")


def _as_bytes(token: str) -> bytes:
    """The bytes that a byte-level vocabulary writes as printable characters."""
    return bytes(map(_byte_values().__getitem__, token))


@lru_cache(maxsize=1)
def _byte_values() -> dict[str, int]:
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts, word by word with a bounded cache; equal to encoding the whole text.

    New words go through a faster encoder over the same vocabulary file, all in one string: each
    word keeps the space before it, so a token that begins with a space begins a word.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        characters = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(added)
        ranks = {_as_bytes(token): i for token, i in characters.items() if token not in added}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _new_words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = np.array(self.words.encode_ordinary(" " + " ".join(words)), "<u4")
        starts = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens added."""
        plain = [not _ODD_SPACE.search(t) and not any(s in t for s in self.special) for t in texts]
        rest = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        cut = [t.split(" ") if p else [] for t, p in zip(texts, plain)]
        heads = iter(self._whole([parts[0] for parts in cut if parts]))
        known = self.known
        fresh = list({word for parts in cut for word in parts[1:]} - known.keys())
        known.update(zip(fresh, self._new_words(fresh)))
        encoded = [
            next(heads) + b"".join(map(known.__getitem__, parts[1:])) if parts else next(rest) for parts in cut
        ]
        full = len(known) > CACHED_WORDS
        for word in fresh:
            if full or len(word) > CACHED_LENGTH:
                del known[word]
        return encoded


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class TournamentTree:
    """Bins in a row; every inner node holds the larger free space of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin that has it; returns the bin."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        chosen = node - self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return chosen


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; larger items first, each into the first bin with room."""
    tree = TournamentTree(len(sizes), capacity)
    bins: dict[int, list[int]] = {}
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins.setdefault(tree.place(sizes[item]), []).append(item)
    return list(bins.values())


def pack_group(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) that hold every item once.

    After first-fit decreasing, the emptiest bins are cut up to fill the gaps of the others, so at
    most one is left with room; it is cut into sequences whose lengths are powers of two, which
    need no padding.
    """
    bins = [[(i, 0, sizes[i]) for i in members] for members in first_fit_decreasing(sizes, capacity)]
    fills = [sum(p[2] for p in pieces) for pieces in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fills[b], b))
    taker, giver = 0, len(order) - 1
    while taker < giver:
        to, source = order[taker], order[giver]
        room = capacity - fills[to]
        if not room:
            taker += 1
        elif not fills[source]:
            giver -= 1
        else:
            item, start, length = bins[source].pop()
            moved = min(room, length)
            if moved < length:
                bins[source].append((item, start, length - moved))
            bins[to].append((item, start + length - moved, moved))
            fills[to] += moved
            fills[source] -= moved
    packed = []
    for pieces, fill in zip(bins, fills):
        if fill == capacity:
            packed.append(pieces)
            continue
        for bit in reversed(range(fill.bit_length())):
            want, part = fill & (1 << bit), []
            while want:
                item, start, length = pieces.pop()
                taken = min(want, length)
                if taken < length:
                    pieces.append((item, start, length - taken))
                part.append((item, start + length - taken, taken))
                want -= taken
            if part:
                packed.append(part)
    return packed


class _Packer:
    """Pieces of a partition's documents; rows leave as soon as their sequence is decided."""

    columns = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")

    def __init__(self, capacity: int, separator: int) -> None:
        self.capacity, self.end = capacity, np.array([separator], "<u4").tobytes()
        self.open: list[list[tuple]] = [[] for _ in range(OPEN_GROUPS)]
        context = TaskContext.get()
        self.sequence = (context.partitionId() if context else 0) << 33
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, ids, tokens, self.sequence, offset))
            offset += length
        self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        ids += self.end
        tokens, width = len(ids) // 4, 4 * self.capacity
        whole = tokens // self.capacity
        for k in range(whole):
            self._emit([(doc_id, k * self.capacity, ids[k * width : (k + 1) * width], tokens)])
        if rest := ids[whole * width :]:
            group = self.open[xxhash.xxh3_64_intdigest(rest, len(rest)) % OPEN_GROUPS]
            group.append((doc_id, whole * self.capacity, rest, tokens))
            if len(group) == GROUP_DOCS:
                self.close(group)

    def close(self, group: list[tuple]) -> None:
        for sequence in pack_group([len(g[2]) // 4 for g in group], self.capacity):
            self._emit(
                [
                    (group[i][0], group[i][1] + start, group[i][2][4 * start : 4 * (start + length)], group[i][3])
                    for i, start, length in sequence
                ]
            )
        group.clear()

    def batch(self) -> pa.RecordBatch:
        values = list(zip(*self.rows)) or [[]] * len(self.columns)
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in zip(self.columns, values)],
            list(self.columns),
        )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, separator: int = 0) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most ``capacity`` tokens.

    A document is its ids and then ``separator``. Whole sequences are cut from its front; its end
    joins one of the groups of its partition at random (by a hash of the ids) and is packed
    there. Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. A sequence is full or a power of two long.

    A null or empty text is only the separator. Repeated rows are packed as often as they occur, a
    null doc_id stays null, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(tokenizer_path), _Packer(capacity, separator)
        for whole in batches:
            for batch in batches_of(whole, "text", 1 << 20):
                texts = [(t or b"").decode("utf-8", "replace") for t in batch["text"].to_pylist()]
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(texts)):
                    packer.add(doc_id, ids)
                yield packer.batch()
        for group in packer.open:
            if group:
                packer.close(group)
        yield packer.batch()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return texts_of(docs).mapInArrow(run, schema)
