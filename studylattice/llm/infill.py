"""Fill-in-the-middle: documents cut at two unit borders and put together in another order.

A unit is white space with the word after it, or the white space at a text's end. Every byte has a
character class: white space, first byte of a character, later byte of a character, and each of the
three once more for the byte that ends a unit. A wavelet matrix over the classes of many texts
answers rank queries; the ranks of the three ending classes add up to the number of unit borders
before a position, and bisection on that count finds the cuts of all texts at once. The same
matrix gives lengths in characters, as every byte but the later ones counts.

Nothing is shuffled: each text is cut where it is read, in steps of bounded size. A null text
counts as empty, a null id is hashed as the empty string, repeated rows give repeated results,
other columns are not looked at, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylattice.llm.common import STEP_BYTES, batches_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 42
# Of 100 texts, how many are cut, and of 100 cut ones, how many have the suffix first.
CUT_SHARE, SPM_SHARE = 50, 80

SPACE, FIRST, LATER = 0, 1, 2
ENDS = 3  # added to the class of a byte that ends a unit
_CLASS_BITS = 3
_BLOCK = 64  # positions a rank block covers
_SPACES = [9, 10, 11, 12, 13, 32]


class WaveletMatrix:
    """Ranks of small symbols: how many of the first ``n`` are ``symbol``, for arrays of ``n``."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            padded = np.zeros((len(symbols) // _BLOCK + 1) * _BLOCK, np.uint8)
            padded[: len(symbols)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((words, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, level: int, n: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        block = n // _BLOCK
        below = (np.uint64(1) << (n % _BLOCK).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & below)

    def rank(self, symbol: int, n: np.ndarray) -> np.ndarray:
        start = np.zeros(1, np.int64)
        for level, (_, _, zeros) in enumerate(self.levels):
            if symbol >> (len(self.levels) - 1 - level) & 1:
                start, n = zeros + self._ones(level, start), zeros + self._ones(level, n)
            else:
                start, n = start - self._ones(level, start), n - self._ones(level, n)
        return n - start


def byte_classes(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Class of every byte; texts end before ``stops`` and no unit runs over such a place."""
    space = np.zeros(256, bool)
    space[_SPACES] = True
    white = space[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~white[:-1] & white[1:]
    ends[stops[stops > 0] - 1] = True
    kinds = np.where(white, SPACE, np.where((data & 0xC0) == 0x80, LATER, FIRST)).astype(np.uint8)
    return kinds + ends.astype(np.uint8) * np.uint8(ENDS)


class Cutter:
    """Unit counts and cuts of the texts in ``data``, text i from ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.starts, self.stops = bounds[:-1], bounds[1:]
        self.matrix = WaveletMatrix(byte_classes(data, self.stops[self.stops > self.starts]), _CLASS_BITS)
        self.before = self._borders(self.starts)
        self.units = self._borders(self.stops) - self.before

    def _borders(self, n: np.ndarray) -> np.ndarray:
        """Unit borders at or before byte ``n``."""
        return sum(self.matrix.rank(kind + ENDS, n) for kind in (SPACE, FIRST, LATER))

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """Byte position in the text after so many units, by bisection on the border count."""
        low, high = self.starts.copy(), self.stops.copy()
        wanted = self.before + units
        while (low < high).any():
            middle = (low + high) // 2
            enough = self._borders(middle) >= wanted
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low - self.starts

    def characters(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Characters between byte positions of the texts."""
        later = [
            self.matrix.rank(LATER, self.starts + n) + self.matrix.rank(LATER + ENDS, self.starts + n)
            for n in (start, stop)
        ]
        return (stop - start) - (later[1] - later[0])


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.binary()),
    ]
)


def _transformed(part: pa.RecordBatch) -> pa.RecordBatch:
    texts = part["text"].cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    cutter = Cutter(data, bounds - bounds[0])
    draws = [part[c].to_numpy(zero_copy_only=False) % (cutter.units + 1) for c in ("h1", "h2")]
    first, second = cutter.cuts(np.minimum(*draws)), cutter.cuts(np.maximum(*draws))
    forms = part["form"].to_pylist()
    cut = np.array([form != PLAIN for form in forms], bool)
    prefixes = cutter.characters(np.zeros_like(first), first)
    middles = cutter.characters(first, second)
    outputs = []
    for text, form, a, b in zip(texts.to_pylist(), forms, first.tolist(), second.tolist()):
        prefix, middle, suffix = (PREFIX.encode(), text[:a]), (MIDDLE.encode(), text[a:b]), (SUFFIX.encode(), text[b:])
        if form == PLAIN:
            outputs.append(text)
        else:
            order = (prefix, suffix, middle) if form == PSM else (suffix, prefix, middle)
            outputs.append(b"".join(mark + piece for mark, piece in order))
    columns = [
        part["doc_id"],
        pa.array(cutter.units),
        part["form"],
        pa.array(prefixes, mask=~cut),
        pa.array(middles, mask=~cut),
        pa.array(outputs, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_RESULT)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in batches_of(whole, "text", STEP_BYTES):
            yield _transformed(part)


def _form(text: Column, share: Column, order: Column) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (share % 100 >= CUT_SHARE)
    return F.when(plain, PLAIN).when(order % 100 < SPM_SHARE, SPM).otherwise(PSM)


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    The draws are the first four 32-bit groups of the SHA-256 of ``seed:doc_id``: two for the cuts, one for
    whether the text is cut, one for the order of the pieces. Texts that hold a marker stay plain.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(F.col("_digest"), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
        digest.alias("_digest"),
    ).select(
        "doc_id",
        F.col("_text").cast("binary").alias("text"),
        draw[0].alias("h1"),
        draw[1].alias("h2"),
        _form(F.col("_text"), draw[2], draw[3]).alias("form"),
    )
    made = rows.mapInArrow(_run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from the output and its form alone. No text that was cut
    holds a marker, so the markers in the output are the three that were put in."""
    pieces = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(pieces, F.lit(0)), F.get(pieces, F.lit(2)), F.get(pieces, F.lit(1)))
    spm = F.concat(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(2)), F.get(pieces, F.lit(0)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
