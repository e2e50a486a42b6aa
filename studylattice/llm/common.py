"""Helpers shared by the text operators: hashed words, shingles, checked broadcasts.

Words are runs of bytes other than space and tab to carriage return, with A-Z lower-cased. They
are hashed for whole Arrow batches at once, straight from the text buffer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sides up to this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
# Bytes of text hashed in one step; longer texts are cut at white space.
STEP_BYTES = 1 << 20

# Most bits of a bitmap that goes to all tasks: 8 MB.
BITS = 1 << 26
_BITMAP_BITS = 8 * 4096  # of one row of Spark's bitmap aggregate

# Rows that go to a Python worker at once; Spark's default is made for rows of numbers, not texts.
ARROW_ROWS = 500
# Bytes of text scored in one step; the arrays made of them are many times as large.
SCORED_BYTES = 1 << 18

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    table = np.full(count, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UP = _powers(_BASE, STEP_BYTES)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), STEP_BYTES)


def _hash_words(
    data: np.ndarray, edges: np.ndarray, separators: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start and end positions of the words of ``data``; no word crosses one of ``edges``.

    A word's hash is a polynomial over its bytes, taken from running sums of the whole buffer.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~separators[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = edges[(edges > 0) & (edges < n)]
    opens[inner] = solid[inner]
    closes = np.zeros(n + 1, bool)
    closes[1:] = solid
    closes[1:n] &= ~solid[1:]
    closes[inner] = solid[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    up, down = (_UP, _DOWN) if n <= STEP_BYTES else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64) * _MULTIPLIER), starts, ends


def _steps(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about STEP_BYTES that end between words."""
    start, end = int(offsets[0]), int(offsets[-1])
    while start < end:
        stop = min(end, start + STEP_BYTES)
        if stop < end:
            border = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if border > start:
                stop = border
            else:
                stop += int(np.argmax(np.append(separators[data[stop:end]], True)))
        yield start, stop
        start = stop


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a binary array in order, and where each text's words begin and end."""
    data, offsets = text_bytes(texts)
    hashes, _, ends = word_runs(data, offsets, _SPACE)
    bounds = np.searchsorted(ends, offsets, "right")
    bounds[0] = 0
    return hashes, bounds


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes behind a binary array and the offsets of its texts in them."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def word_runs(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end in ``data`` of every run of bytes that are not ``separators`` (256 flags), A-Z
    lower-cased; no run crosses a text's border."""
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for start, stop in _steps(data, offsets, separators):
        inside = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, "right")]
        hashes, starts, ends = _hash_words(data[start:stop], inside - start, separators)
        found.append((hashes, starts + start, ends + start))
    return tuple(np.concatenate(column) for column in zip(*found))


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words in order, and their bounds; a text with fewer
    words is one shingle, a text without words none."""
    counts = np.diff(bounds)
    folded = np.full(len(hashes), np.uint64(size))
    for i in range(size):
        whole = max(0, len(hashes) - i)
        folded[:whole] = mixed(folded[:whole] * _MULTIPLIER + hashes[i:])
    kept = np.ones(len(hashes), bool)
    for i in range(1, size):
        kept[bounds[1:][counts >= i] - i] = False
    for text in np.flatnonzero((counts > 0) & (counts < size)):
        value = np.full(1, np.uint64(counts[text]))
        for word in hashes[bounds[text] : bounds[text + 1]]:
            value = mixed(value * _MULTIPLIER + word)
        folded[bounds[text]] = value[0]
        kept[bounds[text]] = True
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return folded[kept], np.concatenate([[0], np.cumsum(made)])


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and their bounds."""
    ordered = values.copy()
    fresh = np.ones(len(values), bool)
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if stop - start > 1:
            part = ordered[start:stop]
            part.sort()
            np.not_equal(part[1:], part[:-1], out=fresh[start + 1 : stop])
    return ordered[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of distinct shingles of a binary array's texts: sorted hashes, and their bounds."""
    return distinct(*shingles(*hashed_words(texts), size))


def batches_of(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in a binary ``column``, at least one row each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list<int64> array of 64-bit values cut at ``bounds``."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python workers in batches of ARROW_ROWS, a session setting, and let the
    workers find this package wherever the driver was started."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text as bytes; null texts stay null."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows take at most BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def bitmap_of(hashes: DataFrame, rows: int, most: int = BITS) -> np.ndarray:
    """Flags, one bit each, at the places the column ``hash`` leads to; at most ``most``. Runs a job."""
    bits = _BITMAP_BITS
    while bits < min(most, 16 * rows):
        bits *= 2
    slot = F.col("hash").bitwiseAND(bits - 1) + 1
    parts = (
        hashes.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("flags"))
    )
    flags = np.zeros(bits // 8, np.uint8)
    for bucket, part in parts.collect():
        at = (bucket - 1) * (_BITMAP_BITS // 8)
        flags[at : at + len(part)] = np.frombuffer(bytes(part), np.uint8)
    return flags


def flagged(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(flags) - 1)
    return (flags[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_texts(docs: DataFrame, keep) -> DataFrame:
    """The rows of ``docs`` for whose texts ``keep`` (binary array -> boolean numpy array) says so,
    with all columns and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            texts = pa.RecordBatch.from_arrays([whole["text"].cast(pa.binary())], ["text"])
            for part in batches_of(texts, "text", SCORED_BYTES):
                yield whole.slice(at, part.num_rows).filter(pa.array(keep(part["text"])))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def remainder(modulus: int):
    """crc32 of the doc_id as text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def held_out_rows(modulus: int, left_out: int):
    return F.coalesce(remainder(modulus) == left_out, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, rows: int, longest: int | None = None
) -> DataFrame:
    """(text, label) of at most about ``rows`` labelled documents, as evenly of both classes as they
    come, plus the weight that gives a class its share of all labels back.

    Rows whose id leaves the remainder ``left_out`` are not looked at. Labels other than 0 and 1,
    null ids, and labels of documents that are not in ``docs`` or whose texts have more than ``longest`` bytes are left
    out; of several labels of an id the larger counts. Sampling is by a hash of the id, so it is the same in every run.
    Only the chosen ids, at most about ``rows``, are broadcast.
    """
    docs = docs if longest is None else docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    usable = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out_rows(modulus, left_out) & F.col("doc_id").isNotNull())
        .join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    lesser = min(rows // 2, *counts.values()) if counts else 0
    quota = {k: n if n == lesser else min(n, rows - lesser) for k, n in counts.items()}
    total, scale = sum(counts.values()), 1 << 20
    chosen = usable.filter("false")
    for value, n in counts.items():
        share = int(scale * quota[value] / n)
        chosen = chosen.union(
            usable.filter((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share)).select(
                "doc_id", "label"
            )
        )
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col("label") == value, F.lit(n / total / (quota[value] / sum(quota.values())))).otherwise(weight)
    return texts_of(docs).join(F.broadcast(chosen.withColumn("weight", weight)), "doc_id").select(
        "text", "label", "weight"
    )
