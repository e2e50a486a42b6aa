"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams, so a misspelling shares most of its
vectors with the word it comes from. Words are averaged over short passages, a softmax over the
passage's vector says how toxic it is, and a document is as toxic as its worst passage.
Embeddings and softmax are trained together in numpy. Only the text is used.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylattice.llm.common import (
    SCORED_BYTES,
    batches_of,
    filter_texts,
    held_out_rows,
    labelled_sample,
    mixed,
    texts_of,
)

# Training reads at most about this many labelled documents, and none with more bytes.
TRAINING_ROWS, TRAINING_BYTES = 4_000, 1 << 15
MODULUS, LEFT_OUT = 5, 0
THRESHOLD = 0.5
BUCKET_BITS, DIMENSIONS = 17, 8
BUCKETS = 1 << BUCKET_BITS
# Lengths of n-grams in bytes, the marks at a word's borders included.
GRAMS = (3, 4, 5, 7)
PASSAGE_WORDS = 4
STEPS, RATE, DECAY, MIN_PASSAGES = 100, 0.08, 3e-5, 4

# Bytes that end a word: everything in ASCII but letters and digits.
_BORDER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_CODES = mixed(np.arange(1, 256 * max(GRAMS) + 1, dtype=np.uint64)).reshape(max(GRAMS), 256)
_CODES = (_CODES >> np.uint64(32)).astype(np.uint32)
_SPREAD = np.uint32(0x9E3779B1)


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes * _SPREAD) >> np.uint32(32 - BUCKET_BITS)


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])


@dataclass
class _Words:
    """The words of some bytes: where they lie, and ``data`` with one border byte for all borders."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, text: bytes) -> _Words:
        data = np.frombuffer(b" " + text + b" " * max(GRAMS), np.uint8).copy()
        border = _BORDER[data]
        data[border] = 32
        change = np.diff(border.view(np.int8))
        return cls(data, np.flatnonzero(change == -1) + 1, np.flatnonzero(change == 1) + 1)

    def grams(self):
        """For each length: the bucket of the n-gram at every byte, and whether it lies in a word
        with its borders. N-grams may begin or end with a border, but not run over one."""
        count = len(self.data) - max(GRAMS)
        codes, clear = np.zeros(count, np.uint32), np.ones(count, bool)
        for n in range(max(GRAMS)):
            codes = codes + _CODES[n][self.data[n : n + count]]
            if n + 1 in GRAMS:
                yield n + 1, _bucket(codes), clear
            if n:
                clear = clear & (self.data[n : n + count] != 32)

    def pulls(self, pull: np.ndarray) -> np.ndarray:
        """The mean of ``pull`` over the buckets of each word."""
        total, count = np.zeros(len(self.starts)), np.zeros(len(self.starts))
        for n, buckets, clear in self.grams():
            sums = _running(np.where(clear, pull[buckets], 0.0))
            lasts = np.maximum(self.ends + 2 - n, self.starts - 1)
            total += sums[lasts] - sums[self.starts - 1]
            count += lasts - self.starts + 1
        return total / count

    def bags(self) -> tuple[np.ndarray, np.ndarray]:
        """All buckets of all words, word by word, and how many each word has."""
        owners, found = [], []
        for n, buckets, clear in self.grams():
            lasts = np.maximum(self.ends + 2 - n, self.starts - 1)
            counts = lasts - self.starts + 1
            owner = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.starts[owner] - 1
            owners.append(owner)
            found.append(buckets[at])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(found)[order].astype(np.int32), np.bincount(owner, minlength=len(self.starts))


@dataclass
class ToxicityModel:
    """Embeddings of the n-gram buckets, and the softmax over (harmless, toxic)."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        # With two classes only the difference of their scores matters.
        self.pull = (self.embeddings @ (self.softmax[1] - self.softmax[0])).astype(np.float64)
        self.offset = float(self.bias[1] - self.bias[0])

    def __getstate__(self) -> dict:
        return {"pull": self.pull, "offset": self.offset}

    def score(self, texts: list[str]) -> np.ndarray:
        """The chance that a text's worst passage is toxic; that of no words for an empty one."""
        worst = np.zeros(len(texts))
        encoded = [t.lower().encode("utf-8", "replace") for t in texts]
        words = _Words.of(b" ".join(encoded))
        offsets = np.cumsum([0] + [len(t) + 1 for t in encoded]) + 1
        bounds = np.searchsorted(words.starts, offsets)
        counts = np.diff(bounds)
        some = np.flatnonzero(counts)
        if len(some):
            per_text = -(-counts[some] // PASSAGE_WORDS)
            first = np.cumsum(per_text) - per_text
            within = np.arange(per_text.sum()) - np.repeat(first, per_text)
            passages = np.add.reduceat(words.pulls(self.pull), np.repeat(bounds[some], per_text) + within * PASSAGE_WORDS)
            worst[some] = np.maximum.reduceat(passages, first)
        return 1 / (1 + np.exp(-np.clip(worst / PASSAGE_WORDS + self.offset, -30, 30)))


class _Adam:
    def __init__(self, value: np.ndarray) -> None:
        self.value, self.first, self.second, self.steps = value, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.01 * (gradient * gradient - self.second)
        scale = RATE * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        self.value -= scale * self.first / (np.sqrt(self.second) + 1e-8)


def _summed(groups: np.ndarray, values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values[at]`` by group, in parts that keep memory small."""
    total = np.zeros(size)
    for start in range(0, len(at), 1 << 20):
        total += np.bincount(groups[start : start + (1 << 20)], values[at[start : start + (1 << 20)]], size)
    return total


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> ToxicityModel:
    """Train on whole texts. The passages of a text are pooled by a soft maximum that hardens while
    training goes on, so at first all passages count and at last the worst one."""
    numbers: dict[bytes, int] = {}
    token, lengths = array("i"), []
    for text in texts:
        words = _Words.of(text.lower().encode("utf-8", "replace"))
        spelled = words.data.tobytes()
        spans = zip(words.starts.tolist(), words.ends.tolist())
        own = [numbers.setdefault(spelled[a:b], len(numbers)) for a, b in spans]
        own = own or [numbers.setdefault(b"", len(numbers))]
        token.extend(own)
        lengths.append(len(own))
    token, counts = np.array(token), np.array(lengths)
    per_text = -(-counts // PASSAGE_WORDS)
    passages = int(per_text.sum())
    document = np.repeat(np.arange(len(texts)), per_text)
    first = np.cumsum(per_text) - per_text
    within = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = np.repeat(first, counts) + within // PASSAGE_WORDS
    del within
    # The empty word of an empty text takes the place of one without buckets of its own.
    distinct, bags = [w or b"0" for w in numbers], []
    for at in range(0, len(distinct), 20_000):
        bags.append(_Words.of(b" ".join(distinct[at : at + 20_000])).bags())
    grams, sizes = (np.concatenate(part) for part in zip(*bags))
    del distinct, bags
    owner = np.repeat(np.arange(len(numbers), dtype=np.int32), sizes)
    # A word counts once in a passage, so repeats do not drown the rest.
    pairs = passage.astype(np.int64) * len(numbers) + token
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    passage, token = (pairs // len(numbers)).astype(np.int32), (pairs % len(numbers)).astype(np.int32)
    del pairs
    # N-grams that occur in too few passages teach nothing.
    often = _summed(grams, np.bincount(token, minlength=len(numbers)), owner, BUCKETS) >= MIN_PASSAGES
    kept = often[grams]
    owner, grams = owner[kept], grams[kept]

    random = np.random.default_rng(0)
    embeddings = _Adam(random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32))
    softmax = _Adam(np.stack([-np.ones(DIMENSIONS), np.ones(DIMENSIONS)]).astype(np.float32))
    bias = _Adam(np.zeros(2, np.float32))
    weights = np.sqrt(weights) / np.sqrt(weights).sum()
    for step in range(STEPS):
        direction = softmax.value[1] - softmax.value[0]
        pull = embeddings.value @ direction
        word_pull = _summed(owner, pull, grams, len(numbers)) / sizes
        level = _summed(passage, word_pull, token, passages) / PASSAGE_WORDS
        hardness = 0.5 * 20 ** (step / STEPS)
        powers = np.exp(hardness * (level - np.maximum.reduceat(level, first)[document]))
        share = powers / np.add.reduceat(powers, first)[document]
        pooled = np.add.reduceat(share * level, first) + bias.value[1] - bias.value[0]
        slope = weights * (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - labels)
        on_passage = slope[document] * share / PASSAGE_WORDS
        on_word = _summed(token, on_passage, passage, len(numbers)) / sizes
        on_bucket = _summed(grams, on_word, owner, BUCKETS).astype(np.float32)
        change = embeddings.value.T @ on_bucket
        embeddings.step(np.outer(on_bucket, direction).astype(np.float32) + DECAY * embeddings.value)
        softmax.step(np.stack([-change, change]))
        bias.step(np.array([-slope.sum(), slope.sum()], np.float32))
    return ToxicityModel(embeddings.value, softmax.value, bias.value)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """The model for ``labels.toxic``, from rows whose crc32(doc_id) mod 5 is not 0.

    The driver gets the texts of at most about ``rows`` labelled documents of up to TRAINING_BYTES bytes each.
    Without usable labels the model scores 0.5.
    """
    found = labelled_sample(docs, labels, "toxic", MODULUS, LEFT_OUT, rows, TRAINING_BYTES).collect()
    rows_in_order = sorted((bytes(r["text"] or b""), r["label"], r["weight"]) for r in found)
    if not rows_in_order:
        return ToxicityModel(np.zeros((BUCKETS, 1)), np.zeros((2, 1)), np.zeros(2))
    texts, marks, weights = zip(*rows_in_order)
    return fit([t.decode("utf-8", "replace") for t in texts], np.array(marks, float), np.array(weights))


def _decoded(texts: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    A null text counts as empty, a null doc_id is kept and not held out, repeated rows are scored
    each; other columns are ignored and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", SCORED_BYTES):
                scores = shared.value.score(_decoded(batch["text"]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores)], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        held_out_rows(MODULUS, LEFT_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def harmless_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: shared.value.score(_decoded(texts)) < threshold)
