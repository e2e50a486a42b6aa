import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edges import corpus, frame

from studylattice.llm import repeats
from studylattice.llm.bwt_merge import LENGTH, repeated_runs


def plain(rows):
    """Every run of every document looked up among all runs before it."""
    texts = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for doc, text in texts:
        for p in range(len(text) - LENGTH + 1):
            run = text[p : p + LENGTH]
            first[run] = min(first.get(run, (doc, p)), (doc, p))
    out = []
    for (doc_id, _), (doc, text) in zip(rows, texts):
        gone = np.zeros(len(text) + 1, bool)
        for p in range(len(text) - LENGTH + 1):
            if first[text[p : p + LENGTH]] < (doc, p):
                gone[p : p + LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
        out.append((doc_id, len(text), spans, bytes(np.frombuffer(text, np.uint8)[~gone[:-1]])))
    return sorted(out, key=repr)


def found(spark, rows, partitions=3):
    made = repeats.without_repeats(frame(spark, rows, partitions))
    assert made.columns == ["doc_id", "n_bytes", "removed", "kept"]
    out = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in made.collect()]
    return sorted(out, key=repr)


def passages(seed):
    """Texts over a few shared passages, with other words around and inside them."""
    made = random.Random(seed)
    letters = "abcdefgh é"
    shared = ["".join(made.choice(letters) for _ in range(n)) for n in (60, 99, 100, 101, 150, 400)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(made.randint(0, 5)):
            part = made.choice(shared)
            a = made.randint(0, len(part) // 3)
            parts.append(part[a : made.randint(a, len(part))] if made.random() < 0.5 else part)
            parts.append("".join(made.choice(letters) for _ in range(made.randint(0, 40))))
        rows.append((made.randint(1, 50), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_search(spark, seed):
    rows = passages(seed) + [(None, "n" * 130 + "null"), (None, None), (7, "n" * 130), (60, "ab" * 300), (61, ""), (62, "x" * 99)]
    rows += rows[:3]
    assert found(spark, rows) == plain(rows)


def test_corpus_with_long_texts(spark):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in corpus()]
    assert found(spark, rows, 5) == plain(rows)


def test_hot_anchors_are_split(spark, monkeypatch):
    """With the limit at two, every repeated segment is split to single runs."""
    monkeypatch.setattr(repeats, "HOT", 2)
    rows = passages(3)
    assert found(spark, rows) == plain(rows)


def test_wrong_bits_change_nothing(spark, monkeypatch):
    rows = passages(4)
    want = found(spark, rows)
    monkeypatch.setattr(repeats, "bitmap_of", lambda hashes, rows: np.full(8, 255, np.uint8))
    assert found(spark, rows) == want == plain(rows)


def test_texts_longer_than_a_step():
    """The segments of a text read in steps hold every run once, under the anchors of its parts."""
    made = np.random.default_rng(5)
    text = made.integers(97, 107, 3 * repeats.STEP_BYTES + 77).astype(np.uint8)
    long = repeats.Segments(text, np.array([0, len(text)]))
    starts = np.sort(np.concatenate([np.arange(a, a + n) for a, n in zip(long.start, long.runs)]))
    assert (starts == np.arange(len(text) - LENGTH + 1)).all()
    part = text[repeats.STEP_BYTES - 5000 : repeats.STEP_BYTES + 5000]
    own = repeats.Segments(part, np.array([0, len(part)]))
    assert set(own.key.tolist()) <= set(long.key.tolist())


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("shard_bytes", [1 << 20, 700, 60])
def test_merged_transforms_give_all_equal_runs(shard_bytes):
    made = random.Random(shard_bytes)
    base = bytes(made.choice(b"ab") for _ in range(2000))
    texts = [b"", b"x" * 260, b"xy" * 90, b"\0" * 140]
    for _ in range(40):
        a = made.randint(0, 1800)
        text = bytearray(base[a : a + made.choice([0, 3, 50, 99, 100, 104, 168])])
        if text and made.random() < 0.5:
            text[made.randrange(len(text))] = 99
        texts.append(bytes(text))
    want = defaultdict(list)
    for i, text in enumerate(texts):
        for p in range(len(text) - LENGTH + 1):
            want[text[p : p + LENGTH]].append((i, p))
    got = defaultdict(list)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    for text, offset, block in zip(*repeated_runs(np.frombuffer(b"".join(texts), np.uint8), bounds, shard_bytes)):
        got[block].append((int(text), int(offset)))
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def sent(spark, rows, partitions, monkeypatch):
    """Rows and bytes of text that go to the merge."""

    def counted(batches):
        for i, batch in enumerate(batches):
            size = sum(len(t or b"") for t in batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n]) for n in (i, 0, batch.num_rows, size)], ["doc", "copy", "start", "stop"])

    monkeypatch.setattr(repeats, "_repeats", counted)
    monkeypatch.setattr(spark.conf, "get", lambda *a, get=spark.conf.get: "1" if a[0] == "spark.sql.shuffle.partitions" else get(*a))
    found = repeats.repeated_ranges(frame(spark, rows, partitions)).selectExpr("sum(aggregate(ranges.start, 0L, (t, n) -> t + n))", "sum(aggregate(ranges.stop, 0L, (t, n) -> t + n))")
    return found.first()


def letters(seed, n):
    made = random.Random(seed)
    return "".join(made.choice("abcdefghijklmnop") for _ in range(n))


def test_equal_segments_are_sent_without_their_bytes(spark, monkeypatch):
    """Two copies of every document: no anchor has segments that differ."""
    rows = [(i, letters(i % 100, 2000)) for i in range(200)]
    count, size = sent(spark, rows, 4, monkeypatch)
    assert 100 * 40 < count <= 2 * 100 * 80 and size == 0


def test_equal_segments_do_not_make_an_anchor_hot(spark, monkeypatch):
    """A batch sends one row of each of them, however often they occur, and a range for each copy: none is cut to its runs."""
    monkeypatch.setattr(repeats, "HOT", 20)
    count, size = sent(spark, [(i, letters(1, 2000)) for i in range(300)], 4, monkeypatch)
    assert 300 + 40 < count <= 300 + 4 * 80 and size == 0


def test_segments_that_agree_in_the_counted_bits(spark, monkeypatch):
    rows = passages(6)
    want = found(spark, rows)
    monkeypatch.setattr(repeats, "KIND_BITS", 0)
    assert found(spark, rows) == want == plain(rows)


def test_bitmaps_grow_with_the_repeated_anchors(spark):
    hashes = spark.range(1).withColumnRenamed("id", "hash")
    assert 8 * len(repeats.bitmap_of(hashes, 10_000_000)) >= 160_000_000
