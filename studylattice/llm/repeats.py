"""Passages that occur before: bytes covered by a run of 100 bytes that starts earlier as well.

*Segments.* Every run of 100 bytes has an anchor, the smallest by hash of the 32-byte strings in it (of
equal ones the last), so equal runs have equal anchors at equal offsets. Neighbouring runs with one
anchor form a segment, about one for 32 bytes of text. A first pass counts them: eight bytes for each segment that differs in
a batch, with parts of the hashes of its anchor and of the whole. Segments whose anchor occurs once in the whole table
are left where they are; a bitmap of at most BITS bits tells, and a wrong bit only costs work. Of equal segments of a batch
the first goes on, the others are found at once. A segment goes as hashes and place; its bytes go along only
where the segments of its anchor are not all equal.

*Runs.* The segments of an anchor meet in one partition. Of equal ones the first stands for all. Those that
differ are texts of shards whose Burrows-Wheeler transforms are merged; the intervals of equal runs in the
merged order decide which runs of the first segments start earlier elsewhere.

*Hot anchors.* Segments of an anchor that has over HOT different ones are split to single runs, each under
a key of its own and without its bytes, so no key brings more than HOT rows a batch to a partition.

Order is by doc_id, then start; a null doc_id comes first. Rows with one doc_id are one document to that order:
equal starts are not earlier. Null and short texts keep all their bytes, repeated rows get the same result each, other
columns are not looked at, and an empty table gives an empty result. Texts are read in overlapping steps of
STEP_BYTES, so length is bounded by memory for the text itself only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylattice.llm import common
from studylattice.llm.bwt_merge import LENGTH, repeated_runs
from studylattice.llm.common import _powers as powers
from studylattice.llm.common import batches_of, flagged, mixed, text_bytes
from studylattice.session import checkpointed

ANCHOR = 32
HOT = 4096
STEP_BYTES = 1 << 20
# Bytes of text whose segments are compared before any is sent.
BATCH_BYTES = 4 << 20
# Bytes of segments a partition is meant for, and bytes of them merged at once.
PARTITION_BYTES, MERGE_BYTES = 8 << 20, 1 << 20
# Bytes a segment has without its text, and bits of a segment's hash that are counted.
ROW_BYTES, KIND_BITS = 48, 31
# Most bits of a bitmap of anchors: 32 MB.
BITS = 1 << 28

_WINDOW = LENGTH - ANCHOR + 1  # anchors to choose from in a run
_PLACE_BITS = 24
_PLACE_MASK = np.uint64((1 << _PLACE_BITS) - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(2**63)
_LOW = np.uint64(0xFFFFFFFF)


_BASE = 0xD1342543DE82EF95
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_UP = powers(_BASE, STEP_BYTES + LENGTH)
_DOWN = powers(pow(_BASE, -1, 1 << 64), STEP_BYTES + LENGTH)


def _steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about STEP_BYTES: some whole texts, or a part of a long text that shares
    LENGTH - 1 bytes with the next part."""
    i = 0
    while i < len(offsets) - 1:
        start = int(offsets[i])
        j = max(i + 1, int(np.searchsorted(offsets, start + STEP_BYTES, "right")) - 1)
        stop = int(offsets[j])
        if j > i + 1 or stop - start <= STEP_BYTES:
            yield start, stop
        else:
            for part in range(start, stop - LENGTH + 1, STEP_BYTES):
                yield part, min(stop, part + STEP_BYTES + LENGTH - 1)
        i = j


class Segments:
    """Segments of the texts: place in ``data``, number of runs, anchor key and a hash of the whole."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        found = [self._of(int(a), int(b), offsets) for a, b in _steps(offsets) if b - a >= LENGTH]
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        self.start, self.runs, self.key, self.kind = (np.concatenate(c) for c in zip(none, *found))

    def _sums(self, start: int, stop: int) -> np.ndarray:
        sums = np.zeros(stop - start + 1, np.uint64)
        np.cumsum(_BYTE[self.data[start:stop]] * _UP[: stop - start], out=sums[1:])
        return sums

    def _of(self, start: int, stop: int, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        size = stop - start
        sums = self._sums(start, stop)
        anchors = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * _DOWN[: size - ANCHOR + 1])
        places = _PLACE_MASK - np.arange(len(anchors), dtype=np.uint64)
        least, width = (anchors & ~_PLACE_MASK) | places, 1
        while 2 * width <= _WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = _WINDOW - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        # Runs may not cross a text's border.
        inside = offsets[(offsets > start) & (offsets < stop)] - start
        across = np.zeros(len(least) + 1, np.int64)
        np.add.at(across, np.clip(inside - LENGTH + 1, 0, len(least)), 1)
        np.add.at(across, np.minimum(inside, len(least)), -1)
        runs = np.flatnonzero(np.cumsum(across[:-1]) == 0)
        if not len(runs):
            return runs, runs, runs.astype(np.uint64), runs.astype(np.uint64)
        at = (_PLACE_MASK - (least[runs] & _PLACE_MASK)).astype(np.int64)
        fresh = np.ones(len(runs), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (runs[1:] != runs[:-1] + 1)
        first = np.flatnonzero(fresh)
        counts = np.diff(np.append(first, len(runs)))
        begin, at = runs[first], at[first]
        whole = (sums[begin + counts + LENGTH - 1] - sums[begin]) * _DOWN[begin]
        shape = ((at - begin) * LENGTH + counts).astype(np.uint64)
        return begin + start, counts, anchors[at], mixed(whole + shape * _MULTIPLIER)

    def split(self, chosen: np.ndarray) -> None:
        """Cut the chosen segments to single runs, each under its own hash."""
        if not chosen.any():
            return
        counts, firsts = self.runs[chosen], self.start[chosen]
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(firsts, counts) + step
        key = np.empty(len(start), np.uint64)
        for a, b in _steps(np.array([0, len(self.data)])):
            if b - a < LENGTH:
                continue
            sums = self._sums(a, b)
            own = np.flatnonzero((start >= a) & (start <= b - LENGTH))
            at = start[own] - a
            key[own] = mixed((sums[at + LENGTH] - sums[at]) * _DOWN[at])
        self.start = np.concatenate([self.start[~chosen], start])
        self.runs = np.concatenate([self.runs[~chosen], np.ones(len(start), np.int64)])
        self.kind = np.concatenate([self.kind[~chosen], np.repeat(self.key[chosen], counts)])
        self.key = np.concatenate([self.key[~chosen], key])

    def only(self, chosen: np.ndarray) -> None:
        self.start, self.runs, self.key, self.kind = (
            c[chosen] for c in (self.start, self.runs, self.key, self.kind)
        )


def _first_of_each(key: np.ndarray, kind: np.ndarray, doc: np.ndarray, copy: np.ndarray, start: np.ndarray):
    """Rows that stand for their class of equal segments, and rows that start later than those. Rows that
    repeat a place of the same text are in neither."""
    order = np.lexsort((copy, start, doc, kind, key))
    key, kind, doc, copy, start = (c[order] for c in (key, kind, doc, copy, start))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
    leader = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    level = (doc == doc[leader]) & (start == start[leader])
    again = np.zeros(len(order), bool)
    again[1:] = ~fresh[1:] & (doc[1:] == doc[:-1]) & (copy[1:] == copy[:-1]) & (start[1:] == start[:-1])
    return order[level & ~again], order[~level & ~again]


def _spans(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    """Repeated runs as byte ranges, neighbouring ones of a text joined."""
    order = np.lexsort((start, copy, doc))
    doc, copy, start, stop = doc[order], copy[order], start[order], (start + runs + LENGTH - 1)[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(fresh)
    ends = np.maximum.reduceat(stop, first) if len(first) else stop
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (doc[first], copy[first], start[first], ends)], ["doc", "copy", "start", "stop"]
    )


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, copy, text): ids without nulls, and a hash that tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), text.alias("text")).select(
        "doc", F.xxhash64("text").alias("copy"), "text"
    )


def bitmap_of(hashes: DataFrame, rows: int) -> np.ndarray:
    return common.bitmap_of(hashes, rows, BITS)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BATCH_BYTES of text."""

    def joined() -> Iterator[pa.RecordBatch]:
        return batches_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], "text", BATCH_BYTES)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch["text"])).as_py()
        if size >= BATCH_BYTES:
            yield from joined()
            held, size = [], 0
    if held:
        yield from joined()


def _count_segments(places: int):
    """For each of ``places`` the segments whose anchors it counts, as numbers of 64 bits: the low half of the anchor's
    hash, KIND_BITS bits of the segment's, and whether the batch has more such segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            found = Segments(*text_bytes(part["text"]))
            place = ((found.key >> np.uint64(32)) % np.uint64(places)).astype(np.int32)
            kind = (found.kind >> np.uint64(64 - KIND_BITS)) if KIND_BITS else np.zeros_like(found.kind)
            number = (found.key << np.uint64(32)) | (kind << np.uint64(1))
            order = np.lexsort((number, place))
            place, number = place[order], number[order]
            fresh = np.ones(len(order) + 1, bool)
            fresh[1:-1] = (place[1:] != place[:-1]) | (number[1:] != number[:-1])
            first = np.flatnonzero(fresh[:-1])
            number, place = number[first] | ~fresh[first + 1], place[first]
            start = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else first
            bounds = pa.array(np.append(start, len(place)) * 8, pa.int32())
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, bounds.buffers()[1], pa.py_buffer(number)])
            yield pa.RecordBatch.from_arrays([pa.array(place[start]), blobs], ["place", "numbers"])

    return run


# Anchors by what their segments need: one of them only, all equal, some that differ, more than HOT that differ.
_ONE, _EQUAL, _DIFFER, _MANY = range(4)


def _add_up(hot: int):
    """The anchors of some places by what they need: the low halves of their hashes, none for those that occur once, and
    how many segments are to be sent for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for place, numbers in zip(batch["place"].to_pylist(), batch["numbers"].to_pylist()):
                blobs.setdefault(place, []).append(numbers)
        for own in blobs.values():
            number = np.sort(np.frombuffer(b"".join(own), np.uint64))
            anchor = number >> np.uint64(32)
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            other = np.append(True, number[1:] >> np.uint64(1) != number[:-1] >> np.uint64(1))
            kinds = np.add.reduceat(other.astype(np.int64), first)
            sent = np.diff(np.append(first, len(number)))
            again = (sent > 1) | (np.bitwise_or.reduceat(number & np.uint64(1), first) > 0)
            need = np.where(again, np.where(kinds > 1, np.where(kinds > hot, _MANY, _DIFFER), _EQUAL), _ONE)
            hashes = [anchor[first][need == n].astype(np.uint32) if n else np.empty(0, np.uint32) for n in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(4), pa.int32()),
                    pa.array([h.tobytes() for h in hashes], pa.binary()),
                    pa.array([int(sent[need == n].sum()) for n in range(4)], pa.int64()),
                ],
                ["need", "hashes", "sent"],
            )

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch["hashes"].to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(packed, np.uint32).astype(np.int64))], ["hash"])


# The start of a range that says so.
_LACKING = -1
_SEGMENT = "key long, kind long, doc long, copy long, start long, runs long, text binary"


def _segments(repeated, differing, hot):
    """Rows without a key are byte ranges found already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            yield from made(part)

    def made(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(part["text"])
        found = Segments(data, offsets)
        found.only(flagged(repeated.value, found.key))
        split = flagged(hot.value, found.key)
        told = flagged(differing.value, found.key)[~split]
        found.split(split)
        # Split ones come last and need no text: equal keys are equal runs.
        told = np.append(told, np.zeros(len(found.key) - len(told), bool))
        row = np.searchsorted(offsets, found.start, "right") - 1
        doc, copy = (part[c].to_numpy()[row] for c in ("doc", "copy"))
        start = found.start - offsets[row]
        sent, later = _first_of_each(found.key, found.kind, doc, copy, start)
        for own, texts in ((sent[told[sent]], True), (sent[~told[sent]], False)):
            columns = [c[own] for c in (found.key.view(np.int64), found.kind.view(np.int64), doc, copy, start, found.runs)]
            at = zip(found.start[own].tolist(), (found.start + found.runs + LENGTH - 1)[own].tolist())
            text = pa.array([data[a:b].tobytes() for a, b in at], pa.binary()) if texts else pa.nulls(len(own), pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), text], names)
        done = _spans(doc[later], copy[later], start[later], found.runs[later])
        none = pa.nulls(done.num_rows, pa.int64())
        # Spread like any segment; the end takes the place of the number of runs.
        yield pa.RecordBatch.from_arrays(
            [done["copy"], none, done["doc"], done["copy"], done["start"], done["stop"], pa.nulls(done.num_rows, pa.binary())], names
        )

    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of the runs that start earlier elsewhere, for all segments of some anchors; a range from _LACKING on
    if segments differ that came without their bytes."""
    held = []
    for batch in batches:
        known = np.asarray(batch["kind"].is_null())
        yield batch.filter(pa.array(known)).select(["doc", "copy", "start", "runs"]).rename_columns(
            ["doc", "copy", "start", "stop"]
        )
        held.append(batch.filter(pa.array(~known)))
    rows = pa.Table.from_batches(held) if held else None
    if rows is None or not rows.num_rows:
        return
    key, kind, doc, copy, start, runs = (rows[c].to_numpy() for c in rows.schema.names[:-1])
    kept, later = _first_of_each(key, kind, doc, copy, start)
    yield _spans(doc[later], copy[later], start[later], runs[later])
    # Anchors with one kind of segment left have no other equal runs; ``kept`` is sorted by anchor.
    alone = np.ones(len(kept), bool)
    same = key[kept[1:]] == key[kept[:-1]]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    kept = kept[~alone]
    known = rows["text"].is_valid().to_numpy()[kept]
    if not known.all():
        yield _spans(*(np.array([n]) for n in (_NO_ID, 0, _LACKING, 0)))
        kept = kept[known]
    texts = rows["text"].take(pa.array(kept)).combine_chunks()
    data, bounds = text_bytes(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    new_anchor = np.flatnonzero(np.append(True, key[kept[1:]] != key[kept[:-1]])) if len(kept) else kept
    at = 0
    while at < len(kept):
        # Whole anchors up to MERGE_BYTES, one at least.
        later_anchors = new_anchor[new_anchor > at]
        ends = np.append(later_anchors, len(kept))
        stop = int(ends[max(0, np.searchsorted(bounds[ends], bounds[at] + MERGE_BYTES, "right") - 1)])
        text, offset, block = repeated_runs(data, bounds[at : stop + 1])
        own = kept[at:stop][text]
        place = start[own] + offset
        order = np.lexsort((place, doc[own], block))
        fresh = np.append(True, block[order][1:] != block[order][:-1]) if len(order) else order.astype(bool)
        leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        again = order[(doc[own[order]] != doc[own[leader]]) | (place[order] != place[leader])]
        yield _spans(doc[own[again]], copy[own[again]], place[again], np.ones(len(again), np.int64))
        at = stop


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, copy, ranges) of the texts that have byte ranges to remove: structs of start and stop, as they were
    found, they may overlap. Runs jobs."""
    spark, texts = docs.sparkSession, _texts(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = checkpointed(
        texts.select("text")
        .mapInArrow(_count_segments(partitions), "place int, numbers binary")
        .repartitionById(partitions, "place")
        .mapInArrow(_add_up(HOT), "need int, hashes binary, sent long")
    )
    known = anchors.groupBy("need").agg((F.sum(F.octet_length("hashes")) / 4).cast("long"), F.sum("sent")).collect()
    count, sent = ([{r[0]: r[i] for r in known}.get(n, 0) for n in range(4)] for i in (1, 2))

    def flags(least: int):
        hashes = anchors.filter(F.col("need") >= least).mapInArrow(_unpacked, "hash long")
        return spark.sparkContext.broadcast(bitmap_of(hashes, sum(count[least:])))

    repeated, some, many = map(flags, (_EQUAL, _DIFFER, _MANY))
    # A segment has its runs' starts, 32 on the average, and the bytes of the last run.
    text, runs = LENGTH + _WINDOW // 2, _WINDOW // 2
    wrong = sent[_ONE] * sum(count) // (8 * len(repeated.value))
    rows = min(wrong, sent[_ONE]) + sum(sent[_EQUAL:_MANY]) + runs * sent[_MANY]
    wanted = max(partitions, (ROW_BYTES * rows + text * sent[_DIFFER]) // PARTITION_BYTES + 1)

    def ranges(differ) -> DataFrame:
        found = texts.mapInArrow(_segments(repeated, differ, many), _SEGMENT).repartition(wanted, "key")
        spans = found.mapInArrow(_repeats, "doc long, copy long, start long, stop long")
        return checkpointed(spans.groupBy("doc", "copy").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")))

    lacking = F.exists("ranges", lambda r: r["start"] == _LACKING)
    made = ranges(some)
    if not made.filter(lacking).isEmpty():
        # Different segments agreed in the bits that were counted, which hardly ever happens.
        made = ranges(spark.sparkContext.broadcast(np.full(8, 255, np.uint8)))
    return made.filter(~lacking)


_DONE = "doc long, n_bytes long, removed array<struct<start: long, length: long>>, kept binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in batches_of(whole, "text", 4 * STEP_BYTES):
            yield _without(part)


def _rows_hash(batch: pa.RecordBatch) -> np.ndarray:
    doc, copy = (batch[c].to_numpy().view(np.uint64) for c in ("doc", "copy"))
    return mixed(mixed(doc * _MULTIPLIER) + copy)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_rows_hash(batch).view(np.int64))], ["hash"])


def _with_ranges(shared):
    """The texts that may have ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(flagged(shared.value, _rows_hash(batch))))

    return run


def _whole_texts(shared):
    """The results of all other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(~flagged(shared.value, _rows_hash(batch))))
            none = pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, ["start", "length"])
            removed = pa.ListArray.from_arrays(pa.array(np.zeros(rows.num_rows + 1, np.int32)), none)
            sizes = pc.binary_length(rows["text"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([rows["doc"], sizes, removed, rows["text"]], ["doc", "n_bytes", "removed", "kept"])

    return run


def _without(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(part["text"])
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    ranges = part["ranges"]
    counts = np.asarray(ranges.value_lengths().fill_null(0))
    flat = ranges.flatten()
    base = np.repeat(offsets[:-1], counts)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, base + pc.struct_field(flat, "start").to_numpy(), 1)
    np.add.at(change, base + pc.struct_field(flat, "stop").to_numpy(), -1)
    gone = np.cumsum(change[:-1]) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = gone[inner]
    closes = gone.copy()
    closes[:-1] &= ~gone[1:]
    closes[inner - 1] = gone[inner - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    edges = np.searchsorted(starts, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    removed = pa.StructArray.from_arrays(
        [pa.array(starts - offsets[owner]), pa.array(stops - starts)], ["start", "length"]
    )
    kept_before = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(kept_before.astype(np.int64)), pa.py_buffer(data[~gone])]
    )
    return pa.RecordBatch.from_arrays(
        [
            part["doc"],
            pa.array(np.diff(offsets)),
            pa.ListArray.from_arrays(pa.array(edges, pa.int32()), removed),
            kept.cast(pa.binary()),
        ],
        ["doc", "n_bytes", "removed", "kept"],
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every document: the byte ranges that go, each as long as
    possible, as structs of start and length, and the bytes that stay. Runs jobs.

    The ranges of a text, no more than it has bytes, come gathered and checkpointed, so the join with the texts is
    between plain tables and AQE can split a text that many rows repeat. Texts without ranges need no
    join; a bitmap of at most BITS bits tells most of them.
    """
    ranges = repeated_ranges(docs)
    texts = _texts(docs)
    hashes = ranges.select("doc", "copy").mapInArrow(_hash_rows, "hash long")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(hashes, ranges.count()))
    whole = texts.mapInArrow(_whole_texts(shared), _DONE)
    some = texts.mapInArrow(_with_ranges(shared), texts.schema).join(ranges, ["doc", "copy"], "left")
    made = whole.unionByName(some.select("doc", "text", "ranges").mapInArrow(_removed, _DONE))
    return made.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "removed", "kept")
