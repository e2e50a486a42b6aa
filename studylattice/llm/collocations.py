"""Phrases that occur together more often than their parts: exact counts from a HAT-trie.

A word's id is a hash of its language and its bytes; that no two words share an id is checked over all words,
and another seed is taken if they do. Tasks count id sequences in a trie of bounded size and pass
its subtrees on as sorted runs, which are merged per prefix partition: a phrase goes by its first
id, and by all of its ids where that id is one of the commonest, so no partition holds more than its
share. A phrase can only be frequent if all of its words and pairs are, which a bitmap of at most BITS
bits tells: one for words before pairs are counted, one for pairs before longer phrases are. A bit set by another
phrase costs work but no exactness, so the bitmap's bound is no bound on the result.

A null text counts as empty, a null language as ``und``, rows count as often as they occur, ids and
other columns are not looked at, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylattice.llm.common import STEP_BYTES, batches_of, bitmap_of, flagged, mixed, text_bytes, word_runs
from studylattice.llm.hat_trie import HatTrie, folded
from studylattice.session import checkpointed

# The least count of a phrase, its longest form, phrases in each language's report,
# and the share in percent at which a longer phrase makes a shorter one needless.
LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
SCALE = 2_000_000
SPREAD = 1 << 12  # prefix partitions of a common first word

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang"), F.lit("und")).cast("string").alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


class Words:
    """The words of some texts: ids, places in ``data``, and the piece and text each lies in."""

    def __init__(self, part: pa.RecordBatch, seed: int) -> None:
        self.data, offsets = text_bytes(part["text"])
        hashes, self.starts, self.ends = word_runs(self.data, offsets, _SEPARATORS)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        langs = part["lang"].dictionary_encode()
        marks = np.array([xxhash.xxh3_64_intdigest(v, seed) for v in langs.dictionary.to_pylist()], np.uint64)
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[self.text]
        self.langs = langs.dictionary
        self.ids = mixed(hashes + marks[self.lang]) if len(hashes) else hashes
        # 0 stands for no word.
        self.ids[self.ids == 0] = 1
        first, last = int(offsets[0]), int(offsets[-1])
        breaks = np.cumsum(_BREAKS[self.data[first:last]], dtype=np.int64)
        # Grows wherever a piece or a text ends.
        self.piece = (breaks[self.starts - first] if len(self.starts) else self.starts) + self.text


def _word_counts(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in batches_of(whole, "text", 8 * STEP_BYTES):
                words = Words(part, seed)
                ids, first, counts = np.unique(words.ids, return_index=True, return_counts=True)
                lower = _LOWER[words.data].tobytes()
                spans = zip(words.starts[first].tolist(), words.ends[first].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        words.langs.take(pa.array(words.lang[first])),
                        pa.array([lower[a:b] for a, b in spans], pa.binary()),
                        pa.array(ids.view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    ["lang", "word", "id", "n"],
                )

    return run


def word_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, id, n) of every word, with unique ids, and the seed of the ids. Runs jobs."""
    seed = 0
    while True:
        counted = _rows(docs).mapInArrow(_word_counts(seed), "lang string, word binary, id long, n long")
        words = checkpointed(counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")))
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
        seed += 1


def _names(size: int) -> list[str]:
    return [f"w{i}" for i in range(1, size + 1)]


def _sequences(sizes: range, known_size: int, shared, seed: int):
    """Counts of the phrases of some sizes, padded with 0, all of whose parts of ``known_size`` words are flagged."""
    width = sizes[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, trie = shared.value, HatTrie(width)
        names = [*_names(width), "n"]

        def out(runs) -> Iterator[pa.RecordBatch]:
            for rows, counts in runs:
                columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in rows.T]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names)

        for whole in batches:
            for part in batches_of(whole, "text", STEP_BYTES):
                words = Words(part, seed)
                n = len(words.ids)
                if n < sizes[0]:
                    continue
                parts = np.column_stack([words.ids[i : n - known_size + 1 + i] for i in range(known_size)])
                known = flagged(flags, folded(parts))
                found = []
                for size in sizes:
                    usable = words.piece[: max(0, n - size + 1)] == words.piece[size - 1 :]
                    for i in range(size - known_size + 1):
                        usable &= known[i : i + len(usable)]
                    at = np.flatnonzero(usable)
                    rows = np.zeros((len(at), width), np.uint64)
                    for i in range(size):
                        rows[:, i] = words.ids[at + i]
                    found.append(rows)
                rows = np.concatenate(found)
                yield from out(trie.add(rows, np.ones(len(rows), np.int64)))
        yield from out(trie.runs())

    return run


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.column_stack([c.to_numpy().view(np.uint64) for c in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array(folded(rows).view(np.int64))], ["hash"])


def phrase_counts(
    docs: DataFrame, words: DataFrame, seed: int, least: int = LEAST, longest: int = LONGEST
) -> DataFrame:
    """(ids, n) of every run of 1 to ``longest`` words inside a piece that occurs ``least`` times or
    more. Runs jobs."""
    spark = docs.sparkSession
    frequent = words.filter(F.col("n") >= least).select(F.col("id").alias("w1"), "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    # At most 8 ids for each partition can have so large a share.
    share = total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    common = [r.w1 for r in frequent.filter(F.col("n") >= share).collect()]
    found = [frequent]
    # Pairs by their words, then all longer phrases by their pairs in one more pass over the texts.
    for known_size, sizes in ((1, range(2, 3)), (2, range(3, longest + 1))):
        if longest < sizes[0]:
            break
        names = _names(sizes[-1])
        hashes = frequent.select(*_names(known_size)).mapInArrow(_hash_rows, "hash long")
        shared = spark.sparkContext.broadcast(bitmap_of(hashes, frequent.count()))
        runs = _rows(docs).mapInArrow(
            _sequences(sizes, known_size, shared, seed), ", ".join(f"{name} long" for name in [*names, "n"])
        )
        # Phrases that begin with a common id are dealt over SPREAD neighbours of it.
        spread = F.xxhash64(*names).bitwiseAND(SPREAD - 1)
        prefix = F.when(F.col("w1").isin(common), F.col("w1").bitwiseXOR(spread)).otherwise(F.col("w1"))
        merged = (
            runs.withColumn("prefix", prefix)
            .repartition("prefix")
            .groupBy("prefix", *names)
            .agg(F.sum("n").alias("n"))
        )
        frequent = checkpointed(merged.filter(F.col("n") >= least).drop("prefix"))
        found.append(frequent)
    phrases = [f.select(F.filter(F.array(*f.columns[:-1]), lambda i: i != 0).alias("ids"), "n") for f in found]
    return reduce(DataFrame.unionByName, phrases)


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def scored_candidates(phrases: DataFrame) -> DataFrame:
    """(ids, a, l, r, score) of every phrase of two words or more: the lowest-scoring cut, and of
    equal ones the one after the fewest words. Products are taken in decimals, which no count overflows.

    Cuts meet the counts of their parts in two joins; a part that many phrases share is split by AQE,
    as both sides are plain tables.
    """
    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1))
    cuts = phrases.filter(F.size("ids") > 1).select("ids", F.col("n").alias("a"), cut.alias("k"))
    cuts = cuts.withColumns(
        {"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, F.size("ids"))}
    )
    heads = phrases.select(F.col("ids").alias("head"), F.col("n").alias("l"))
    tails = phrases.select(F.col("ids").alias("tail"), F.col("n").alias("r"))
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    return (
        cuts.join(heads, "head")
        .join(tails, "tail")
        .withColumn("score", score)
        .groupBy("ids")
        .agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
        .select("ids", "best.a", "best.l", "best.r", "best.score")
    )


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates without a longer one around them that occurs ``covered`` percent as often."""
    size = F.size("ids")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("ids", at, n)),
        )
    )
    longer = (
        candidates.filter(size > 2)
        .select(F.explode(spans).alias("ids"), F.col("a").alias("around"))
        .groupBy("ids")
        .agg(F.max("around").alias("around"))
    )
    needless = _exact("around") * 100 >= _exact("a") * covered
    joined = candidates.join(longer, "ids", "left")
    return joined.filter(~F.coalesce(needless, F.lit(False))).drop("around")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language by score,
    count and phrase. Runs jobs.

    The limit per language is applied before the shuffle, and words are looked up for the rows that can
    still be in the report only.
    """
    words, seed = word_table(docs)
    candidates = checkpointed(scored_candidates(phrase_counts(docs, words, seed, least, longest)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= least)
    first = frequent.select(F.col("id").alias("first"), "lang")
    kept = uncovered(candidates).withColumn("first", F.get("ids", F.lit(0))).join(first, "first").drop("first")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    near = checkpointed(kept.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"))
    texts = (
        near.select("ids", F.posexplode("ids").alias("at", "id"))
        .join(frequent.select("id", F.col("word").cast("string").alias("word")), "id")
        .groupBy("ids")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
        .select("ids", F.array_join("parts.word", " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (
        near.join(texts, "ids")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
