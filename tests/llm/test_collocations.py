import random
import re
from collections import Counter

import numpy as np
import pytest
from edges import CLASHING, DOCS, corpus

from studylattice.llm import collocations
from studylattice.llm.hat_trie import HatTrie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[ \t]+", piece) if w]


def plain(rows, least, top):
    """The report said directly, one language after the other."""
    out = []
    for lang in {lang or "und" for _, _, lang in rows}:
        f, n = Counter(), 0
        for _, text, own in rows:
            if (own or "und") != lang:
                continue
            for w in pieces(text):
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        found = {}
        for phrase, a in f.items():
            if len(phrase) > 1 and a >= least:
                cuts = [(2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                found[phrase] = (a, f[phrase[:k]], f[phrase[k:]], score)
        covered = {
            long[i : i + k]
            for long in found
            for k in range(2, len(long))
            for i in range(len(long) - k + 1)
            if 100 * found[long][0] >= 80 * f[long[i : i + k]]
        }
        kept = [(-v[3], -v[0], " ".join(p).encode(), v) for p, v in found.items() if p not in covered]
        for rank, (_, _, phrase, (a, l, r, score)) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n, score))
    return sorted(out)


def frame(spark, rows):
    full = [(i, t, lang, "s", 0, *([None] * 10)) for i, t, lang in rows]
    return spark.createDataFrame(full, f"{DOCS}, {CLASHING}").repartition(3)


def spoken(seed, count):
    """Sentences over few words, so that phrases repeat."""
    made = random.Random(seed)
    vocabulary = ["the", "of", "Big", "apple", "new", "york", "city", "é", "x"]
    return "".join(made.choice(vocabulary) + made.choice([" "] * 12 + [". ", ", ", "\n", " \t", "  "]) for _ in range(count))


def test_report_equals_the_plain_one(spark):
    rows = [(i, spoken(i, 120), ["en", "de", None, "und"][i % 4]) for i in range(40)]
    rows += [(i, t, "fr") for i, t in corpus()] + [(None, None, None), (3, spoken(3, 120), "en")]
    rows += [(900, "same words " * 60, "it"), (901, "one", "it"), (902, "", "xx")]
    found = collocations.collocations(frame(spark, rows), least=5, top=60)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 5, 60)


def test_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_report_does_not_lean_on_the_bitmap(spark, monkeypatch):
    """A bitmap too small for the phrases lets everything through and changes nothing."""
    rows = [(i, spoken(i, 80), "en") for i in range(20)]
    want = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=4).collect())
    monkeypatch.setattr(collocations, "bitmap_of", lambda hashes, rows: np.full(8, 255, np.uint8))
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=4).collect()) == want


@pytest.mark.parametrize("width", [1, 2, 4])
@pytest.mark.parametrize("spread", [3, 400, 2**64 - 1])
def test_trie_counts(width, spread):
    """Small limits, so that containers burst and subtrees leave; runs are sorted."""
    made = np.random.default_rng(width)
    trie, want, got = HatTrie(width, full=300, burst=20), Counter(), Counter()

    def take(runs):
        for rows, counts in runs:
            keys = [tuple(r) for r in rows.tolist()]
            assert keys == sorted(set(keys))
            got.update(dict(zip(keys, counts.tolist())))

    for _ in range(12):
        rows = made.integers(1, spread, (200, width), np.uint64, endpoint=True)
        rows[::3, 0] = spread
        want.update(tuple(r) for r in rows.tolist())
        take(trie.add(rows, np.ones(len(rows), np.int64)))
        assert trie.root.size <= 300 + 200
    take(trie.runs())
    assert got == want
