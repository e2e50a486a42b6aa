import hashlib

import numpy as np
import pytest
import regex
from edges import corpus, frame
from pyspark.sql import functions as F

from studylattice.llm import infill

UNITS = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["<P> inside", "a <M> b", "<S", " \t", "\n", " lead", "trail ", "a b c", "\x1c x", "日本 語　x ", "<< P> <S >", "é\n\né "]


def plain(doc_id, text):
    """The transformation said directly."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_the_plain_transformation_and_is_restored(spark):
    rows = corpus() + [(9000 + 40 * i + k, t) for i, t in enumerate(ODD) for k in range(40)]
    made = infill.fill_in_middle(frame(spark, rows))
    back = infill.restored(F.col("output"), F.col("form"))
    found = [tuple(r) for r in made.withColumn("back", back).collect()]
    assert sorted((r[:-1] for r in found), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert sorted(r[-1] for r in found) == sorted(t or "" for _, t in rows)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.fill_in_middle(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_ranks_equal_counts(size):
    symbols = np.random.default_rng(size).integers(0, 6, size).astype(np.uint8)
    matrix = infill.WaveletMatrix(symbols, 3)
    ends = np.arange(size + 1)
    for symbol in range(6):
        want = np.concatenate([[0], np.cumsum(symbols == symbol)])
        assert (matrix.rank(symbol, ends) == want).all()
