import numpy as np
import pytest
from edges import corpus, frame

from studylattice.llm import near_dedup
from studylattice.llm.components import UnionFind, components


def shingles(text, size):
    found = (text or "").encode().lower().split()
    if not found:
        return set()
    if len(found) < size:
        return {tuple(found)}
    return set(zip(*[found[i:] for i in range(size)]))


def expected(rows, size):
    sets, groups = {}, UnionFind()
    for doc_id, text in rows:
        if doc_id is not None:
            sets[doc_id] = shingles(text, size)
            groups.find(doc_id)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(spark, size):
    rows = corpus()
    got = near_dedup.near_duplicates(frame(spark, rows), words=size).collect()
    assert len(got) == len(rows)
    want = expected(rows, size)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and not row.kept
        else:
            assert (row.n_shingles, row.component_id) == want[row.doc_id]
            assert row.kept == (row.component_id == row.doc_id)


def test_strays_of_a_large_group_find_each_other(spark):
    """Two documents far from a group's leader are linked with each other only."""
    base = [f"w{i}" for i in range(100)]
    stray = [w if i % 3 else f"s{i}" for i, w in enumerate(base)]
    rows = [(1, " ".join(base))] + [(10 + i, " ".join(base[:-1] + [f"e{i}"])) for i in range(40)]
    rows += [(100, " ".join(stray)), (101, " ".join(stray[:-1] + ["end"]))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), words=2).collect()}
    assert got[100] == got[101] == 100
    assert all(got[10 + i] == 1 for i in range(40))


def test_empty_table_and_rows_kept(spark):
    assert near_dedup.near_duplicates(frame(spark, []), words=2).count() == 0
    docs = frame(spark, corpus())
    left = near_dedup.without_duplicates(docs, words=2)
    assert left.columns == docs.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, c in expected(corpus(), 2).values()})


CLASHING_IDS = [
    [(5, "A"), (5, "B"), (3, "b")],
    [(5, "A"), (5, "B"), (2, "B")],
    [(5, "A"), (5, "B"), (5, "b"), (7, "a")],
    [(5, "A"), (5, "A"), (5, None), (5, ""), (1, "a"), (None, "A")],
    [(5, "A"), (6, "a"), (5, "B"), (6, "b"), (6, "A")],
]


def clashing(rows):
    """Texts A and B, and near copies a and b of them, under the given ids."""
    base = {"A": [f"x{i}" for i in range(120)], "B": [f"y{i}" for i in range(120)]}
    base |= {k.lower(): words[:-1] + ["end"] for k, words in base.items()}
    return [(i, " ".join(base[t]) if t else t) for i, t in rows]


@pytest.mark.parametrize("rows", CLASHING_IDS)
def test_rows_with_one_id_are_documents_of_their_own(spark, rows):
    """Brute force over (id, set) pairs, for groups and for the rows that stay."""
    rows = clashing(rows)
    nodes = sorted({(i, tuple(sorted(shingles(t, 2)))) for i, t in rows if i is not None})
    groups = UnionFind()
    for x, (_, a) in enumerate(nodes):
        groups.find(x)
        for y, (_, b) in enumerate(nodes[:x]):
            shared = len(set(a) & set(b))
            if shared and 100 * shared >= 80 * (len(a) + len(b) - shared):
                groups.join(x, y)
    members = {}
    for x, (i, _) in enumerate(nodes):
        members.setdefault(groups.find(x), []).append(i)
    lowest = {node: min(members[groups.find(x)]) for x, node in enumerate(nodes)}
    docs = frame(spark, rows)
    want = [(i, None if i is None else lowest[i, tuple(sorted(shingles(t, 2)))]) for i, t in rows]
    got = [(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, words=2).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clash = docs.withColumnsRenamed({"score": "text_hash", "kept": "_high0"})
    left = near_dedup.without_duplicates(clash, words=2)
    assert left.columns == clash.columns
    stay = {(i, tuple(sorted(shingles(t, 2)))) for i, t in rows if i is not None and lowest[i, tuple(sorted(shingles(t, 2)))] == i}
    found = [(r.doc_id, tuple(sorted(shingles(r.text, 2)))) for r in left.collect() if r.doc_id is not None]
    assert len(found) == len(set(found)) and set(found) == stay
    assert left.filter("doc_id is null").count() == sum(i is None for i, _ in rows)


def plain_superminhash(elements, size):
    """One element and one step after another."""
    lowest = [None] * size
    for element in elements:
        order = list(range(size))
        for j in range(size):
            draw = near_dedup.mixed(np.array([element], np.uint64) + near_dedup._LEVEL_STEP * np.array([j + 1], np.uint64))
            high, low = int(draw[0]) >> 32, int(draw[0]) & 0xFFFFFFFF
            k = j + (high * (size - j) >> 32)
            order[j], order[k] = order[k], order[j]
            value = j << 32 | low
            if lowest[order[j]] is None or value < lowest[order[j]]:
                lowest[order[j]] = value
    return lowest


@pytest.mark.parametrize("count", [1, 3, 20, 200])
def test_signatures_equal_the_plain_algorithm(count):
    elements = near_dedup.mixed(np.arange(1, count + 1, dtype=np.uint64))
    bounds = np.array([0, count, count])
    got = near_dedup.superminhash(elements, bounds, 16)
    assert got[0].tolist() == plain_superminhash(elements, 16)


def test_signatures_estimate_similarity():
    a = near_dedup.mixed(np.arange(0, 900, dtype=np.uint64))
    b = near_dedup.mixed(np.arange(100, 1000, dtype=np.uint64))
    both = near_dedup.superminhash(np.concatenate([a, b]), np.array([0, 900, 1800]), 512)
    assert abs((both[0] == both[1]).mean() - 0.8) < 0.06


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long").repartition(5)
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0
