import numpy as np
import pytest

from studylattice.llm import embed_dedup
from studylattice.llm.components import UnionFind

SCHEMA = "vec_id long, embedding array<float>, label int, links int, rep string, place int"


def vectors():
    random = np.random.default_rng(3)
    rows = []
    for i in range(150):
        rows.append((i, random.normal(size=16).astype(np.float32), int(i % 3)))
    centre = random.normal(size=16)
    for i in range(60):  # copies at cosines around the threshold
        near = centre + random.normal(size=16) * (0.05 + 0.01 * i)
        rows.append((200 + i, near.astype(np.float32), 1))
    rows += [(300 + i, rows[5][1], 2) for i in range(4)]
    made = [(i, [float(x) for x in v], label) for i, v, label in rows]
    made += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, [float("nan")] * 16, 1)]
    made += [(405, [float("inf")] + [1.0] * 15, 1), (406, made[5][1], None), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1)]
    made += [(None, made[5][1], 2), (5, made[5][1], 2), (409, [-0.0, 1.0], 2), (410, [0.0, 1.0], 2)]
    return made


def expected(rows):
    usable = []
    for at, (vec_id, v, label) in enumerate(rows):
        good = vec_id is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)
        if good and any(v):
            usable.append((at, np.array(v, np.float32).astype(float)))
    counts, groups = [0] * len(rows), UnionFind()
    for i, (a, x) in enumerate(usable):
        for b, y in usable[:i]:
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                counts[a] += 1
                counts[b] += 1
                groups.join(rows[a][0], rows[b][0])
    return [(r[0], n, None if r[0] is None else groups.find(r[0])) for r, n in zip(rows, counts)]


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK_VECTORS", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(3)
    got = embed_dedup.linked_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted(expected(rows), key=repr)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert embed_dedup.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bar_is_calibrated():
    bar = embed_dedup.least_collisions(48)
    random = np.random.default_rng(0)
    collisions = (np.abs(random.normal(size=(200_000, 48))) < 1).sum(1)
    assert (collisions < bar).mean() <= 1e-5
    # Unrelated vectors differ by 3.8 times as much, and mostly stay below.
    assert ((np.abs(random.normal(size=(20_000, 48)) * 3.78) < 1).sum(1) >= bar).mean() < 0.05
