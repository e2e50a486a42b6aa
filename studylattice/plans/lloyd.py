"""k-means for many models at once: every step is one aggregation over (model, cluster).

Points are settled to whole millionths and equal points are one weighted place, so all sums are of whole
numbers: neither the partitioning nor a lost executor can change a centre, and a run repeats bit by bit. A step
takes the centres of all unfinished models to the rows, adds up in numpy what a task has, and
brings back a row for each (model, cluster): 44 for each restart of 2 to 9 clusters, whatever the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylattice.session import package_for_workers

# Millionths of a unit, and the squared shift of all centres of a model, in squared units, that ends it.
SCALE = 1_000_000
TOLERANCE = 1e-4
MOST_STEPS = 25


@dataclass
class Model:
    """Centres of one fit, in millionths."""

    k: int
    restart: int
    centres: list[list[float]]
    done: bool = False
    # Of the rows nearest to each centre: how many, their mean, and the mean squared distance from that.
    sizes: list[int] = field(default_factory=list)
    means: list[list[float]] = field(default_factory=list)
    spreads: list[float] = field(default_factory=list)
    cost: int = 0  # sum of squared distances from the centres

    @property
    def key(self) -> tuple[int, int]:
        return self.k, self.restart


def settle(value: Column) -> Column:
    """A feature in whole millionths."""
    return F.rint(value * SCALE).cast("long")


def places(points: DataFrame) -> DataFrame:
    """(p, w): the distinct points ``p``, arrays of whole numbers, and how many rows have each."""
    return points.groupBy("p").agg(F.count("*").alias("w"))


def _starts(rows: DataFrame, ks: list[int], restarts: int, seed: int) -> list[Model]:
    """Models whose first centres are the first places in an order by a hash, one order a restart. Numbers
    of clusters beyond the number of places have no model."""
    text = F.concat_ws(":", F.lit(seed), F.col("restart"), F.col("p").cast("array<string>"))
    drawn = rows.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))).withColumn(
        "place", F.row_number().over(Window.partitionBy("restart").orderBy(F.md5(text), "p"))
    )
    first: dict[int, list[list[float]]] = {}
    for restart, _, point in sorted(drawn.filter(F.col("place") <= max(ks)).select("restart", "place", "p").collect()):
        first.setdefault(restart, []).append([float(x) for x in point])
    return [Model(k, r, at[:k]) for r, at in sorted(first.items()) for k in ks if k <= len(at)]


def squared(p: Column, centre: Column) -> Column:
    """Squared distance of a place from a centre, added up in the order of the features."""
    parts = F.zip_with(p, centre, lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)


def nearest(p: Column, centres: Column) -> Column:
    """(distance, cluster) of the nearest centre, of equally near ones the first."""
    numbered = F.transform(centres, lambda c, i: F.struct(squared(p, c).alias("distance"), i.alias("cluster")))
    return F.array_min(numbered)


_HALF = 1 << 20  # costs are summed in two parts that no number of rows of a task overflows


def _sums(models: list[Model], features: int):
    """Weight, cost and sums of every cluster of every model over the rows of a task."""
    centres = np.array([c for m in models for c in m.centres])
    bounds = np.cumsum([0, *(m.k for m in models)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((3 + features, len(centres)), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                n, w = batch.num_rows, batch["w"].to_numpy()
                points = batch["p"].flatten().to_numpy().reshape(n, features)
                away = np.zeros((n, len(centres)))
                for i in range(features):
                    gap = points[:, i, None] - centres[None, :, i]
                    away += gap * gap
                for low, high in zip(bounds[:-1], bounds[1:]):
                    near = away[:, low:high].argmin(1)
                    cost = away[np.arange(n), low + near].astype(np.int64)
                    for row, values in enumerate((w, w * (cost // _HALF), w * (cost % _HALF), *(points.T * w))):
                        np.add.at(found[row], low + near, values)
        used = np.flatnonzero(found[0])
        owner = np.searchsorted(bounds, used, "right") - 1
        model = [[models[i].k for i in owner], [models[i].restart for i in owner], (used - bounds[owner]).tolist()]
        columns = [*(pa.array(c, pa.int32()) for c in model), *(pa.array(row[used]) for row in found)]
        yield pa.RecordBatch.from_arrays(columns, [*_KEY, *_facts(features)])

    return run


_KEY = ["k", "restart", "cluster"]
_ROWS = 2048


def _facts(features: int) -> list[str]:
    return ["w", "high", "low", *(f"s{i}" for i in range(features))]


def _step(rows: DataFrame, models: list[Model], features: int) -> dict[tuple[int, int], dict[int, tuple]]:
    """One pass over the rows: weight, cost and mean of every cluster of every model."""
    schema = ", ".join([*(f"{c} int" for c in _KEY), *(f"{c} long" for c in _facts(features))])
    parts = rows.select("p", "w").mapInArrow(_sums(models, features), schema)
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    plain = [F.sum(c).alias(c) for c in _facts(features) if c not in ("high", "low")]
    found: dict[tuple[int, int], dict[int, tuple]] = {}
    for row in parts.groupBy(*_KEY).agg(*wide, *plain).collect():  # a row for each cluster of each model
        cost = int(row.high) * _HALF + int(row.low)
        mean = [row[f"s{i}"] / row.w for i in range(features)]
        found.setdefault((row.k, row.restart), {})[row.cluster] = (row.w, cost, mean)
    return found


def fit_all(rows: DataFrame, ks: Iterable[int], restarts: int, seed: int) -> list[Model]:
    """Every number of clusters in ``ks`` fitted from every restart, over kept ``places``. Runs a job for each
    step of the slowest model.

    A model ends when its centres move by TOLERANCE or less, or after MOST_STEPS. An empty cluster keeps
    its centre. Sizes, means and costs belong to the last centres.
    """
    package_for_workers(rows.sparkSession)
    models = _starts(rows, sorted(ks), restarts, seed)
    features = len(models[0].centres[0]) if models else 0
    for step in range(MOST_STEPS):
        moving = [m for m in models if not m.done]
        if not moving:
            break
        found = _step(rows, moving, features)
        for model in moving:
            clusters = found[model.key]
            moved = [clusters[c][2] if c in clusters else model.centres[c] for c in range(model.k)]
            shift = sum((a - b) ** 2 for new, old in zip(moved, model.centres) for a, b in zip(new, old))
            model.centres = moved
            model.done = shift <= TOLERANCE * SCALE**2
    final = _step(rows, models, features) if models else {}
    for model in models:
        for c, centre in enumerate(model.centres):
            size, cost, mean = final[model.key].get(c, (0, 0, centre))
            off = sum((a - b) ** 2 for a, b in zip(mean, centre))
            model.sizes.append(size)
            model.means.append(mean)
            model.spreads.append(max(0.0, cost / size - off) if size else 0.0)
            model.cost += cost
    return models


def best_of_each(models: Iterable[Model]) -> dict[int, Model]:
    """For every number of clusters the cheapest fit, of equally cheap ones the first."""
    best: dict[int, Model] = {}
    for model in sorted(models, key=lambda m: (m.k, m.cost, m.restart)):
        best.setdefault(model.k, model)
    return best


def silhouettes(rows: DataFrame, models: Iterable[Model]) -> dict[int, float]:
    """Mean silhouette by squared distance of every model with two clusters or more, by its number of
    clusters, from one pass. A place's mean squared distance from a cluster is that from the cluster's mean
    plus the cluster's spread, so no pairs are needed. Runs a job."""
    judged = [m for m in models if sum(size > 0 for size in m.sizes) > 1]
    if not judged:
        return {}
    text = json.dumps(
        [
            {
                "k": m.k,
                "clusters": [
                    {"centre": m.centres[c], "mean": m.means[c], "spread": m.spreads[c], "size": m.sizes[c]}
                    for c in range(m.k)
                ],
            }
            for m in judged
        ]
    )
    cluster = "struct<centre: array<double>, mean: array<double>, spread: double, size: long>"
    literal = F.from_json(F.lit(text), f"array<struct<k: int, clusters: array<{cluster}>>>")
    p, own = F.col("p"), F.col("own")
    placed = rows.select(p, "w", F.explode(literal).alias("m")).select(
        p, "w", "m.k", "m.clusters", nearest(p, F.col("m.clusters.centre"))["cluster"].alias("own")
    )
    apart = F.transform("clusters", lambda c: squared(p, c["mean"]) + c["spread"])
    others = F.filter(
        F.transform("apart", lambda d, i: F.when((i != own) & (F.get("clusters", i)["size"] > 0), d)),
        lambda d: d.isNotNull(),
    )
    size = F.get("clusters", own)["size"].cast("double")
    inside, outside = F.get("apart", own) * size / (size - 1), F.array_min(others)
    widest = F.greatest(inside, outside)
    value = F.when((size > 1) & (widest > 0), (outside - inside) / widest).otherwise(0.0)
    means = (
        placed.withColumn("apart", apart)
        .select("k", "w", value.alias("value"))
        .groupBy("k")
        .agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"))
    )
    return {r.k: r["mean"] for r in means.collect()}  # a row for each model
