"""K-means whose result depends on the rows alone, not on how they are dealt out.

Features are put on a grid of whole numbers, so sums are exact in any order and centres are exact
fractions. Starting centres are drawn by k-means++ as an exponential race: each entity runs a time
that follows from the hash of its key, divided by its weight, and the fastest wins; so a draw is a
minimum over rows. All restarts go through the data together, one job a step; what comes back is one
row per restart and cluster.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import frexp, isqrt

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions that run in tasks travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of the largest coordinate on the grid.
GRID_BITS = 44
#: Rows summed up at a time, so that sums of coordinates stay within 64 bits.
BATCH_ROWS = 1 << 16


@dataclass(frozen=True)
class Fit:
    """``centres``: k x axes, on the grid; ``cost``: exact sum of squared distances, on the grid."""

    centres: np.ndarray
    cost: Fraction
    iterations: int
    converged: bool


def on_grid(rows: DataFrame, key: str, values: str, normalize: bool) -> tuple[DataFrame, float]:
    """``rows`` with hash and point (array of bigint), and the length of a grid step. ``normalize``
    gives every axis mean 0 and deviation 1 (constant axes: 0), by exact sums."""
    largest = rows.agg(F.max(F.array_max(F.transform(values, lambda v: F.abs(v))))).first()[0] or 1.0
    step = 2.0 ** (frexp(largest)[1] - GRID_BITS)
    raw = rows.withColumns({"hash": F.xxhash64(F.col(key).cast("string")), "point": _rounded(values, step)})
    if not normalize:
        return raw, step
    axes = raw.select(F.posexplode("point").alias("axis", "x")).withColumn("x", F.col("x").cast("decimal(19,0)"))
    moments = axes.groupBy("axis").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"),
        F.sum((F.col("x") * F.col("x")).cast("decimal(38,0)")).alias("squares"),
    ).collect()  # one row per axis
    mean, scale = [0.0] * len(moments), [0.0] * len(moments)
    for row in moments:
        spread = row.n * int(row.squares) - int(row.total) ** 2  # n^2 times the variance
        mean[row.axis] = int(row.total) / row.n
        # 30 more bits, so that the root of a whole number is as good as a double.
        scale[row.axis] = row.n * 2.0**30 / isqrt(spread << 60) if spread else 0.0
    n = max(row.n for row in moments)
    centred = F.zip_with(
        F.zip_with("point", F.lit(mean), lambda x, m: x - m), F.lit(scale), lambda x, s: x * s)
    step = 2.0 ** (frexp(n**0.5)[1] - GRID_BITS)  # no coordinate is larger than the root of n
    return raw.withColumn("point", centred).withColumn("point", _rounded("point", step)), step


def _rounded(values: str, step: float):
    return F.transform(values, lambda v: F.round(v / F.lit(step)).cast("long"))


def fit_all(points: DataFrame, n_clusters: int, seeds: list[int], max_iterations: int) -> list[Fit]:
    """A fit for each seed. ``points`` (hash, point) should be at hand, as it is read once a step."""
    centres = _start(points, n_clusters, seeds)
    state = [tuple(map(tuple, c)) for c in centres]  # exact: whole numbers, then fractions
    done, used = [False] * len(seeds), [0] * len(seeds)
    x = F.col("x").cast("decimal(19,0)")
    squares = int(points.select(F.explode("point").alias("x")).agg(
        F.sum((x * x).cast("decimal(38,0)"))).first()[0])
    cost: list[Fraction] = [Fraction(0)] * len(seeds)
    while not all(done):
        open_fits = [r for r in range(len(seeds)) if not done[r]]
        sums = _assigned_sums(points, {r: _floats(state[r]) for r in open_fits})
        for r in open_fits:
            moved = tuple(
                tuple(Fraction(s, n) for s in total) if n else old
                for old, (n, total) in zip(state[r], (sums[r, c] for c in range(n_clusters)), strict=True)
            )
            # The cost of this assignment to its own means.
            cost[r] = squares - sum(
                Fraction(sum(s * s for s in total), n)
                for n, total in (sums[r, c] for c in range(n_clusters)) if n)
            used[r] += 1
            settled = moved == state[r]
            state[r] = moved
            done[r] = settled or used[r] >= max_iterations
            if done[r]:
                used[r] = used[r] if settled else max_iterations + 1
    return [
        Fit(_floats(state[r]), cost[r], min(used[r], max_iterations), used[r] <= max_iterations)
        for r in range(len(seeds))
    ]


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` with ``prediction``, the nearest centre (the first of equally near ones)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.argmin(_distances(_matrix(batch), centres), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "prediction"])

    return points.mapInArrow(run, type(points.schema)([*points.schema.fields]).add("prediction", "integer"))


def _floats(centres) -> np.ndarray:
    return np.array([[float(v) for v in c] for c in centres])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("point")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared, axis by axis: the same rounding for a row wherever it stands."""
    out = np.zeros((len(x), len(centres)))
    for axis in range(x.shape[1]):
        out += (x[:, axis, None] - centres[None, :, axis]) ** 2
    return out


def _race(hashes: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Exponential times from the hashes of the keys."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return -np.log(((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)


def _start(points: DataFrame, n_clusters: int, seeds: list[int]) -> list[list[list[int]]]:
    """k-means++ centres of each seed: every next one is drawn in proportion to the squared
    distance from the nearest so far."""
    centres: list[list[list[int]]] = [[] for _ in seeds]
    for step in range(n_clusters):
        chosen = [np.array(c, float) for c in centres]

        def run(batches: Iterator[pa.RecordBatch], step=step, chosen=chosen) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, int, list[int]]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, hashes = _matrix(batch), batch.column("hash").to_numpy()
                for r, seed in enumerate(seeds):
                    weight = _distances(x, chosen[r]).min(axis=1) if step else np.ones(len(x))
                    # Entities on a centre can't win unless all are: then the time alone decides.
                    time = _race(hashes, seed, step)
                    with np.errstate(divide="ignore"):
                        time = np.where(weight > 0, time / weight, np.inf)
                    at = np.lexsort((hashes, time))[0]
                    own = (float(time[at]), int(hashes[at]), x[at].tolist())
                    best[r] = min(best.get(r, own), own)
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(best)), pa.array([b[0] for b in best.values()]),
                     pa.array([b[1] for b in best.values()]),
                     pa.array([b[2] for b in best.values()], pa.list_(pa.int64()))],
                    ["fit", "time", "hash", "point"])

        drawn = points.mapInArrow(run, "fit long, time double, hash long, point array<long>")
        first = drawn.groupBy("fit").agg(F.min(F.struct("time", "hash", "point")).alias("first"))
        for row in first.collect():  # one row per fit
            centres[row.fit].append(list(row["first"].point))
    return centres


def _assigned_sums(
    points: DataFrame, centres: dict[int, np.ndarray]
) -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """(fit, cluster) -> number of points and exact sums of their coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                x = _matrix(batch.slice(start, BATCH_ROWS))
                fits, clusters, counts, totals = [], [], [], []
                for r, own in centres.items():
                    nearest = np.argmin(_distances(x, own), axis=1)
                    for c in range(len(own)):
                        mine = x[nearest == c]
                        if len(mine):
                            fits.append(r)
                            clusters.append(c)
                            counts.append(len(mine))
                            totals.append(mine.sum(axis=0).tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fits, pa.int64()), pa.array(clusters, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array(totals, pa.list_(pa.int64()))], ["fit", "cluster", "n", "totals"])

    axes = next(iter(centres.values())).shape[1]
    parts = points.mapInArrow(run, "fit long, cluster long, n long, totals array<long>")
    rows = parts.groupBy("fit", "cluster").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.col("totals")[a].cast("decimal(38,0)")).alias(f"t{a}") for a in range(axes)),
    ).collect()  # one row per fit and cluster
    empty = {(r, c): (0, (0,) * axes) for r, own in centres.items() for c in range(len(own))}
    return empty | {(r.fit, r.cluster): (r.n, tuple(int(r[f"t{a}"]) for a in range(axes))) for r in rows}
