"""Silhouettes by Euclidean distance, exact, as a blocked product.

Points are dealt to blocks of bounded size. Every block meets every block once, in one task that
adds distances up by cluster and lets them go again: what leaves it is one row of sums per point,
never a pair of points.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.session import cut_lineage

# The functions that run in tasks travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points in a block, about.
BLOCK_POINTS = 4096
#: Distances that a task holds at a time, about: few enough to stay in the cache of a core.
_HELD = 1 << 15


def add_distances(mine: np.ndarray, theirs: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``sums`` the distances of each of my points to all of theirs. Points are axes x points."""
    n = theirs.shape[1]
    if not n:
        return
    step = max(1, _HELD // n)
    squares, gaps = np.empty((step, n)), np.empty((step, n))
    for start in range(0, mine.shape[1], step):
        strip = mine[:, start : start + step, None]
        total, gap = squares[: strip.shape[1]], gaps[: strip.shape[1]]
        total.fill(0.0)
        for axis in range(len(mine)):
            np.subtract(strip[axis], theirs[axis], out=gap)
            np.multiply(gap, gap, out=gap)
            np.add(total, gap, out=total)
        sums[start : start + step] += np.sqrt(total, out=total).sum(axis=1)


def silhouettes(
    points: DataFrame, key: str, cluster: str, features: str, *, block_points: int = BLOCK_POINTS
) -> DataFrame:
    """(key, cluster, own_distance, other_distance, silhouette) of every point: mean distance to the
    other points of its cluster, smallest mean distance to those of another, and their difference
    over the larger; 0 for the only point of a cluster, and where there is just one cluster.

    ``features`` is an array of double of equal length, ``cluster`` an int; keys are unique. A point
    is copied once for every block, so the copies are points times points / ``block_points``; the
    distances, points squared, are added up in place.
    """
    sizes = {r.cluster: r.n for r in points.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per cluster
    total, numbers = sum(sizes.values()), sorted(sizes)
    blocks = max(1, -(-total // block_points))
    block = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(blocks)).cast("int")
    dealt = points.select(
        block.alias("block"), F.col(key).alias("key"), F.col(cluster).cast("int").alias("cluster"), F.col(features).alias("features"))
    # Packed: a block is one row, whose arrays a task can use as they are.
    packed = cut_lineage(dealt.groupBy("block").agg(F.collect_list(F.struct("key", "cluster", "features")).alias("points")))
    others = packed.select(
        F.col("block").alias("other"), F.col("points")["cluster"].alias("clusters"),
        F.flatten(F.col("points")["features"]).alias("values"))
    own = packed.select("block", F.lit(-1).alias("other"), F.col("points")["key"].alias("keys"),
                        F.col("points")["cluster"].alias("clusters"), F.flatten(F.col("points")["features"]).alias("values"))
    # Each block is sent to the tasks of all blocks.
    meetings = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "keys", F.lit(None).cast(own.schema["keys"].dataType))
    met = own.unionByName(meetings.select(own.columns)).repartitionByRange(blocks, "block").sortWithinPartitions("block", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                block = one.column("block")[0].as_py()
                clusters = one.column("clusters").flatten().to_numpy()
                x = one.column("values").flatten().to_numpy().reshape(len(clusters), -1)
                if one.column("other")[0].as_py() < 0:
                    if here is not None:
                        yield finished(here)
                    here = (one.column("keys").flatten(), clusters, x.T.copy(), np.zeros((len(x), len(numbers))), block)
                    continue
                if here is None or here[-1] != block:
                    continue  # a block that no point fell into
                _, _, mine, sums, _ = here
                for c, number in enumerate(numbers):
                    add_distances(mine, x[clusters == number].T.copy(), sums[:, c])
        if here is not None:
            yield finished(here)

    def finished(here: tuple) -> pa.RecordBatch:
        keys, clusters, _, sums, _ = here
        n = np.array([sizes[number] for number in numbers], float)
        place = np.searchsorted(numbers, clusters)
        rows = np.arange(len(sums))
        inside = sums[rows, place] / np.maximum(n[place] - 1, 1)
        means = sums / n
        means[rows, place] = np.inf
        outside = means.min(axis=1) if len(numbers) > 1 else np.zeros(len(sums))
        largest = np.maximum(inside, outside)
        score = np.where(largest > 0, (outside - inside) / np.where(largest > 0, largest, 1), 0.0)
        score[(n[place] == 1) | (len(numbers) == 1)] = 0.0
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(clusters), *(pa.array(v) for v in (inside, outside, score))],
            ["key", "cluster", "own_distance", "other_distance", "silhouette"])

    kind = points.schema[key].dataType.simpleString()
    scored = met.mapInArrow(
        run, f"key {kind}, cluster int, own_distance double, other_distance double, silhouette double")
    return scored.withColumnRenamed("key", key).withColumnRenamed("cluster", cluster)
