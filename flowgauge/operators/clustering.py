"""Seasonal profiles of entities and K-means clusters of them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions import stats
from flowgauge.functions.buckets import calendar_part
from flowgauge.functions.metrics import total
from flowgauge.functions.predicates import apply_filters
from flowgauge.operators import kmeans
from flowgauge.operators.silhouette import silhouettes
from flowgauge.session import cut_lineage
from flowgauge.table import FlowTable, with_keys

Filters = Mapping[str, Any] | None

# Periods of a profile.
PERIODS = {"monthly": 12, "quarterly": 4, "weekly": 53}

# Periods in which a peak makes a winter or a summer profile.
WINTER_PEAKS = {"monthly": (12, 1, 2), "quarterly": (1,)}
SUMMER_PEAKS = {"monthly": (6, 7, 8), "quarterly": (3,)}


@dataclass(frozen=True)
class Clustering:
    """``assignments``: entity -> cluster; ``statistics``: one row per cluster, over unscaled
    volumes; ``members``: entity, profile, scaled features and cluster, where cluster 0 has the largest
    mean volume; ``by``: the entity's column; ``iterations`` of the chosen fit, and whether it
    ``converged`` before the most allowed."""

    assignments: DataFrame
    statistics: DataFrame
    members: DataFrame
    by: str
    iterations: int
    converged: bool

    @cached_property
    def quality(self) -> DataFrame:
        """One row, with mean silhouettes by Euclidean (which the label goes by) and by squared
        Euclidean distance, and how the fit ended. Runs Spark jobs when first asked for: distances
        grow with the square of the entities, and nothing else here needs them."""
        return _quality(self.members, self.by, self.iterations, self.converged)


def seasonal_profiles(
    table: FlowTable, by: str = "location", *, grain: str = "monthly", filters: Filters = None
) -> DataFrame:
    """Volume per entity and calendar period, 0 where it has no rows. Entities without any
    volume are left out."""
    by = table.column(by)
    wide = _wide_profiles(table, by, grain, filters)
    return wide.select(by, F.posexplode("profile").alias("pos", "volume")).select(
        by, (F.col("pos") + 1).alias("period"), "volume"
    )


def perform_clustering(
    table: FlowTable,
    by: str = "location",
    *,
    grain: str = "monthly",
    n_clusters: int = 3,
    normalize: bool = True,
    filters: Filters = None,
    seed: int = 42,
    restarts: int = 10,
    max_iterations: int = 300,
    partitions: int | None = None,
    sample_members: int = 5,
) -> Clustering:
    """K-means over seasonal profiles. Fitting runs Spark jobs right away; of ``restarts`` fits
    with at most ``max_iterations`` steps the cheapest wins. The result is the same however the
    entities are dealt out; ``partitions`` asks for a number of parts. One cluster is allowed and
    needs no fit; its silhouette is 0."""
    by = table.column(by)
    profiles = cut_lineage(_wide_profiles(table, by, grain, filters))
    entities = profiles.count()
    if not 1 <= n_clusters < max(entities, 2) or not entities:
        raise ValueError(f"{n_clusters} clusters need more than {n_clusters} entities "
                         f"and at least 1 cluster; there are {entities} entities")
    if partitions:
        profiles = profiles.repartition(partitions, by)
    points, step = kmeans.on_grid(profiles, by, "profile", normalize)
    points = points.persist()
    try:
        if n_clusters == 1:
            iterations, converged = 0, True
            found = points.withColumn("prediction", F.lit(0))
        else:
            seeds = [seed + restart for restart in range(restarts)]
            best = min(kmeans.fit_all(points, n_clusters, seeds, max_iterations), key=lambda fit: fit.cost)
            iterations, converged = best.iterations, best.converged
            found = kmeans.assigned(points, best.centres)
        features = F.transform("point", lambda x: x * F.lit(step))
        predicted = cut_lineage(found.select(by, "profile", features.alias("features"), "prediction"))
    finally:
        points.unpersist()
    return _describe(predicted, by, grain, sample_members, (iterations, converged))


def profile_silhouettes(
    table: FlowTable, by: str, group: str, *, grain: str = "monthly", filters: Filters = None
) -> DataFrame:
    """How well a given grouping of entities (the smallest ``group`` value of each) fits their
    seasonal profiles: entity, group, mean Euclidean distances and silhouette. Entities without a
    volume or a group are left out."""
    by, group = table.column(by), table.column(group)
    labels = with_keys(apply_filters(table, table.raw, filters), by, group).groupBy(by).agg(
        F.min(group).alias(group))
    profiles = cut_lineage(_wide_profiles(table, by, grain, filters).join(labels, by))
    # Groups are numbered; there are far fewer of them than entities.
    numbers = profiles.select(group).distinct().withColumn(
        "cluster", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(group)))
    numbers = cut_lineage(numbers)
    scored = silhouettes(profiles.join(numbers, group), by, "cluster", "profile")
    return scored.join(numbers, "cluster").drop("cluster")


def cluster_checks(clustering: Clustering, by: str) -> DataFrame:
    """What must hold of any clustering, as (check_name, period, value): entities clustered, more
    than once, and nearer to the centre of another cluster than to their own (0 after a fit that
    settled, but for ties in the last bits); and the volume of each period over all clusters."""
    members = clustering.members
    points = members.withColumnRenamed("features", "point")
    by_axis = points.select("cluster", F.posexplode("point").alias("axis", "x"))
    centre = by_axis.groupBy("cluster", "axis").agg(F.avg("x").alias("c"))
    # One array per cluster: as many rows as clusters were asked for.
    table = centre.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("axis", "c"))), lambda s: s["c"]).alias("centre"))
    all_centres = table.agg(F.collect_list(F.struct("cluster", "centre"))).scalar()

    def distance(centre: Column) -> Column:
        gaps = F.zip_with("point", centre, lambda a, b: (a - b) * (a - b))
        return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)

    ranked = points.withColumn("centres", all_centres).select(
        by, F.filter("centres", lambda c: c["cluster"] == F.col("cluster"))[0]["centre"].alias("own"),
        "centres", "point",
    ).select(by, distance(F.col("own")).alias("own"), F.array_min(
        F.transform("centres", lambda c: distance(c["centre"]))).alias("nearest"))
    counted = ranked.agg(
        F.count(F.lit(1)).alias("entities"),
        (F.count(F.lit(1)) - F.count_distinct(F.col(by))).alias("repeated"),
        F.count_if(F.col("own") > F.col("nearest") * (1 + 1e-9) + 1e-12).alias("nearer_elsewhere"),
    )
    checks = counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.lit(0).alias("period"),
                 F.col(name).cast("double").alias("value"))
        for name in ("entities", "repeated", "nearer_elsewhere")
    ])))
    volumes = members.select("cluster", F.posexplode("profile").alias("pos", "volume")).groupBy("pos").agg(
        F.sum("volume").alias("value"))
    return checks.unionByName(volumes.select(
        F.lit("volume").alias("check_name"), (F.col("pos") + 1).alias("period"), "value"))


def _wide_profiles(table: FlowTable, by: str, grain: str, filters: Filters) -> DataFrame:
    part = calendar_part(table.time, grain)
    rows = with_keys(apply_filters(table, table.rows(dedup=True), filters), by)
    sums = rows.groupBy(by, part.alias("period")).agg(total(table.measure).alias("volume"))
    # At most one entry per period of the profile.
    folded = sums.where("period IS NOT NULL").groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("period").cast("int"), "volume"))).alias("of"))
    periods = F.sequence(F.lit(1), F.lit(PERIODS[grain.lower()]))
    profile = F.transform(periods, lambda p: F.coalesce(F.col("of")[p], F.lit(0.0)))
    return folded.select(by, profile.alias("profile")).where(
        F.exists("profile", lambda volume: volume != 0)
    )


def _describe(
    predicted: DataFrame, by: str, grain: str, sample_members: int, fit: tuple[int, bool]
) -> Clustering:
    length = PERIODS[grain.lower()]
    groups = predicted.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("entity_count"),
        F.min(by).alias("first_member"),
        F.array(*[F.avg(F.col("profile")[i]) for i in range(length)]).alias("centroid"),
    ).withColumn("mean_total_volume", _sum(F.col("centroid")))
    # One row per cluster.
    largest_first = Window.partitionBy(F.lit(0)).orderBy(
        F.col("mean_total_volume").desc(), "first_member"
    )
    numbered = groups.withColumn("cluster", F.row_number().over(largest_first) - 1)
    clustered = predicted.join(
        F.broadcast(numbered.select("prediction", "cluster")), "prediction"
    ).select(by, "cluster", "profile", "features")
    assignments = clustered.select(by, "cluster")

    position = F.row_number().over(Window.partitionBy("cluster").orderBy(by))
    members = assignments.withColumn("position", position).where(
        F.col("position") <= sample_members
    ).groupBy("cluster").agg(F.array_sort(F.collect_list(by)).alias("sample_members"))

    centroid = F.col("centroid")
    mean = _sum(centroid) / length
    squares = _sum(F.transform(centroid, lambda v: (v - mean) * (v - mean)))
    peak = F.array_position(centroid, F.array_max(centroid)).cast("int")
    statistics = numbered.select(
        "cluster",
        "entity_count",
        "mean_total_volume",
        peak.alias("peak_period"),
        F.array_max(centroid).alias("peak_volume"),
        F.array_position(centroid, F.array_min(centroid)).cast("int").alias("min_period"),
        F.array_min(centroid).alias("min_volume"),
        F.when(mean != 0, F.sqrt(squares / (length - 1)) / mean).otherwise(0.0)
        .alias("coefficient_of_variation"),
        _usage(peak, grain).alias("usage_pattern"),
    ).join(members, "cluster")
    return Clustering(assignments, statistics, clustered, by, *fit)


def _quality(members: DataFrame, by: str, iterations: int, converged: bool) -> DataFrame:
    spark = members.sparkSession
    mean, squared = 0.0, 0.0
    if members.select("cluster").distinct().count() > 1:
        mean = silhouettes(members, by, "cluster", "features").agg(F.avg("silhouette")).first()[0]
        vectors = members.withColumn("features", array_to_vector("features"))
        squared = ClusteringEvaluator(predictionCol="cluster").evaluate(vectors)
    return spark.range(1).select(
        F.lit(float(mean)).alias("silhouette"), F.lit(float(squared)).alias("silhouette_sq_euclidean"),
        F.lit(iterations).alias("iterations"), F.lit(converged).alias("converged"),
    ).withColumn("quality", stats.label_above(
        F.col("silhouette"), stats.SILHOUETTE_QUALITY, "Poor"
    ))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _usage(peak: Column, grain: str) -> Column:
    grain = grain.lower()
    if grain not in WINTER_PEAKS:
        return F.lit(None).cast("string")
    return (
        F.when(peak.isin(*WINTER_PEAKS[grain]), "Winter peak")
        .when(peak.isin(*SUMMER_PEAKS[grain]), "Summer peak")
        .otherwise("Year-round")
    )
