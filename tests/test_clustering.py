from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rows import dicts
from flowgauge.operators import clustering, kmeans
from flowgauge.operators.silhouette import silhouettes


@pytest.fixture
def two_blocks(flow_of):
    """Six locations: three peak in January, three in July; the summer ones are larger."""
    rows = []
    for i in range(6):
        peak, size = (1, 1.0) if i < 3 else (7, 10.0)
        rows += [
            {"loc_name": f"L{i}", "eff_gas_day": f"2024-{m:02d}-15",
             "scheduled_quantity": size * (100.0 + i if m == peak else 10.0)}
            for m in range(1, 13)
        ]
    return flow_of(rows + [{"loc_name": "zero", "scheduled_quantity": 0.0}])


@pytest.mark.parametrize("normalize", [True, False])
def test_blocks_are_separated(two_blocks, normalize):
    result = clustering.perform_clustering(two_blocks, n_clusters=2, normalize=normalize)
    assigned = {r["loc_name"]: r["cluster"] for r in dicts(result.assignments)}
    assert assigned == {"L0": 1, "L1": 1, "L2": 1, "L3": 0, "L4": 0, "L5": 0}
    rows = {r["cluster"]: r for r in dicts(result.statistics)}
    assert rows[0]["usage_pattern"] == "Summer peak" and rows[0]["peak_period"] == 7
    assert rows[1]["usage_pattern"] == "Winter peak" and rows[1]["min_period"] == 2
    assert rows[1]["sample_members"] == ["L0", "L1", "L2"]
    assert rows[1]["mean_total_volume"] == pytest.approx(101 + 110)
    assert sum(r["entity_count"] for r in rows.values()) == 6
    quality = dicts(result.quality)[0]
    assert quality["silhouette_sq_euclidean"] > 0.7 and quality["quality"] == "Excellent"


def test_same_result_twice(two_blocks):
    runs = [
        sorted(tuple(r.values()) for r in dicts(
            clustering.perform_clustering(two_blocks, n_clusters=3).assignments
        ))
        for _ in range(2)
    ]
    assert runs[0] == runs[1]


def test_number_of_clusters_is_checked(two_blocks):
    for n in (0, 6, 7):
        with pytest.raises(ValueError):
            clustering.perform_clustering(two_blocks, n_clusters=n)


def test_one_cluster_is_the_whole(two_blocks):
    result = clustering.perform_clustering(two_blocks, n_clusters=1)
    assert [r["entity_count"] for r in dicts(result.statistics)] == [6]
    quality = dicts(result.quality)[0]
    assert (quality["silhouette_sq_euclidean"], quality["iterations"], quality["converged"]) == (0.0, 0, True)


def test_a_fit_that_is_cut_short_says_so(two_blocks):
    result = clustering.perform_clustering(two_blocks, n_clusters=3, max_iterations=1, restarts=1)
    assert dicts(result.quality)[0]["converged"] is False


def test_checks_hold(two_blocks):
    result = clustering.perform_clustering(two_blocks, n_clusters=2)
    rows = {(r["check_name"], r["period"]): r["value"] for r in dicts(clustering.cluster_checks(result, "loc_name"))}
    assert rows["entities", 0] == 6 and rows["repeated", 0] == 0 and rows["nearer_elsewhere", 0] == 0
    assert rows["volume", 1] == pytest.approx(303 + 300) and rows["volume", 7] == pytest.approx(30 + 3120)


def test_profiles_are_complete(two_blocks):
    rows = dicts(clustering.seasonal_profiles(two_blocks, grain="weekly"))
    assert len(rows) == 6 * 53 and "zero" not in {r["loc_name"] for r in rows}
    with pytest.raises(ValueError):
        clustering.seasonal_profiles(two_blocks, grain="daily")


@pytest.mark.parametrize("grain, expected", [
    ("quarterly", ["Summer peak", "Winter peak"]), ("weekly", [None, None]),
])
def test_usage_label_by_grain(two_blocks, grain, expected):
    result = clustering.perform_clustering(two_blocks, n_clusters=2, grain=grain)
    rows = sorted(dicts(result.statistics), key=lambda r: r["cluster"])
    assert [r["usage_pattern"] for r in rows] == expected


# ---- K-means that does not depend on the layout ----------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    """Points without clear clusters, so that any difference in a start would show."""
    draw = random.Random(11)
    rows = [(f"e{k}", [draw.gauss(0, 1) * 10 ** (a % 3) for a in range(4)]) for k in range(200)]
    return spark.createDataFrame(rows, "entity string, profile array<double>")


@pytest.mark.parametrize("normalize", [True, False])
def test_any_layout_gives_the_same_clusters(cloud, normalize):
    found = []
    for parts in (3, 8, 50):
        points, _ = kmeans.on_grid(cloud.repartition(parts, F.rand(parts)), "entity", "profile", normalize)
        fits = kmeans.fit_all(points.persist(), 4, [1, 2], 100)
        assert all(fit.converged for fit in fits)
        best = min(fits, key=lambda fit: fit.cost)
        rows = kmeans.assigned(points, best.centres).select("entity", "prediction").collect()
        found.append(([fit.cost for fit in fits], best.centres.tolist(), sorted(map(tuple, rows))))
    assert found[0] == found[1] == found[2]
    assert len({p for _, p in found[0][2]}) == 4


def test_cost_and_scaling_are_exact(cloud):
    points, step = kmeans.on_grid(cloud, "entity", "profile", True)
    fit = kmeans.fit_all(points.persist(), 3, [4], 100)[0]
    rows = [(r.entity, [x * step for x in r.point], r.prediction) for r in kmeans.assigned(points, fit.centres).collect()]
    columns = list(zip(*(x for _, x, _ in rows)))
    assert all(abs(sum(c)) < 1e-8 and math.isclose(sum(v * v for v in c), 200, rel_tol=1e-9) for c in columns)
    cost = 0.0
    for cluster in range(3):
        own = [x for _, x, p in rows if p == cluster]
        mean = [sum(c) / len(own) for c in zip(*own)]
        cost += sum((v - m) ** 2 for x in own for v, m in zip(x, mean))
    assert float(fit.cost) * step**2 == pytest.approx(cost, rel=1e-9)


def test_fewer_places_than_clusters_still_ends(spark):
    rows = spark.createDataFrame([(f"e{k}", [float(k % 2), 7.0]) for k in range(10)], "entity string, profile array<double>")
    points, _ = kmeans.on_grid(rows, "entity", "profile", True)
    fits = kmeans.fit_all(points.persist(), 4, [1, 2], 50)
    assert all(fit.converged and fit.cost == 0 for fit in fits)


def test_partitions_do_not_change_the_clustering(two_blocks):
    found = [
        sorted(tuple(r.values()) for r in dicts(
            clustering.perform_clustering(two_blocks, n_clusters=3, partitions=n).assignments))
        for n in (None, 1, 5)
    ]
    assert found[0] == found[1] == found[2]


# ---- silhouettes -----------------------------------------------------------------------------


def silhouettes_by_hand(rows):
    out = {}
    for key, cluster, x in rows:
        means = {}
        for c in {c for _, c, _ in rows}:
            others = [y for k, d, y in rows if d == c and k != key]
            means[c] = sum(math.dist(x, y) for y in others) / len(others) if others else None
        alone = means[cluster] is None
        own = means.pop(cluster) or 0.0
        other = min(means.values()) if means else 0.0
        score = 0.0 if alone or not means or max(own, other) == 0 else (other - own) / max(own, other)
        out[key] = (own, other, score)
    return out


@pytest.mark.parametrize("block_points", [1, 7, 4096])
def test_silhouettes_are_exact(spark, block_points):
    draw = random.Random(3)
    rows = [(f"k{i}", draw.choice([0, 0, 0, 2, 5]), [draw.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    rows += [("alone", 9, [0.0, 0.0, 0.0]), ("twin 1", 11, [4.0, 4.0, 4.0]), ("twin 2", 11, [4.0, 4.0, 4.0])]
    df = spark.createDataFrame(rows, "key string, label int, x array<double>")
    made = silhouettes(df, "key", "label", "x", block_points=block_points).collect()
    expected = silhouettes_by_hand(rows)
    assert len(made) == len(rows)
    for r in made:
        assert (r.own_distance, r.other_distance, r.silhouette) == pytest.approx(expected[r.key])


def test_one_cluster_has_no_silhouette(spark):
    df = spark.createDataFrame([("a", 1, [0.0]), ("b", 1, [3.0])], "key string, label int, x array<double>")
    assert [r.silhouette for r in silhouettes(df, "key", "label", "x").collect()] == [0.0, 0.0]


def test_only_quality_measures_silhouettes(two_blocks, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("distances were asked for")

    monkeypatch.setattr(clustering, "silhouettes", refuse)
    result = clustering.perform_clustering(two_blocks, n_clusters=2)
    checks = {(r["check_name"], r["period"]): r["value"] for r in dicts(clustering.cluster_checks(result, "loc_name"))}
    assert result.assignments.count() == 6 and checks["entities", 0] == 6
    with pytest.raises(AssertionError):
        result.quality  # noqa: B018


def test_each_block_has_a_task_of_its_own(spark):
    points = spark.range(400).selectExpr(
        "cast(id as string) as key", "cast(id % 3 as int) as cluster", "array(cast(id as double), 1.0D) as features")
    scored = silhouettes(points, "key", "cluster", "features", block_points=20)
    assert scored.select(F.spark_partition_id()).distinct().count() == 20
