from __future__ import annotations

import math

import pytest

from rows import day, dicts
from flowgauge.operators import patterns, profile, retrieval
from flowgauge.sources import table_size, write_distinct


def test_duplicates_count_once_in_volumes_and_each_in_counts(flow_of, tmp_path):
    table = flow_of([
        {"connecting_entity": None}, {"connecting_entity": None}, {"connecting_entity": None},
        {"connecting_entity": None, "county_name": "C2"},
    ])
    written = write_distinct(table, str(tmp_path / "distinct"))
    for t in (table, written):
        assert dicts(retrieval.total_volume(t, 2024)) == [
            {"year": 2024, "total_volume": 2.0, "rows_after": 2, "rows_before": 2}
        ]
        assert dicts(retrieval.top_by_activity(t)) == [{"state_abb": "TX", "activity_count": 4}]
        assert dicts(profile.profile_shape(t)) == [{
            "row_count": 4, "column_count": 13, "duplicate_count": 2,
            "numeric_count": 2, "categorical_count": 10,
        }]
    assert written.rows(dedup=True).count() == 2
    assert dicts(table_size(table)) == [{"row_count": 4, "column_count": 13}]


def test_empty_table(flow_of):
    table = flow_of([{}])
    assert dicts(retrieval.total_volume(table, 1999))[0]["total_volume"] == 0.0
    assert dicts(retrieval.filter_and_rank(table, {"year": 1999}, "state")) == []
    empty = type(table)(table.raw.where("false"), table.roles)
    assert dicts(profile.profile_shape(empty))[0]["row_count"] == 0
    assert dicts(retrieval.average_quantity(empty)) == [
        {"avg_quantity": None, "median_quantity": None}
    ]


def test_null_keys_form_no_group_and_missing_measures_sum_to_zero(flow_of):
    table = flow_of([
        {"state_abb": None, "scheduled_quantity": 5.0},
        {"state_abb": "PA", "scheduled_quantity": None},
        {"state_abb": "TX", "scheduled_quantity": math.nan},
        {"state_abb": "TX", "scheduled_quantity": 3.0},
    ])
    assert dicts(retrieval.top_by_volume(table, "state")) == [
        {"state_abb": "TX", "total_volume": 3.0}, {"state_abb": "PA", "total_volume": 0.0}
    ]
    missing = {r["name"]: r for r in dicts(profile.profile_columns(table))}
    assert missing["scheduled_quantity"]["missing_count"] == 2
    assert missing["state_abb"]["missing_pct"] == 25.0
    assert missing["eff_gas_day"]["kind"] == "other"


def test_ties_go_by_key(flow_of):
    table = flow_of([{"pipeline_name": p} for p in "cab"])
    assert [r["pipeline_name"] for r in dicts(retrieval.top_by_volume(table, limit=2))] == [
        "a", "b"
    ]


def test_net_flow_ends(flow_of):
    table = flow_of([
        {"pipeline_name": p, "rec_del_sign": s, "scheduled_quantity": v}
        for p, s, v in (("a", 1, 5.0), ("b", -1, 7.0), ("c", 1, 9.0), ("c", -1, 9.0),
                        ("d", -1, 2.0))
    ])
    rows = sorted(dicts(retrieval.net_flow_sources_and_sinks(table, 2024)),
                  key=lambda r: (r["role"], r["position"]))
    assert [(r["role"], r["pipeline_name"], r["net_flow"]) for r in rows] == [
        ("sink", "b", -7.0), ("sink", "d", -2.0), ("source", "a", 5.0)
    ]


def test_average_daily_is_over_days_with_rows(flow_of):
    table = flow_of([
        {"eff_gas_day": day(0), "scheduled_quantity": 1.0},
        {"eff_gas_day": day(0), "scheduled_quantity": 2.0},
        {"eff_gas_day": day(9), "scheduled_quantity": 5.0},
    ])
    assert dicts(retrieval.top_locations(table, 2024, metric="average_daily")) == [
        {"loc_name": "L1", "value": 4.0}
    ]


def test_no_keys_gives_one_row(flow_of):
    table = flow_of([{"eff_gas_day": day(n)} for n in range(3)])
    assert dicts(retrieval.aggregate_dimensions(table, 2024)) == [{"value": 3.0}]


def test_year_comparison_fills_zeros_and_skips_absent_years(flow_of):
    rows = [
        {"pipeline_name": "a", "eff_gas_day": f"{y}-05-01", "scheduled_quantity": v}
        for y, v in ((2020, 0.0), (2021, 5.0), (2023, 5.0), (2024, 0.0))
    ] + [
        {"pipeline_name": "b", "eff_gas_day": "2021-05-01", "scheduled_quantity": 10.0},
        {"pipeline_name": None, "eff_gas_day": "2021-05-01", "scheduled_quantity": 5.0},
        {"pipeline_name": None, "eff_gas_day": "2022-05-01", "scheduled_quantity": 5.0},
    ]
    table = flow_of(rows)
    sums = sorted(
        (r["pipeline_name"], r["year"], r["value"], r["yoy_change"])
        for r in dicts(retrieval.compare_years(table, 2019, 2025))
    )
    assert sums == [
        ("a", 2020, 0.0, None), ("a", 2021, 5.0, None), ("a", 2023, 5.0, 0.0),
        ("a", 2024, 0.0, -100.0),
        ("b", 2020, 0.0, None), ("b", 2021, 10.0, None), ("b", 2023, 0.0, -100.0),
        ("b", 2024, 0.0, None),
    ]
    shares = {
        (r["pipeline_name"], r["year"]): r["value"]
        for r in dicts(retrieval.compare_years(table, 2019, 2025, metric="percentage_share"))
    }
    assert shares["a", 2021] == 25.0 and shares["b", 2021] == 50.0
    assert shares["a", 2020] is None and shares["a", 2023] == 100.0


def test_season_and_months(flow_of):
    table = flow_of([{"eff_gas_day": f"2024-{m:02d}-10", "rec_del_sign": 1}
                     for m in range(1, 13)])
    seasons = {r["season"]: r for r in dicts(patterns.seasonal_patterns(table))}
    assert {s: r["transaction_count"] for s, r in seasons.items()} == {
        "Winter": 3, "Spring": 3, "Summer": 3, "Fall": 3
    }
    assert [s for s, r in seasons.items() if r["is_peak"]] == ["Fall"]
    assert all(r["deliveries_volume"] == 0.0 for r in seasons.values())
    assert patterns.monthly_trends(table, last=5).count() == 5
    summary = dicts(patterns.monthly_trends_summary(table))[0]
    assert str(summary["peak_month"]) == "2024-01-01" and summary["average_growth"] == 0.0


def test_one_direction_only(flow_of):
    table = flow_of([{"eff_gas_day": f"2024-{m:02d}-10", "scheduled_quantity": float(m)}
                     for m in range(1, 4)])
    assert dicts(patterns.direction_balance_summary(table)) == [{
        "correlation": None, "average_net_flow": 2.0, "net_flow_volatility": 1.0,
        "strength": None,
    }]


def test_consistency_needs_three_months_and_a_positive_mean(flow_of):
    def months(name, values):
        return [
            {"pipeline_name": name, "eff_gas_day": f"2024-{m:02d}-01", "scheduled_quantity": v}
            for m, v in enumerate(values, 1)
        ]

    table = flow_of(
        months("steady", [5.0, 5.0, 5.0]) + months("short", [1.0, 1.0])
        + months("zero", [0.0, 0.0, 0.0]) + months("wild", [1.0, 9.0, 2.0])
    )
    rows = dicts(patterns.consistent_pipelines(table))
    assert [r["pipeline_name"] for r in rows] == ["steady", "wild", "zero"]
    assert rows[0]["score"] == 1.0 and rows[2]["cv_pct"] is None and rows[2]["score"] == 0.0
    assert dicts(patterns.consistency_coverage(table)) == [{"groups_analyzed": 3}]


def test_perfect_line(flow_of):
    """y = 2x + 1 over five days: x counts rows, y is their volume."""
    rows = []
    for n in range(1, 6):
        rows += [{"eff_gas_day": day(n), "loc_name": f"L{i}",
                  "scheduled_quantity": 2.0 if i else 3.0} for i in range(n)]
    table = flow_of(rows)
    result = dicts(patterns.calculate_correlation(table, "transaction_count", "volume"))[0]
    assert result["slope"] == pytest.approx(2) and result["intercept"] == pytest.approx(1)
    assert result["r_squared"] == pytest.approx(1) and result["t_statistic"] is None
    assert result["significant"] and result["strength"] == "Very Strong"


def test_before_after(flow_of):
    rows = [{"eff_gas_day": day(n), "scheduled_quantity": float(v)}
            for n, v in enumerate([1, 2, 3, 4, 5, 3, 4, 5, 6, 7])]
    result = dicts(patterns.before_after_ttest(flow_of(rows), "2024-01-06"))[0]
    assert result["t_statistic"] == pytest.approx(-2.0)
    assert result["degrees_of_freedom"] == 8
    assert result["p_value"] == pytest.approx(0.0805, abs=1e-4)
    assert result["significance"] == "Not significant"
    assert result["percentage_change"] == pytest.approx(100 * 2 / 3)

    few = dicts(patterns.before_after_ttest(flow_of(rows[:6]), "2024-01-06"))[0]
    assert (few["t_statistic"], few["p_value"], few["significance"]) == (
        0.0, 1.0, "Insufficient data"
    )
    assert dicts(patterns.before_after_ttest(flow_of(rows), "2030-01-01")) == []
    with pytest.raises(ValueError):
        patterns.before_after_periods(flow_of(rows), "2024-01-06", grain="hourly")


def test_constant_sides(flow_of):
    rows = [{"eff_gas_day": day(n), "scheduled_quantity": 1.0 if n < 3 else 2.0}
            for n in range(6)]
    result = dicts(patterns.before_after_ttest(flow_of(rows), "2024-01-04"))[0]
    assert result["t_statistic"] is None and result["p_value"] == 0.0
    assert result["significance"] == "Significant"


def test_unknown_metric(flow_of):
    with pytest.raises(ValueError):
        retrieval.filter_and_rank(flow_of([{}]), {}, "state", metric="mode")
    with pytest.raises(ValueError):
        patterns.calculate_correlation(flow_of([{}]), "volume", "noise")


def test_net_flow_totals_agree(spark):
    from pyspark.sql import functions as F

    from registry.flow_view import flow

    table = flow(spark, "/root/testdata/sf0.001")
    totals = {
        by: retrieval.net_flows(table, 1997, by, limit=None).agg(F.sum("net_flow")).first()[0]
        for by in ("pipeline", "state", "location", "category")
    }
    assert len(set(totals.values())) == 1
    shares = retrieval.compare_years(table, 1995, 2001, metric="percentage_share")
    for row in dicts(retrieval.compare_years_totals(shares)):
        assert row["total"] == pytest.approx(100)
