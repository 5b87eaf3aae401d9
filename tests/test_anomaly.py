from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rows import day, dicts
from flowgauge.operators import anomaly
from flowgauge.operators.near_join import near_join
from flowgauge.plans import questions


def spike(days=100):
    values = [10.0 if n % 2 else 12.0 for n in range(days - 1)] + [1000.0]
    return [{"eff_gas_day": day(n), "scheduled_quantity": v} for n, v in enumerate(values)]


def test_spike_is_found_by_every_detector(flow_of):
    table = flow_of(spike())
    values = np.array([r["scheduled_quantity"] for r in spike()][-90:])
    rolling = dicts(anomaly.anomaly_rolling(table))
    assert [str(r["day"]) for r in rolling] == ["2024-04-09"]
    assert rolling[0]["zscore"] == pytest.approx(
        (1000 - values.mean()) / values.std(ddof=1)
    )
    change = dicts(anomaly.anomaly_change(table))
    assert [(r["kind"], str(r["day"])) for r in change] == [("increase", "2024-04-09")]
    percentile = dicts(anomaly.anomaly_percentile(table, limit=1))
    assert percentile[0]["roll_percentile"] == pytest.approx(np.quantile(values, 0.95))
    total = dicts(anomaly.anomaly_rolling(table, "total"))
    assert [r["entity"] for r in total] == ["Total System"]
    assert dicts(anomaly.anomaly_zscore_count(table)) == [{"anomalies": 1}]


def test_current_row_can_be_left_out(flow_of):
    rows = spike(20)
    inside = dicts(anomaly.anomaly_rolling(flow_of(rows), days=5, threshold=2.0))
    outside = dicts(anomaly.anomaly_rolling(
        flow_of(rows), days=5, threshold=2.0, include_current=False
    ))
    assert inside == [] and [r["quantity"] for r in outside] == [1000.0]


def test_short_window_needs_all_its_rows(flow_of):
    rows = [{"eff_gas_day": day(n), "scheduled_quantity": v}
            for n, v in enumerate([1.0, 9.0, 1.0, 9.0])]
    changes, _ = anomaly.rolling_change(flow_of(rows), days=3)
    averages = {str(r["day"]): r["recent_avg"] for r in dicts(changes)}
    assert averages == {
        "2024-01-01": None, "2024-01-02": None,
        "2024-01-03": pytest.approx(11 / 3), "2024-01-04": pytest.approx(19 / 3),
    }


def test_frames_differ_on_gaps(flow_of):
    rows = [{"eff_gas_day": day(30 * n), "scheduled_quantity": float(n)} for n in range(8)]
    table = flow_of(rows)
    by_rows, _ = anomaly.rolling_change(table, days=5)
    by_days, _ = anomaly.rolling_change(table, days=5, frame="days")
    assert sum(r["recent_avg"] is not None for r in dicts(by_rows)) == 4
    assert sum(r["recent_avg"] is not None for r in dicts(by_days)) == 0
    with pytest.raises(ValueError):
        anomaly.anomaly_change(table, frame="weeks")


def test_constant_and_zero_series(flow_of):
    constant = [{"eff_gas_day": day(n), "scheduled_quantity": 3.0} for n in range(30)]
    assert dicts(anomaly.anomaly_rolling(flow_of(constant))) == []
    assert dicts(anomaly.anomaly_zscore(flow_of(constant))) == []
    values = [0.0] * 10 + [-4.0, 4.0]
    zero = [{"eff_gas_day": day(n), "scheduled_quantity": v} for n, v in enumerate(values)]
    rows = dicts(anomaly.anomaly_change(flow_of(zero), days=12, limit=5))
    assert [(str(r["day"]), r["pct_change"], r["kind"]) for r in rows][0] == (
        "2024-01-12", None, "increase"
    )


def test_duplicates_count_in_changes_only_by_default(flow_of):
    table = flow_of([{"eff_gas_day": day(n)} for n in range(8)] + [{"eff_gas_day": day(7)}] * 9)
    assert anomaly.anomaly_change(table, days=8).count() > 0
    assert anomaly.anomaly_change(table, days=8, dedup=True).count() == 0
    assert anomaly.anomaly_rolling(table, days=8, threshold=1.0).count() == 0


def test_partner_start(flow_of):
    daily = [
        {"eff_gas_day": day(n), "category_short": "LDC", "connecting_pipeline": None,
         "scheduled_quantity": 1.0 if n < 20 else 5.0}
        for n in range(40)
    ]
    starts = [
        {"eff_gas_day": day(n), "category_short": "Interconnect", "connecting_pipeline": p,
         "scheduled_quantity": 2.0}
        for n, p in ((20, "new"), (25, "new"), (3, "early"))
    ]
    rows = dicts(questions.partner_start_effect(
        flow_of(daily + starts), "Interconnect", partner="connecting_pipeline", days=10
    ))
    assert [(r["connecting_pipeline"], str(r["start_day"])) for r in rows] == [
        ("new", "2024-01-21")
    ]
    assert rows[0]["mean_before"] == 1.0
    assert rows[0]["mean_after"] == pytest.approx((10 * 5 + 2 * 2) / 10)
    assert rows[0]["increased"]


def test_spikes_with_drops_elsewhere(flow_of):
    rows = []
    for pipeline, category, last in (("A", "Interconnect", 100.0), ("B", "LDC", 1.0),
                                     ("C", "LDC", 10.0)):
        rows += [
            {"pipeline_name": pipeline, "loc_name": f"at {pipeline}",
             "category_short": category, "eff_gas_day": day(n),
             "scheduled_quantity": last if n == 29 else 10.0 + n % 2}
            for n in range(30)
        ]
    rows += [{**r, "pipeline_name": "D", "state_abb": "PA", "loc_name": "at D"}
             for r in rows if r["pipeline_name"] == "A"]
    cases = dicts(questions.spike_codrop_cases(flow_of(rows), "Interconnect"))
    assert [(r["case_no"], r["pipeline_name"], r["drop_pipeline"], str(r["day"]))
            for r in cases] == [(1, "A", "B", "2024-01-30")]


def test_winter_against_summer(flow_of):
    table = flow_of([
        {"eff_gas_day": f"2024-{m:02d}-{d:02d}", "rec_del_sign": -1,
         "scheduled_quantity": base + d}
        for m, base in ((1, 100.0), (7, 50.0), (4, 999.0)) for d in range(1, 6)
    ] + [{"state_abb": "PA", "rec_del_sign": -1, "eff_gas_day": "2024-01-05"}])
    means = {r["state_abb"]: r for r in dicts(questions.winter_vs_summer(table))}
    assert means["TX"]["difference_pct"] == pytest.approx(100 * (103 / 53 - 1))
    assert means["PA"]["summer_mean"] is None and means["PA"]["difference_pct"] is None
    tests = {r["state_abb"]: r for r in dicts(questions.winter_summer_ttest(table))}
    assert tests["TX"]["t_statistic"] == pytest.approx(50.0)
    assert tests["TX"]["significance"] == "Significant" and tests["TX"]["p_value"] < 1e-10
    assert tests["PA"]["significance"] == "Insufficient data"
    assert tests["PA"]["p_value"] is None


# ---- sliding quantiles and near days ---------------------------------------------------------


@pytest.mark.parametrize("frame", ["rows", "days"])
@pytest.mark.parametrize("include_current", [True, False])
def test_sliding_quantile_is_that_of_each_frame(flow_of, frame, include_current):
    draw = random.Random(5)
    days, width, rows = sorted(draw.sample(range(200), 90)), 12, []
    for entity in ("L1", "L2"):
        rows += [{"loc_name": entity, "eff_gas_day": day(n), "scheduled_quantity": float(draw.choice([1, 2, 2, 5, 9]))}
                 for n in days]
    expected = {}
    for entity in ("L1", "L2"):
        own = [(r["eff_gas_day"], r["scheduled_quantity"]) for r in rows if r["loc_name"] == entity]
        for k, (at, value) in enumerate(own):
            last = k + 1 if include_current else k
            if frame == "rows":
                window = [v for _, v in own[max(0, last - width) : last]]
            else:
                reach = width - 1 if include_current else width
                window = [v for d, v in own[:last] if (at - d).days <= reach]
            if len(window) >= 5 and value > np.quantile(window, 0.8):
                expected[entity, str(at.date())] = np.quantile(window, 0.8)
    made = dicts(anomaly.anomaly_percentile(
        flow_of(rows), days=width, percentile=80.0, frame=frame, include_current=include_current))
    assert {(r["loc_name"], str(r["day"])): r["roll_percentile"] for r in made} == pytest.approx(expected)
    assert expected


def test_near_join_finds_every_pair_once(spark):
    draw = random.Random(9)
    base = dt.date(2024, 1, 1)
    # One key holds most of the rows.
    left = [(k, draw.choice(["hot", "hot", "hot", "b", None]), base + dt.timedelta(draw.randrange(60))) for k in range(80)]
    right = [(k, draw.choice(["hot", "hot", "hot", "b", None]), base + dt.timedelta(draw.randrange(-9, 70))) for k in range(90)]
    left.append((999, "hot", None))
    a = spark.createDataFrame(left, "i long, key string, at date")
    b = spark.createDataFrame(right, "j long, other string, there date")
    for before, after in ((0, 0), (2, 2), (0, 5), (3, 0)):
        expected = sorted(
            (i, j) for i, k, d in left for j, o, e in right
            if k is not None and k == o and d is not None and -before <= (e - d).days <= after)
        pairs = near_join(a, b, [("key", "other")], ("at", "there"), before, after)
        assert sorted((r.i, r.j) for r in pairs.collect()) == expected
        odd = near_join(a, b, [("key", "other")], ("at", "there"), before, after,
                        extra=F.col("j") % 2 == 1, how="left_semi")
        assert sorted(r.i for r in odd.collect()) == sorted({i for i, j in expected if j % 2})
    with pytest.raises(ValueError):
        near_join(a, a, [("key", "key")], ("at", "at"))


def test_drops_up_to_some_days_around_a_spike(flow_of):
    rows = []
    for pipeline, category, special in (("A", "Interconnect", {29: 100.0}), ("B", "LDC", {31: 1.0}), ("C", "LDC", {26: 1.0})):
        rows += [
            {"pipeline_name": pipeline, "loc_name": f"at {pipeline}", "category_short": category,
             "eff_gas_day": day(n), "scheduled_quantity": special.get(n, 10.0 + n % 2)}
            for n in range(34)
        ]
    table = flow_of(rows)
    assert dicts(questions.spike_codrop_cases(table, "Interconnect")) == []
    near = dicts(questions.spike_codrop_cases(table, "Interconnect", within_days=2))
    assert [(r["pipeline_name"], r["drop_pipeline"], r["days_apart"]) for r in near] == [("A", "B", 2)]
    wide = dicts(questions.spike_codrop_cases(table, "Interconnect", within_days=3))
    assert sorted((r["drop_pipeline"], r["days_apart"]) for r in wide) == [("B", 2), ("C", -3)]
