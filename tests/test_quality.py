from __future__ import annotations

import pytest

from rows import dicts
from flowgauge.operators import profile, quality
from flowgauge.plans import questions


def test_missing_sign_is_a_violation(flow_of):
    table = flow_of([
        {"category_short": "Production", "rec_del_sign": s} for s in (1, 1, -1, None)
    ] + [{"category_short": "LDC", "rec_del_sign": -1}])
    assert dicts(quality.rule_violations(table, "Production", "receipts")) == [
        {"category": "Production", "total": 4, "violations": 2, "pct": 50.0}
    ]
    assert quality.rule_violation_examples(table, "Production", "receipts").count() == 2
    assert dicts(quality.rule_violations_by(table, "Production", "receipts")) == [
        {"pipeline_name": "P1", "violations": 2}
    ]
    assert dicts(quality.rule_violations(table, "Storage", "receipts")) == []
    assert sorted(r["category_short"] for r in dicts(
        profile.distinct_values(table, "category")
    )) == ["LDC", "Production"]


def test_completeness_modes(flow_of):
    table = flow_of([
        {"connecting_pipeline": p, "connecting_entity": e, "loc_name": f"L{i}"}
        for i, (p, e) in enumerate([("x", "y"), (None, "y"), ("", None), (None, "")])
    ])
    fields = ["connecting_pipeline", "connecting_entity"]
    all_missing = dicts(quality.completeness(table, "LDC", fields))[0]
    any_missing = dicts(quality.completeness(table, "LDC", fields, "any_missing"))[0]
    assert (all_missing["incomplete"], any_missing["incomplete"]) == (2, 3)
    examples = dicts(quality.completeness_examples(table, "LDC", fields, "any_missing"))
    assert [r["missing_fields"] for r in examples] == [
        ["connecting_pipeline"], fields, fields
    ]
    numeric = dicts(quality.completeness(table, "LDC", ["scheduled_quantity"]))[0]
    assert numeric["incomplete"] == 0
    with pytest.raises(ValueError):
        quality.completeness(table, "LDC", fields, "some")
    with pytest.raises(ValueError):
        quality.completeness(table, "LDC", [])


def test_conflicts_ignore_nulls(flow_of):
    table = flow_of(
        [{"loc_name": "A", "state_abb": s} for s in ("Y", "X", None, "X")]
        + [{"loc_name": "B", "state_abb": s} for s in ("X", None)]
        + [{"loc_name": "C", "state_abb": None}, {"loc_name": None, "state_abb": "X"},
           {"loc_name": None, "state_abb": "Z"}]
    )
    keys, dimensions = ["pipeline", "location"], ["state", "county_name"]
    conflicts = {r["dimension"]: r for r in dicts(
        quality.entity_conflicts(table, keys, dimensions)
    )}
    assert conflicts["state_abb"] == {
        "dimension": "state_abb", "duplicate_count": 1, "total_entities": 3,
        "duplicate_pct": 33.33,
    }
    assert conflicts["county_name"]["duplicate_count"] == 0
    details = dicts(quality.entity_conflict_details(table, keys, dimensions))
    assert [(r["loc_name"], r["n_values"], r["values"]) for r in details] == [
        ("A", 2, ["X", "Y"])
    ]
    values = dicts(quality.entity_conflict_values(table, keys, dimensions))
    assert sorted(r["value"] for r in values) == ["X", "Y"]


def test_details_keep_the_limit_per_dimension(flow_of):
    table = flow_of([
        {"loc_name": f"L{i}", "state_abb": s, "county_name": c}
        for i in range(6) for s, c in (("X", "1"), ("Y", "2"))
    ])
    details = dicts(quality.entity_conflict_details(
        table, ["location"], ["state", "county_name"], limit=2
    ))
    assert sorted((r["dimension"], r["loc_name"]) for r in details) == [
        ("county_name", "L0"), ("county_name", "L1"), ("state_abb", "L0"), ("state_abb", "L1")
    ]


def test_concentration(flow_of):
    volumes = [1_813_302_799, 50_371_267, 10_585_690, 880_406, 0]
    table = flow_of([
        {"county_name": f"C{i}", "rec_del_sign": -1, "scheduled_quantity": float(v)}
        for i, v in enumerate(volumes)
    ] + [{"county_name": None, "rec_del_sign": -1}, {"county_name": "C0", "rec_del_sign": 1}])
    row = dicts(questions.concentration(table, filters={"pipeline": "P1"}))[0]
    assert row["groups"] == 5 and row["level"] == "High"
    assert row["hhi"] == pytest.approx(0.935886, abs=1e-6)
    assert dicts(questions.concentration(table, filters={"pipeline": "none"})) == []


def test_quantile_buckets(flow_of):
    table = flow_of([
        {"state_abb": f"S{i}", "rec_del_sign": -1, "scheduled_quantity": float(i)}
        for i in range(1, 10)
    ])
    buckets = {r["state_abb"]: r["bucket"] for r in dicts(questions.quantile_buckets(table))}
    assert [buckets[f"S{i}"] for i in range(1, 10)] == (
        ["low"] * 3 + ["medium"] * 3 + ["high"] * 3
    )


def test_null_share(flow_of):
    table = flow_of([{"latitude": "1"}, {}, {"state_abb": "PA"}])
    shares = {r["state_abb"]: r["latitude_missing_pct"] for r in dicts(
        profile.null_share(table, ["latitude"], "state")
    )}
    assert shares == {"TX": 50.0, "PA": 100.0}
