from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rows import dicts
from flowgauge import FlowSchema, FlowTable
from flowgauge.functions import buckets
from flowgauge.functions.predicates import apply_filters
from flowgauge.sources import as_flow_table


def ids(table, filters):
    return sorted(r["scheduled_quantity"] for r in dicts(
        apply_filters(table, table.raw, filters)
    ))


@pytest.fixture
def table(flow_of):
    return flow_of([
        {"scheduled_quantity": 1.0, "eff_gas_day": "2023-12-31", "state_abb": "PA"},
        {"scheduled_quantity": 2.0, "eff_gas_day": "2024-01-01", "rec_del_sign": -1},
        {"scheduled_quantity": 3.0, "eff_gas_day": "2024-07-01T10:00:00",
         "connecting_entity": None},
        {"scheduled_quantity": 4.0, "eff_gas_day": "2025-01-01", "rec_del_sign": None},
    ])


@pytest.mark.parametrize("filters, expected", [
    ({}, [1, 2, 3, 4]),
    (None, [1, 2, 3, 4]),
    ({"year": 2024}, [2, 3]),
    ({"year": "2024"}, [2, 3]),
    ({"years": (2023, 2024)}, [1, 2, 3]),
    ({"month": 1}, [2, 4]),
    ({"season": "WINTER"}, [1, 2, 4]),
    ({"season": "summer", "year": 2024}, [3]),
    ({"state": "PA"}, [1]),
    ({"state": "nowhere"}, []),
    ({"transaction_type": "Deliveries"}, [2]),
    ({"transaction_type": "receipts"}, [1, 3]),
    ({"transaction_type": -1}, [2]),
    ({"counterparty": "E1"}, [1, 2, 4]),
    ({"entity": "E1", "pipeline": "P1", "category": "LDC"}, [1, 2, 4]),
    ({"eff_gas_day": "2024-07-01"}, [3]),
    ({"eff_gas_day": "2024-07-01 10:00:00"}, [3]),
    ({"eff_gas_day": "2024-07-01 11:00:00"}, []),
    ({"rec_del_sign": 1}, [1, 3]),
    ({"scheduled_quantity": "2"}, [2]),
])
def test_filters(table, filters, expected):
    assert ids(table, filters) == expected


@pytest.mark.parametrize("filters", [
    {"nope": 1}, {"season": "monsoon"}, {"transaction_type": "both"}, {"year": "soon"},
    {"eff_gas_day": "someday"}, {"scheduled_quantity": "much"}, {"state": None},
])
def test_bad_filters_raise_before_any_job(table, filters):
    with pytest.raises(ValueError):
        apply_filters(table, table.raw, filters)


def test_iso_weeks_stay_whole(flow_of):
    table = flow_of([{"eff_gas_day": d} for d in ("2024-12-29", "2024-12-30", "2025-01-01")])
    weeks = table.raw.select(buckets.period(F.col("eff_gas_day"), "weekly").alias("w"))
    assert [str(r["w"]) for r in dicts(weeks)] == ["2024-12-23", "2024-12-30", "2024-12-30"]


def test_unknown_grains_raise():
    for bucket in (buckets.period, buckets.report_bucket, buckets.calendar_part):
        with pytest.raises(ValueError):
            bucket(F.lit(None), "hourly")


def test_table_checks(spark, table):
    with pytest.raises(ValueError, match="missing from the table"):
        FlowTable(table.raw.drop("loc_name"))
    with pytest.raises(ValueError, match="numeric"):
        FlowTable(table.raw, FlowSchema(measure="loc_name"))
    with pytest.raises(ValueError, match="date or timestamp"):
        FlowTable(table.raw, FlowSchema(time="loc_name"))
    assert FlowTable(table.raw.drop("loc_name"), FlowSchema(location=None)).column("state")


def test_text_dates_are_parsed(spark):
    df = spark.createDataFrame(
        [("2024-03-01", 2.0)], "day STRING, volume DOUBLE"
    )
    roles = FlowSchema(**{
        role: None for role in ("pipeline", "location", "partner_pipeline", "partner", "sign",
                                "category", "country", "region", "subregion")
    }, time="day", measure="volume")
    table = as_flow_table(df, roles)
    assert apply_filters(table, table.raw, {"year": 2024}).count() == 1
    with pytest.raises(ValueError, match="role 'sign'"):
        apply_filters(table, table.raw, {"transaction_type": "receipts"})
