from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

FLOW_COLUMNS = (
    "pipeline_name STRING, loc_name STRING, connecting_pipeline STRING, "
    "connecting_entity STRING, rec_del_sign INT, category_short STRING, country_name STRING, "
    "state_abb STRING, county_name STRING, latitude STRING, longitude STRING, "
    "eff_gas_day TIMESTAMP_NTZ, scheduled_quantity DOUBLE"
)
_DEFAULTS = {
    "pipeline_name": "P1", "loc_name": "L1", "connecting_pipeline": None,
    "connecting_entity": "E1", "rec_del_sign": 1, "category_short": "LDC",
    "country_name": "US", "state_abb": "TX", "county_name": "C1", "latitude": None,
    "longitude": None, "eff_gas_day": dt.datetime(2024, 1, 1), "scheduled_quantity": 1.0,
}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("flow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "5000")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def flow_of(spark):
    """Rows given by the columns that matter -> a flow table."""
    from flowgauge.sources import as_flow_table

    def make(rows):
        records = []
        for row in rows:
            row = dict(row)
            if isinstance(row.get("eff_gas_day"), str):
                row["eff_gas_day"] = dt.datetime.fromisoformat(row["eff_gas_day"])
            assert set(row) <= set(_DEFAULTS), row
            records.append(tuple({**_DEFAULTS, **row}.values()))
        return as_flow_table(spark.createDataFrame(records, FLOW_COLUMNS))

    return make
