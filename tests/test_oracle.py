"""Every registered query against its SQL on whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from compare import duck, spark_rows, sql_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLUSTERS = {"cluster_assignments", "cluster_statistics", "cluster_quality"}
CORPUS = [n for n in entry_module.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql_unless_iterative():
    own = set(entry_module.queries()) - set(CORPUS)
    assert own - set(entry_module.oracle_sql()) == CLUSTERS
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(set(entry_module.oracle_sql()) - set(CORPUS)))
def test_matches_sql(spark, connection, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    sql = entry_module.oracle_sql()[name]
    assert spark_rows(df) == sql_rows(connection, sql)
    described = {c[0]: str(c[1]) for c in connection.execute(sql).description}
    assert {c: SPARK_TO_DUCK[t] for c, t in df.dtypes} == described


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_written_and_in_place_flow_agree(spark):
    from flowgauge.operators import retrieval
    from registry.flow_view import flow, flow_in_place

    written, in_place = flow(spark, SF_DIR), flow_in_place(spark, SF_DIR)
    assert written.raw.count() == in_place.raw.count()
    for analysis in (
        lambda t: retrieval.top_by_volume(t, limit=None),
        lambda t: retrieval.total_volume(t, 1997),
        lambda t: retrieval.average_quantity(t),
    ):
        assert spark_rows(analysis(written)) == spark_rows(analysis(in_place))
