"""What the plans must look like, whatever the size of the data."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import anomaly, patterns, quality, retrieval
from flowgauge.plans import questions
from registry.flow_view import FLOW_SCHEMA, flow, flow_in_place
from registry.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"
EAGER = {"cluster_assignments", "cluster_statistics", "cluster_quality", "cluster_checks"}
# Sliding quantiles and silhouettes; all else runs in the JVM.
WITH_ARROW = {"anomaly_percentile_location", "anomaly_percentile_total", "silhouette_by_state"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(all_queries()) - EAGER))
def test_no_cross_joins_and_no_python_but_where_named(spark, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("MapInArrow" in text) == (name in WITH_ARROW)
    assert "EvalPython" not in text


@pytest.mark.parametrize("name", ["net_flows_by_pipeline", "top_locations_sum",
                                  "multi_dim_monthly_sum", "compare_years_sum"])
def test_year_filter_reaches_the_scan(spark, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", text)
    assert pushed and all("GreaterThanOrEqual(eff_gas_day" in p for p in pushed)


def test_filters_move_below_duplicate_removal(spark):
    table = flow_in_place(spark, SF_DIR)
    text = plan(retrieval.net_flows(table, 1997))
    assert "GreaterThanOrEqual(l_shipdate" in text


def test_exact_median_shuffles_only_the_bracket(spark):
    """Values reach an exchange only after the filter on the bracket."""
    text = plan(retrieval.average_quantity(flow(spark, SF_DIR)))
    assert "percentile_approx" in text
    for part in re.findall(r"Exchange hashpartitioning\(i#.*?Scan", text, re.DOTALL):
        assert "brackets" in part and "Generate" in part


def test_profiles_sum_one_column(spark):
    text = plan(all_queries()["profile_weekly"](spark, SF_DIR))
    assert text.count("partial_sum") == 1


def test_scans_read_only_needed_columns(spark):
    text = plan(quality.rule_violations(flow(spark, SF_DIR), "SMALL", "receipts"))
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"rec_del_sign", "category_short"}
    assert len(FLOW_SCHEMA.split(",")) == 13


@pytest.mark.parametrize("name", ["top_locations_per_direction", "entity_conflict_details"])
def test_top_k_per_group_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(all_queries()[name](spark, SF_DIR))


def test_rolling_windows_run_on_daily_rows(spark):
    text = plan(anomaly.anomaly_rolling(flow(spark, SF_DIR)))
    assert text.index("Window") < text.index("HashAggregate(keys=[loc_name")


def test_written_distinct_copy_saves_the_whole_row_shuffle(spark):
    text = plan(retrieval.top_by_volume(flow(spark, SF_DIR)))
    assert text.count("Exchange hashpartitioning") == 1


def test_sketches_make_no_copies_of_rows(spark):
    table = flow(spark, SF_DIR)
    for analysis in (patterns.monthly_trends, patterns.quarterly_activity):
        assert "Expand" not in plan(analysis(table, approximate=True))
        exact = plan(analysis(table))
        # The copies are made of rows that are brought down already.
        assert exact.index("Expand") < exact.rindex("partial_sum")


def test_near_drops_meet_by_equal_bins(spark):
    text = plan(questions.spike_codrop_cases(flow(spark, SF_DIR), "SMALL", spike_by="pipeline", within_days=2))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "__left_bin" in text


def test_stored_order_is_cut_before_the_shuffle(spark):
    text = plan(quality.rule_violation_examples(flow(spark, SF_DIR), "SMALL", "receipts", stored=True))
    assert "TakeOrderedAndProject" in text and "row_index" in text


def test_equal_rows_are_told_apart_in_one_shuffle(spark, monkeypatch):
    from registry import flow_view

    monkeypatch.setattr(flow_view, "RANGE_ROWS", 1000)
    rows = flow_view.flow_rows(spark, SF_DIR).localCheckpoint()
    marked = flow_view.told_apart(rows)
    text = plan(marked)
    assert text.count("Exchange ") == 1 and "Exchange rangepartitioning" in text
    assert marked.where("not again").count() == rows.dropDuplicates().count()
    assert marked.count() == rows.count() > marked.where("not again").count()


def test_flow_table_is_written_by_ranges_of_bounded_size(spark, monkeypatch):
    from registry import flow_view

    monkeypatch.setattr(flow_view, "RANGE_ROWS", 500)
    rows = flow_view.flow_rows(spark, SF_DIR).localCheckpoint()
    sizes = [r["count"] for r in flow_view.told_apart(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > rows.count() // 600 and max(sizes) < 1500


def test_customers_meet_orders_before_lines(spark):
    from registry.flow_view import flow_rows

    text = flow_rows(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    depth = {t: next(len(x) - len(x.lstrip(" :")) for x in text.splitlines() if k in x and "Relation" in x)
             for t, k in (("lines", "l_orderkey"), ("orders", "o_orderkey"), ("customers", "c_custkey"))}
    assert depth["orders"] == depth["customers"] > depth["lines"]


@pytest.mark.parametrize("rows_a_task", [100, 10**9])
def test_lines_meet_orders_in_tasks_of_bounded_size(spark, monkeypatch, rows_a_task):
    from registry import flow_view

    whole = flow_view.flow_rows(spark, SF_DIR)
    monkeypatch.setattr(flow_view, "JOIN_ROWS", rows_a_task)
    rows = flow_view.flow_rows(spark, SF_DIR)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    dealt = re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", plan(rows))
    assert (int(dealt.group(1)) >= lines // 100) if rows_a_task == 100 else dealt is None
    assert rows.exceptAll(whole).isEmpty() and whole.exceptAll(rows).isEmpty()


def test_activity_is_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    from flowgauge import table as tables

    table = flow(spark, SF_DIR)
    for analysis in (patterns.monthly_trends, patterns.quarterly_activity):
        monkeypatch.setattr(tables, "TASK_ROWS", 10**9)
        whole = analysis(table, last=None)
        monkeypatch.setattr(tables, "TASK_ROWS", 100)
        dealt = analysis(table, last=None)
        text = plan(dealt)
        # Nothing is grouped where files are read.
        assert "REPARTITION_BY_NUM" in text and "Aggregate" not in text[text.rindex("REPARTITION_BY_NUM"):]
        assert dealt.exceptAll(whole).isEmpty() and dealt.count() == whole.count() > 0


def test_conflict_values_are_those_of_the_shown_entities_only(spark, monkeypatch):
    from flowgauge import table as tables

    table, keys = flow(spark, SF_DIR), ["pipeline", "location"]
    monkeypatch.setattr(tables, "TASK_ROWS", 10**9)
    whole = quality.entity_conflict_details(table, keys, ["state", "county_name"], limit=3, max_values=2)
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    dealt = quality.entity_conflict_details(table, keys, ["state", "county_name"], limit=3, max_values=2)
    text = plan(dealt)
    # Rows are cut to these entities before they are brought down to their values.
    assert "BroadcastHashJoin" in text[text.rindex("HashAggregate(keys=[dimension"):]
    assert "REPARTITION_BY_NUM" in text
    listed = quality.entity_conflict_values(table, keys, ["state", "county_name"])
    shown = {(r.dimension, r.pipeline_name, r.loc_name): (r.n_values, r["values"]) for r in dealt.collect()}
    assert shown == {(r.dimension, r.pipeline_name, r.loc_name): (r.n_values, r["values"]) for r in whole.collect()}
    for (dimension, pipeline, location), (n, values) in shown.items():
        of_entity = sorted(r.value for r in listed.where(
            (F.col("dimension") == dimension) & (F.col("pipeline_name") == pipeline) & (F.col("loc_name") == location)
        ).collect())
        assert n == len(of_entity) > 1 and values == of_entity[:2]
