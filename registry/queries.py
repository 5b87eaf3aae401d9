"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge import FlowTable
from flowgauge.functions.sketches import relative_error
from flowgauge.operators import anomaly, clustering, patterns, profile, quality, retrieval
from flowgauge.plans import questions
from flowgauge.session import shared_folder
from flowgauge.sources import DistinctStore, ParsedTimes, parse_times, table_size
from registry.flow_view import FLOW_SCHEMA, events, flow, flow_in_place, flow_rows, stored_flow, text_time_rows

Query = Callable[[SparkSession, str], DataFrame]

YEAR = 1997
YEARS = (1995, 2001)
CUTOFF = "1998-07-01"
SECOND_PART = "1998-01-01"
STATE = "NATION_3"
PIPELINE = "Supplier#000000003"
CATEGORY = "SMALL"
PARTNERS = ("connecting_pipeline", "connecting_entity")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round derived statistics, so that the last bits of two engines need not agree."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _joined(df: DataFrame, column: str) -> DataFrame:
    """Show an array as text."""
    return df.withColumn(column, F.array_join(column, "|"))


def _on_flow(analysis: Callable[[FlowTable], DataFrame]) -> Query:
    return lambda spark, sf_dir: analysis(flow(spark, sf_dir))


def _in_place(analysis: Callable[[FlowTable], DataFrame]) -> Query:
    """On a table without a distinct copy: duplicates are removed within the query."""
    return lambda spark, sf_dir: analysis(flow_in_place(spark, sf_dir))


def _on_events(analysis: Callable[[FlowTable], DataFrame]) -> Query:
    return lambda spark, sf_dir: analysis(events(spark, sf_dir))


def _correlation(grain: str, x_metric: str = "active_locations") -> Query:
    return _on_flow(lambda t: _rounded(
        patterns.calculate_correlation(t, x_metric, "volume", grain=grain),
        "r", "r_squared", "slope", "intercept", "t_statistic",
    ))


def _before_after(grain: str, metric: str = "volume") -> Query:
    return _on_flow(lambda t: _rounded(
        patterns.before_after_periods(t, CUTOFF, metric=metric, grain=grain), "mean_value"
    ))


_fitted: dict[tuple, clustering.Clustering] = {}
_fit_lock = Lock()


def _clustering(spark: SparkSession, sf_dir: str) -> clustering.Clustering:
    """One fit for all cluster queries on one state of the flow table."""
    table = flow(spark, sf_dir)
    key = (spark.sparkContext.applicationId, *table.raw.inputFiles()[:1])
    with _fit_lock:
        if key not in _fitted:
            _fitted[key] = clustering.perform_clustering(
                table, "pipeline", n_clusters=3, filters={"year": YEAR}
            )
    return _fitted[key]


def forget_fits() -> None:
    """Let the next cluster query fit again."""
    with _fit_lock:
        _fitted.clear()


_RETRIEVAL: dict[str, Query] = {
    "table_size": _on_flow(table_size),
    "profile_columns": _on_flow(profile.profile_columns),
    "profile_shape": _on_flow(profile.profile_shape),
    "category_values": _on_flow(lambda t: profile.distinct_values(t, "category")),
    "total_volume": _on_flow(lambda t: retrieval.total_volume(t, YEAR)),
    "unique_pipelines": _on_flow(retrieval.unique_count),
    "top_state_by_activity": _on_flow(retrieval.top_by_activity),
    "top_pipelines_by_volume": _on_flow(retrieval.top_by_volume),
    "average_quantity": _on_flow(
        lambda t: _rounded(retrieval.average_quantity(t), "avg_quantity", "median_quantity")
    ),
    "direction_counts": _on_flow(retrieval.direction_counts),
    "net_flows_by_pipeline": _on_flow(lambda t: retrieval.net_flows(t, YEAR)),
    "net_flows_by_state": _on_flow(lambda t: retrieval.net_flows(t, YEAR, "state", None)),
    "top_locations_sum": _on_flow(lambda t: retrieval.top_locations(t, YEAR, "deliveries")),
    "top_locations_mean": _on_flow(lambda t: _rounded(
        retrieval.top_locations(t, YEAR, "receipts", metric="mean"), "value"
    )),
    "top_locations_count": _on_flow(
        lambda t: retrieval.top_locations(t, YEAR, by="counterparty", metric="count")
    ),
    "top_locations_average_daily": _on_flow(lambda t: _rounded(
        retrieval.top_locations(t, YEAR, "receipts", metric="average_daily"), "value"
    )),
    "multi_dim_monthly_sum": _on_flow(lambda t: retrieval.aggregate_dimensions(
        t, YEAR, ["category", "state"], time_period="monthly", limit=None
    )),
    "multi_dim_daily_count": _on_flow(lambda t: retrieval.aggregate_dimensions(
        t, YEAR, ["category"], time_period="daily", metric="count", limit=None
    )),
    "multi_dim_quarterly_mean": _on_flow(lambda t: _rounded(retrieval.aggregate_dimensions(
        t, YEAR, ["state"], time_period="quarterly", metric="mean", limit=None
    ), "value")),
    "multi_dim_seasonal_mean": _on_flow(lambda t: _rounded(retrieval.aggregate_dimensions(
        t, YEAR, ["county_name"], time_period="seasonal", metric="mean"
    ), "value")),
    "multi_dim_weekly_sum": _on_flow(lambda t: retrieval.aggregate_dimensions(
        t, YEAR, ["state"], time_period="weekly", limit=None
    )),
    "multi_dim_notime_sum": _on_flow(lambda t: retrieval.aggregate_dimensions(
        t, YEAR, ["pipeline", "county_name"]
    )),
    "filter_rank_sum": _on_flow(lambda t: retrieval.filter_and_rank(
        t, {"state": STATE, "year": YEAR, "transaction_type": "deliveries"},
        "counterparties", limit=5,
    )),
    "filter_rank_mean": _on_flow(lambda t: _rounded(retrieval.filter_and_rank(
        t, {"category": CATEGORY, "country_name": "AFRICA"}, "location", metric="average"
    ), "value")),
    "filter_rank_count": _on_flow(lambda t: retrieval.filter_and_rank(
        t, {"pipeline": PIPELINE}, "county_name", metric="count"
    )),
    "filter_rank_season": _on_flow(lambda t: retrieval.filter_and_rank(
        t, {"season": "winter", "years": (1996, 1999)}, "state", limit=None
    )),
    "filter_rank_month": _on_flow(lambda t: retrieval.filter_and_rank(
        t, {"month": 3}, "pipeline", limit=None
    )),
    "filter_rank_nothing": _on_flow(lambda t: retrieval.filter_and_rank(
        t, {"state": "NOWHERE"}, "pipeline", limit=None
    )),
    "filter_row_counts": _on_flow(lambda t: retrieval.row_counts(
        t, {"state": STATE, "year": YEAR, "transaction_type": "deliveries"}, dedup=True
    )),
    "filter_rank_day": _on_flow(lambda t: retrieval.filter_and_rank(
        t, {"eff_gas_day": "1997-06-10"}, "pipeline", limit=None
    )),
    "time_series_daily_sum": _on_flow(retrieval.time_series),
    "time_series_weekly_sum": _on_flow(lambda t: retrieval.time_series(t, grain="weekly")),
    "time_series_monthly_net_flow": _on_flow(lambda t: retrieval.time_series(
        t, {"state": STATE}, grain="monthly", metric="net_flow"
    )),
    "time_series_yearly_mean": _on_flow(lambda t: _rounded(
        retrieval.time_series(t, grain="yearly", metric="mean"), "value"
    )),
    "time_series_monthly_count": _on_flow(lambda t: retrieval.time_series(
        t, {"category": CATEGORY}, grain="monthly", metric="count"
    )),
    "time_series_peaks": _on_flow(
        lambda t: retrieval.time_series_peaks(retrieval.time_series(t, {"year": YEAR}))
    ),
    "time_series_summary": _on_flow(lambda t: _rounded(
        retrieval.time_series_summary(retrieval.time_series(t, {"year": YEAR})), "mean_value"
    )),
    "compare_years_sum": _on_flow(lambda t: _rounded(
        retrieval.compare_years(t, *YEARS), "yoy_change"
    )),
    "compare_years_share": _on_flow(lambda t: _rounded(
        retrieval.compare_years(t, *YEARS, by="county_name", metric="percentage_share"),
        "value", "yoy_change",
    )),
    "compare_years_totals": _on_flow(lambda t: retrieval.compare_years_totals(
        retrieval.compare_years(t, *YEARS, by="county_name")
    )),
}

_PATTERNS: dict[str, Query] = {
    "seasonal_patterns": _on_flow(patterns.seasonal_patterns),
    "monthly_trends": _on_flow(
        lambda t: _rounded(patterns.monthly_trends(t, last=None), "volume_growth")
    ),
    "monthly_trends_summary": _on_flow(
        lambda t: _rounded(patterns.monthly_trends_summary(t), "average_growth")
    ),
    "consistent_pipelines": _on_flow(lambda t: _rounded(
        patterns.consistent_pipelines(t),
        "mean_monthly_volume", "std_monthly_volume", "cv_pct", "score",
    )),
    "consistency_coverage": _on_flow(patterns.consistency_coverage),
    "direction_balance_monthly": _on_flow(lambda t: patterns.direction_balance(t, last=None)),
    "direction_balance_summary": _on_flow(lambda t: _rounded(
        patterns.direction_balance_summary(t),
        "correlation", "average_net_flow", "net_flow_volatility",
    )),
    "quarterly_activity": _on_flow(lambda t: _rounded(
        patterns.quarterly_activity(t, last=None), "volume_growth", "location_growth"
    )),
    "quarterly_activity_summary": _on_flow(lambda t: _rounded(
        patterns.quarterly_activity_summary(t),
        "average_volume_growth", "average_location_growth",
    )),
    "correlation_daily": _correlation("daily"),
    "correlation_weekly": _correlation("weekly"),
    "correlation_monthly": _correlation("monthly"),
    "correlation_quarterly": _correlation("quarterly"),
    "correlation_quarterly_transactions": _correlation("quarterly", "transaction_count"),
    "correlation_points": _on_flow(lambda t: _rounded(patterns.correlation_points(
        t, "unique_entities", "average_quantity", grain="monthly",
        filters={"state": STATE, "transaction_type": "receipts"},
    ), "y")),
    "before_after_daily": _before_after("daily"),
    "before_after_weekly": _before_after("weekly"),
    "before_after_monthly": _before_after("monthly"),
    "before_after_transactions": _before_after("monthly", "transaction_count"),
    "before_after_locations": _before_after("monthly", "unique_locations"),
    "before_after_average": _before_after("monthly", "average_quantity"),
    "correlation_monthly_pipelines": _correlation("monthly", "unique_pipelines"),
    "before_after_ttest": _on_flow(lambda t: _rounded(
        patterns.before_after_ttest(
            t, CUTOFF, filters={"pipeline": PIPELINE, "transaction_type": "receipts"}
        ),
        "before_mean", "after_mean", "absolute_change", "percentage_change",
        "t_statistic", "p_value",
    )),
    "profile_monthly": _on_flow(lambda t: clustering.seasonal_profiles(
        t, "location", filters={"year": YEAR}
    )),
    "profile_quarterly": _on_flow(lambda t: clustering.seasonal_profiles(
        t, "pipeline", grain="quarterly"
    )),
    "profile_weekly": _on_flow(lambda t: clustering.seasonal_profiles(
        t, "state", grain="weekly"
    )),
    "cluster_assignments": lambda spark, sf_dir: _clustering(spark, sf_dir).assignments,
    "cluster_statistics": lambda spark, sf_dir: _joined(
        _clustering(spark, sf_dir).statistics, "sample_members"
    ),
    "cluster_checks": lambda spark, sf_dir: clustering.cluster_checks(
        _clustering(spark, sf_dir), "pipeline_name"
    ),
    "cluster_quality": lambda spark, sf_dir: _clustering(spark, sf_dir).quality,
}

_QUALITY: dict[str, Query] = {
    "rule_violations": _on_flow(lambda t: quality.rule_violations(t, CATEGORY, "receipts")),
    "rule_violations_filtered": _on_flow(lambda t: quality.rule_violations(
        t, CATEGORY, "receipts", filters={"state": STATE}
    )),
    "rule_violation_examples": _on_flow(
        lambda t: quality.rule_violation_examples(t, CATEGORY, "receipts")
    ),
    "rule_violations_by_pipeline": _on_flow(
        lambda t: quality.rule_violations_by(t, CATEGORY, "receipts", limit=None)
    ),
    "completeness_all_missing": _on_flow(
        lambda t: quality.completeness(t, CATEGORY, PARTNERS)
    ),
    "completeness_any_missing": _on_flow(
        lambda t: quality.completeness(t, CATEGORY, PARTNERS, "any_missing")
    ),
    "completeness_examples": _on_flow(lambda t: _joined(
        quality.completeness_examples(t, CATEGORY, PARTNERS, "any_missing"), "missing_fields"
    )),
    "entity_conflicts": _on_flow(lambda t: quality.entity_conflicts(
        t, ["pipeline", "location"], ["state", "county_name"]
    )),
    "entity_conflict_details": _on_flow(lambda t: _joined(quality.entity_conflict_details(
        t, ["pipeline", "location"], ["state", "county_name"]
    ), "values")),
    "entity_conflict_values": _on_flow(lambda t: quality.entity_conflict_values(
        t, ["location"], ["state", "county_name"]
    )),
    "anomaly_zscore": _on_flow(lambda t: _rounded(anomaly.anomaly_zscore(t, 1.5), "zscore")),
    "anomaly_zscore_count": _on_flow(lambda t: anomaly.anomaly_zscore_count(t, 1.5)),
    "anomaly_rolling_location": _on_flow(lambda t: _rounded(
        anomaly.anomaly_rolling(t), "roll_mean", "roll_std", "zscore"
    )),
    "anomaly_rolling_total": _on_flow(lambda t: _rounded(
        anomaly.anomaly_rolling(t, "total"), "roll_mean", "roll_std", "zscore"
    )),
    "anomaly_rolling_calendar": _on_flow(lambda t: _rounded(
        anomaly.anomaly_rolling(t, "state", frame="days", include_current=False),
        "roll_mean", "roll_std", "zscore",
    )),
    "anomaly_change_location": _on_flow(lambda t: _rounded(
        anomaly.anomaly_change(t), "recent_avg", "pct_change"
    )),
    "anomaly_rolling_filtered": _on_flow(lambda t: _rounded(
        anomaly.anomaly_rolling(t, "state", filters={"category": CATEGORY}),
        "roll_mean", "roll_std", "zscore",
    )),
    "anomaly_change_limited": _on_flow(lambda t: _rounded(
        anomaly.anomaly_change(t, limit=10), "recent_avg", "pct_change"
    )),
    "anomaly_change_total": _on_flow(lambda t: _rounded(
        anomaly.anomaly_change(t, "total"), "recent_avg", "pct_change"
    )),
    "anomaly_percentile_location": _on_flow(lambda t: _rounded(
        anomaly.anomaly_percentile(t), "roll_percentile"
    )),
    "anomaly_percentile_total": _on_flow(lambda t: _rounded(
        anomaly.anomaly_percentile(t, "total"), "roll_percentile"
    )),
    "anomaly_top_examples": _on_flow(lambda t: _rounded(
        anomaly.anomaly_rolling(t, "pipeline", limit=10), "roll_mean", "roll_std", "zscore"
    )),
}

_QUESTIONS: dict[str, Query] = {
    "hhi_concentration": _on_flow(lambda t: _rounded(
        questions.concentration(t, filters={"pipeline": PIPELINE}), "hhi"
    )),
    "quantile_buckets": _on_flow(questions.quantile_buckets),
    "winter_vs_summer": _on_flow(lambda t: _rounded(
        questions.winter_vs_summer(t, filters={"category": CATEGORY}),
        "winter_mean", "summer_mean", "difference_pct",
    )),
    "winter_summer_ttest": _on_flow(lambda t: _rounded(
        questions.winter_summer_ttest(t, filters={"category": CATEGORY}),
        "winter_mean", "summer_mean", "t_statistic", "p_value",
    )),
    "partner_start_effect": _on_flow(lambda t: _rounded(
        questions.partner_start_effect(t, CATEGORY, partner="connecting_pipeline"),
        "mean_before", "mean_after", "change",
    )),
    "spike_codrop_cases": _on_flow(lambda t: _rounded(
        questions.spike_codrop_cases(t, CATEGORY, spike_by="pipeline", z_threshold=2.0),
        "zscore", "pct_change",
    )),
    "null_share_by_group": _on_flow(lambda t: _rounded(
        profile.null_share(t, ["latitude", "longitude", "county_name"], "state"),
        "latitude_missing_pct", "longitude_missing_pct", "county_name_missing_pct",
    )),
    "top_locations_per_direction": _on_flow(lambda t: _rounded(
        retrieval.top_locations_per_direction(t, YEAR), "value"
    )),
    "peak_net_flow_days": _on_flow(lambda t: retrieval.time_series_peaks(
        retrieval.time_series(t, {"pipeline": PIPELINE, "year": YEAR}, metric="net_flow"), 5
    )),
    "net_flow_sources_and_sinks": _on_flow(
        lambda t: retrieval.net_flow_sources_and_sinks(t, YEAR)
    ),
}

def _grown(spark: SparkSession, sf_dir: str) -> DistinctStore:
    """The distinct copy of a table that came in two parts; the second repeats rows of the first."""
    folder = f"{shared_folder(spark)}/grown-{uuid.uuid4().hex}"
    rows = flow_rows(spark, sf_dir)
    store = DistinctStore(spark, f"{folder}/rows", f"{folder}/store", schema=FLOW_SCHEMA)
    rows.where(F.col("eff_gas_day") < CUTOFF).write.parquet(f"{folder}/rows")
    store.grow()
    rows.where(F.col("eff_gas_day") >= SECOND_PART).write.mode("append").parquet(f"{folder}/rows")
    store.grow()
    return store


def _text_times(spark: SparkSession, sf_dir: str) -> ParsedTimes:
    folder = f"{shared_folder(spark)}/times-{uuid.uuid4().hex}"
    return parse_times(text_time_rows(spark, sf_dir), folder, formats=["dd/MM/yyyy"])


def _text_time_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _text_times(spark, sf_dir).counts
    return spark.createDataFrame([tuple(counts.items())[k] for k in range(len(counts))], "name string, n long")


def _sketch_check(grain: str) -> Query:
    """Exact numbers of active entities, and whether the estimates from daily sketches are within
    three standard errors."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = flow(spark, sf_dir)
        analysis = patterns.monthly_trends if grain == "monthly" else patterns.quarterly_activity
        names = ("active_locations", "active_pipelines", "active_partners")
        exact = analysis(table, last=None).select("period", "total_volume", *names)
        near = analysis(table, last=None, approximate=True).select(
            "period", F.col("total_volume").alias("volume"), *(F.col(n).alias(f"near_{n}") for n in names))
        bound = 3 * relative_error()
        return exact.join(near, "period").select(
            "period", (F.col("total_volume") == F.col("volume")).alias("same_volume"), *names,
            *((F.abs(F.col(f"near_{n}") - F.col(n)) <= F.ceil(F.col(n) * bound)).alias(f"{n}_within") for n in names),
        )
    return query


_ROBUST: dict[str, Query] = {
    "text_times_daily": lambda spark, sf_dir: retrieval.time_series(_text_times(spark, sf_dir).table),
    "text_times_rows": lambda spark, sf_dir: _text_times(spark, sf_dir).table.raw,
    "text_times_quarantined": lambda spark, sf_dir: _text_times(spark, sf_dir).quarantine,
    "text_times_counts": _text_time_counts,
    "monthly_sketches": _sketch_check("monthly"),
    "quarterly_sketches": _sketch_check("quarterly"),
    "rule_violations_stored_order": lambda spark, sf_dir: quality.rule_violation_examples(
        stored_flow(spark, sf_dir), CATEGORY, "receipts", limit=25, stored=True
    ),
    "completeness_stored_order": lambda spark, sf_dir: _joined(quality.completeness_examples(
        stored_flow(spark, sf_dir), CATEGORY, PARTNERS, "any_missing", limit=25, stored=True
    ), "missing_fields"),
    "silhouette_by_state": _on_flow(lambda t: _rounded(
        clustering.profile_silhouettes(t, "pipeline", "state", filters={"year": YEAR}),
        "own_distance", "other_distance", "silhouette",
    )),
    "spike_codrop_near": _on_flow(lambda t: _rounded(
        questions.spike_codrop_cases(
            t, CATEGORY, spike_by="pipeline", z_threshold=2.0, within_days=2, cases=10),
        "zscore", "pct_change",
    )),
}

_GROWN: dict[str, Query] = {
    "distinct_rows_grown": lambda spark, sf_dir: _grown(spark, sf_dir).rows(),
    "distinct_growth_log": lambda spark, sf_dir: _grown(spark, sf_dir).log().drop("files", "buckets_touched"),
}

_IN_PLACE: dict[str, Query] = {
    "distinct_rows": _in_place(lambda t: t.rows(dedup=True)),
    "profile_shape_in_place": _in_place(profile.profile_shape),
    "net_flows_by_state_in_place": _in_place(
        lambda t: retrieval.net_flows(t, YEAR, "state", None)
    ),
}

_EVENTS: dict[str, Query] = {
    "events_monthly_sum": _on_events(lambda t: _rounded(
        retrieval.time_series(t, grain="monthly"), "value"
    )),
    "events_top_users": _on_events(lambda t: _rounded(
        retrieval.top_by_volume(t, "user_id"), "total_volume"
    )),
    "events_average_quantity": _on_events(lambda t: _rounded(
        retrieval.average_quantity(t), "avg_quantity", "median_quantity"
    )),
    "events_anomaly_rolling": _on_events(lambda t: _rounded(
        anomaly.anomaly_rolling(t, "category", days=7, threshold=1.5),
        "quantity", "roll_mean", "roll_std", "zscore",
    )),
}


#: Queries that write what they read anew each time.
WRITING = frozenset(_GROWN) | {n for n in _ROBUST if n.startswith("text_times") or n.endswith("stored_order")}


@cache
def all_queries() -> dict[str, Query]:
    return {**_RETRIEVAL, **_PATTERNS, **_QUALITY, **_QUESTIONS, **_ROBUST, **_GROWN, **_IN_PLACE, **_EVENTS}
