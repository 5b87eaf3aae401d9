"""DuckDB SQL for each registered query, written from the definition of the analysis."""

from __future__ import annotations

from registry.flow_view import FLOW_CTE

_SEASON = """CASE WHEN month({t}) IN (12, 1, 2) THEN 'Winter' WHEN month({t}) IN (3, 4, 5) THEN 'Spring'
  WHEN month({t}) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""
SEASON = _SEASON.format(t="eff_gas_day")
DAY = "CAST(eff_gas_day AS DATE)"
MONTH = "CAST(date_trunc('month', eff_gas_day) AS DATE)"
WEEK = "CAST(date_trunc('week', eff_gas_day) AS DATE)"
QUARTER = "CAST(date_trunc('quarter', eff_gas_day) AS DATE)"
Q = "scheduled_quantity"
NET = "scheduled_quantity * rec_del_sign"
IN_1997 = "eff_gas_day >= TIMESTAMP '1997-01-01' AND eff_gas_day < TIMESTAMP '1998-01-01'"

COLUMNS = {
    "pipeline_name": "string", "loc_name": "string", "connecting_pipeline": "string",
    "connecting_entity": "string", "rec_del_sign": "int", "category_short": "string",
    "country_name": "string", "state_abb": "string", "county_name": "string",
    "latitude": "string", "longitude": "string", "eff_gas_day": "timestamp_ntz",
    "scheduled_quantity": "double",
}


def _flow(query: str, *ctes: str) -> str:
    """A query over ``raw`` (all rows) and ``flow`` (distinct rows)."""
    return "WITH " + ",".join([FLOW_CTE, *ctes]) + query


def _events(query: str, *ctes: str) -> str:
    head = "events_flow AS (SELECT DISTINCT * FROM events)"
    return "WITH " + ", ".join([head, *ctes]) + " " + query


def _profile_columns() -> str:
    kinds = {"string": "categorical", "int": "numeric", "double": "numeric"}
    parts = [
        f"SELECT '{c}' AS name, '{kind}' AS dtype, '{kinds.get(kind, 'other')}' AS kind, "
        f"count(*) - count({c}) AS missing_count, "
        f"round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct FROM raw"
        for c, kind in COLUMNS.items()
    ]
    return _flow(" UNION ALL ".join(parts))


def _series(period: str, value: str, where: str = "TRUE") -> str:
    return f"SELECT {period} AS period, {value} AS value FROM flow WHERE {where} GROUP BY 1"


def _profile_rows(by: str, part: str, periods: int, where: str = "TRUE") -> str:
    return _flow(
        """SELECT g.{by}, CAST(p.period AS INTEGER) AS period, coalesce(s.volume, 0.0) AS volume
        FROM (SELECT {by} FROM sums GROUP BY 1 HAVING max(abs(volume)) > 0) g
        CROSS JOIN range(1, {end}) p(period)
        LEFT JOIN sums s ON s.{by} = g.{by} AND s.part = p.period"""
        .format(by=by, end=periods + 1),
        f"sums AS (SELECT {by}, {part}(eff_gas_day) AS part, sum({Q}) AS volume FROM flow "
        f"WHERE {where} AND {by} IS NOT NULL GROUP BY 1, 2)",
    )


def _activity(period: str) -> str:
    return (
        f"activity AS (SELECT {period} AS period, round_even(sum({Q}), 2) AS total_volume, "
        f"round_even(avg({Q}), 2) AS average_volume, count({Q}) AS transaction_count, "
        "count(DISTINCT loc_name) AS active_locations, "
        "count(DISTINCT pipeline_name) AS active_pipelines, "
        "count(DISTINCT connecting_entity) AS active_partners FROM flow GROUP BY 1), "
        "grown AS (SELECT *, "
        "100 * (total_volume / nullif(lag(total_volume) OVER (ORDER BY period), 0) - 1) "
        "AS volume_growth, "
        "100 * (active_locations / nullif(lag(active_locations) OVER (ORDER BY period), 0) - 1) "
        "AS location_growth FROM activity)"
    )


def _correlation(period: str, x: str = "count(DISTINCT loc_name)") -> str:
    varies = "var_samp(x) > 0 AND var_samp(y) > 0"
    return _flow(
        """SELECT points, round(r, 6) AS r, round(r * r, 6) AS r_squared,
          round(slope, 6) AS slope, round(intercept, 6) AS intercept,
          round(t, 6) AS t_statistic, (1 - r * r <= 1e-12 OR abs(t) > 2) AS significant,
          CASE WHEN abs(r) > 0.8 THEN 'Very Strong' WHEN abs(r) > 0.6 THEN 'Strong'
            WHEN abs(r) > 0.4 THEN 'Moderate' WHEN abs(r) > 0.2 THEN 'Weak'
            WHEN r IS NOT NULL THEN 'Very Weak' END AS strength,
          CASE WHEN r > 0 THEN 'Positive' WHEN r IS NOT NULL THEN 'Negative' END AS direction
        FROM (SELECT *, CASE WHEN 1 - r * r > 1e-12 AND points > 2
          THEN r * sqrt((points - 2) / (1 - r * r)) END AS t FROM fitted)""",
        f"points AS (SELECT {period} AS period, {x} AS x, sum({Q}) AS y FROM flow GROUP BY 1)",
        f"fitted AS (SELECT count(*) AS points, CASE WHEN {varies} THEN corr(y, x) END AS r, "
        "CASE WHEN var_samp(x) > 0 THEN regr_slope(y, x) END AS slope, "
        "CASE WHEN var_samp(x) > 0 THEN regr_intercept(y, x) END AS intercept FROM points)",
    )


def _sides(period: str, where: str = "TRUE", metric: str = f"sum({Q})") -> str:
    return (
        "sides AS (SELECT CASE WHEN eff_gas_day < TIMESTAMP '1998-07-01' THEN 'before' "
        f"ELSE 'after' END AS side, {period} AS period, {metric} AS value, "
        f"count(*) AS row_count, min({DAY}) AS first_day, max({DAY}) AS last_day "
        f"FROM flow WHERE {where} GROUP BY 1, 2)"
    )


def _before_after(period: str, metric: str = f"sum({Q})") -> str:
    return _flow(
        "SELECT side, round(avg(value), 6) AS mean_value, count(*) AS periods, "
        "CAST(sum(row_count) AS BIGINT) AS row_count, min(first_day) AS first_day, "
        "max(last_day) AS last_day FROM sides GROUP BY 1",
        _sides(period, metric=metric),
    )


def _p_value(tests: str, keys: str) -> str:
    """Two-sided p by Simpson's rule over the angle: with T = sqrt(df) * tan(a) the density of
    Student's t becomes cos(a) ^ (df - 1), up to a factor that cancels."""
    return (
        f"simpson AS (SELECT {keys}, "
        "CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight, "
        "pow(abs(cos(start + i * (pi() / 2 - start) / 20000)), df - 1) * (pi() / 2 - start) AS f_tail, "
        "pow(abs(cos(i * (pi() / 2) / 20000)), df - 1) * (pi() / 2) AS f_all "
        f"FROM (SELECT *, atan(abs(t) / sqrt(df)) AS start FROM {tests}), range(0, 20001) r(i)), "
        f"p_values AS (SELECT {keys}, sum(weight * f_tail) / sum(weight * f_all) AS p "
        f"FROM simpson GROUP BY {keys})"
    )


def _daily(by: str, source: str = "flow", where: str = "TRUE") -> str:
    return (
        f"daily AS (SELECT {by}, {DAY} AS day, sum({Q}) AS quantity FROM {source} "
        f"WHERE {where} GROUP BY ALL)"
    )


def _rolling(keys: str, frame: str = "ORDER BY day ROWS BETWEEN 89 PRECEDING AND CURRENT ROW",
             source: str = "daily", percentile: bool = False, name: str = "rolled") -> str:
    window = f"(PARTITION BY {keys} {frame})"
    quantile = f", quantile_cont(quantity, 0.95) OVER {window} AS roll_percentile" if percentile else ""
    return (
        f"{name} AS MATERIALIZED (SELECT *, count(quantity) OVER {window} AS filled, "
        f"avg(quantity) OVER {window} AS roll_mean, "
        f"stddev_samp(quantity) OVER {window} AS roll_std{quantile} FROM {source})"
    )


def _anomaly_rolling(
    by: str, keys: str, frame: str | None = None, tail: str = "", where: str = "TRUE"
) -> str:
    rolled = _rolling(keys) if frame is None else _rolling(keys, frame)
    return _flow(
        f"SELECT {keys}, day, quantity, round(roll_mean, 6) AS roll_mean, "
        "round(roll_std, 6) AS roll_std, "
        "round((quantity - roll_mean) / nullif(roll_std, 0), 6) AS zscore FROM rolled "
        "WHERE filled >= 22 AND (quantity - roll_mean) / nullif(roll_std, 0) > 3 " + tail,
        _daily(by, where=where), rolled,
    )


def _anomaly_change(by: str, keys: str, tail: str = "") -> str:
    return _flow(
        f"SELECT {keys}, day, quantity, round(roll_mean, 6) AS recent_avg, "
        "round((quantity - roll_mean) / nullif(roll_mean, 0) * 100, 6) AS pct_change, "
        "CASE WHEN quantity > roll_mean THEN 'increase' ELSE 'decrease' END AS kind "
        "FROM rolled WHERE filled >= 22 AND "
        "(abs((quantity - roll_mean) / nullif(roll_mean, 0) * 100) > 50 "
        "OR (roll_mean = 0 AND quantity <> 0)) " + tail,
        _daily(by, "raw"), _rolling(keys),
    )


def _anomaly_percentile(by: str, keys: str) -> str:
    return _flow(
        f"SELECT {keys}, day, quantity, round(roll_percentile, 6) AS roll_percentile "
        "FROM rolled WHERE filled >= 22 AND quantity > roll_percentile",
        _daily(by), _rolling(keys, percentile=True),
    )


def _top(by: str, value: str, where: str, limit: int | None = 10, source: str = "flow",
         name: str = "value") -> str:
    tail = "" if limit is None else f" ORDER BY {name} DESC, {by} LIMIT {limit}"
    return _flow(
        f"SELECT {by}, {value} AS {name} FROM {source} WHERE {by} IS NOT NULL AND {where} "
        f"GROUP BY {by}{tail}"
    )


def _dimensions(keys: dict[str, str], value: str, source: str = "flow",
                limit: int | None = None) -> str:
    named = ", ".join(f"{expr} AS {name}" for name, expr in keys.items())
    present = " AND ".join(f"{name} IS NOT NULL" for name in keys)
    order = "" if limit is None else f" ORDER BY value DESC, {', '.join(keys)} LIMIT {limit}"
    return _flow(
        f"SELECT {', '.join(keys)}, {value} AS value FROM "
        f"(SELECT *, {named} FROM {source} WHERE {IN_1997}) WHERE {present} "
        f"GROUP BY {', '.join(keys)}{order}"
        .replace("SELECT *, ", f"SELECT {Q}, ")
    )


def _years(by: str, value: str, change: str, metric: str = "sum") -> str:
    return _flow(
        f"SELECT CAST(year AS INTEGER) AS year, {by}, {value} AS value, {change} AS yoy_change "
        f"FROM (SELECT *, lag(value) OVER (PARTITION BY {by} ORDER BY year) AS previous "
        "FROM filled)",
        *_year_ctes(by, metric),
    )


def _year_ctes(by: str, metric: str) -> list[str]:
    value = "coalesce(s.volume, 0.0)"
    if metric == "percentage":
        value = "100 * coalesce(s.volume, 0.0) / nullif(w.whole, 0)"
    span = ("eff_gas_day >= TIMESTAMP '1995-01-01' AND eff_gas_day < TIMESTAMP '2002-01-01'")
    return [
        f"sums AS (SELECT year(eff_gas_day) AS year, {by}, sum({Q}) AS volume FROM flow "
        f"WHERE {span} AND {by} IS NOT NULL GROUP BY 1, 2)",
        f"wholes AS (SELECT year(eff_gas_day) AS year, sum({Q}) AS whole FROM flow "
        f"WHERE {span} GROUP BY 1)",
        f"filled AS (SELECT y.year, g.{by}, {value} AS value FROM "
        f"(SELECT DISTINCT year FROM sums) y CROSS JOIN (SELECT DISTINCT {by} FROM sums) g "
        f"LEFT JOIN sums s ON s.year = y.year AND s.{by} = g.{by} "
        "LEFT JOIN wholes w ON w.year = y.year)",
    ]


_MISSING = "({c} IS NULL OR {c} = '')"
NO_PARTNER_PIPELINE = _MISSING.format(c="connecting_pipeline")
NO_PARTNER = _MISSING.format(c="connecting_entity")


def _completeness(flagged: str) -> str:
    return _flow(
        "SELECT 'SMALL' AS category, count(*) AS total, "
        f"count(*) FILTER (WHERE {flagged}) AS incomplete, "
        f"round_even(100.0 * count(*) FILTER (WHERE {flagged}) / count(*), 1) AS pct "
        "FROM raw WHERE category_short = 'SMALL'"
    )


def _conflict_ctes(keys: str) -> list[str]:
    return [
        f"vals AS (SELECT DISTINCT 'state_abb' AS dimension, {keys}, state_abb AS value FROM raw "
        f"UNION ALL SELECT DISTINCT 'county_name', {keys}, county_name FROM raw)",
        f"counted AS (SELECT dimension, {keys}, count(value) AS n_values FROM vals "
        "GROUP BY ALL)",
    ]


def _ends() -> str:
    flows = (
        f"net AS (SELECT pipeline_name, sum({NET}) AS net_flow FROM flow WHERE {IN_1997} "
        "GROUP BY 1)"
    )
    def end(role: str, order: str, side: str) -> str:
        return (
            f"SELECT '{role}' AS role, CAST(row_number() OVER (ORDER BY net_flow {order}, "
            f"pipeline_name) AS INTEGER) AS position, pipeline_name, net_flow FROM net "
            f"WHERE net_flow {side} 0 QUALIFY position <= 5"
        )
    return _flow(f"{end('source', 'DESC', '>')} UNION ALL {end('sink', 'ASC', '<')}", flows)


def _retrieval() -> dict[str, str]:
    mean, count, total = f"avg({Q})", "count(*)", f"sum({Q})"
    return {
        "table_size": _flow("SELECT count(*) AS row_count, 13 AS column_count FROM raw"),
        "profile_columns": _profile_columns(),
        "profile_shape": _flow(
            "SELECT (SELECT count(*) FROM raw) AS row_count, 13 AS column_count, "
            "(SELECT count(*) FROM raw) - (SELECT count(*) FROM flow) AS duplicate_count, "
            "2 AS numeric_count, 10 AS categorical_count"
        ),
        "category_values": _flow(
            "SELECT DISTINCT category_short FROM raw WHERE category_short IS NOT NULL"
        ),
        "total_volume": _flow(
            f"SELECT 1997 AS year, coalesce(sum({Q}) FILTER (WHERE {IN_1997}), 0.0) "
            f"AS total_volume, count(*) FILTER (WHERE {IN_1997}) AS rows_after, "
            "count(*) AS rows_before FROM flow"
        ),
        "unique_pipelines": _flow("SELECT count(DISTINCT pipeline_name) AS unique_count FROM raw"),
        "top_state_by_activity": _top(
            "state_abb", count, "TRUE", 1, "raw", "activity_count"
        ),
        "top_pipelines_by_volume": _top(
            "pipeline_name", total, "TRUE", 10, "flow", "total_volume"
        ),
        "average_quantity": _flow(
            f"SELECT round(avg({Q}), 6) AS avg_quantity, round(median({Q}), 6) "
            "AS median_quantity FROM flow"
        ),
        "direction_counts": _flow(
            "SELECT rec_del_sign, count(*) AS row_count FROM raw "
            "WHERE rec_del_sign IS NOT NULL GROUP BY 1"
        ),
        "net_flows_by_pipeline": _top(
            "pipeline_name", f"sum({NET})", IN_1997, 20, name="net_flow"
        ),
        "net_flows_by_state": _top("state_abb", f"sum({NET})", IN_1997, None, name="net_flow"),
        "top_locations_sum": _top("loc_name", total, f"{IN_1997} AND rec_del_sign = -1"),
        "top_locations_mean": _top(
            "loc_name", f"round({mean}, 6)", f"{IN_1997} AND rec_del_sign = 1"
        ),
        "top_locations_count": _top("connecting_entity", count, IN_1997, source="raw"),
        "top_locations_average_daily": _flow(
            "SELECT loc_name, round(avg(quantity), 6) AS value FROM daily "
            "WHERE loc_name IS NOT NULL GROUP BY 1 ORDER BY avg(quantity) DESC, 1 LIMIT 10",
            _daily("loc_name", where=f"{IN_1997} AND rec_del_sign = 1"),
        ),
        "multi_dim_monthly_sum": _dimensions(
            {"time_period": "CAST(month(eff_gas_day) AS INTEGER)", "category_short": "category_short",
             "state_abb": "state_abb"}, total
        ),
        "multi_dim_daily_count": _dimensions(
            {"time_period": DAY, "category_short": "category_short"}, count, "raw"
        ),
        "multi_dim_quarterly_mean": _dimensions(
            {"time_period": "CAST(quarter(eff_gas_day) AS INTEGER)", "state_abb": "state_abb"},
            f"round({mean}, 6)"
        ),
        "multi_dim_seasonal_mean": _dimensions(
            {"time_period": SEASON, "county_name": "county_name"}, f"round({mean}, 6)",
            limit=20,
        ),
        "multi_dim_weekly_sum": _dimensions(
            {"time_period": WEEK, "state_abb": "state_abb"}, total
        ),
        "multi_dim_notime_sum": _dimensions(
            {"pipeline_name": "pipeline_name", "county_name": "county_name"}, total, limit=20
        ),
        "filter_rank_sum": _top(
            "connecting_entity", total,
            f"state_abb = 'NATION_3' AND rec_del_sign = -1 AND {IN_1997}", 5
        ),
        "filter_rank_mean": _top(
            "loc_name", f"round({mean}, 6)",
            "category_short = 'SMALL' AND country_name = 'AFRICA'"
        ),
        "filter_rank_count": _top(
            "county_name", count, "pipeline_name = 'Supplier#000000003'", source="raw"
        ),
        "filter_rank_season": _top(
            "state_abb", total,
            "month(eff_gas_day) IN (12, 1, 2) AND eff_gas_day >= TIMESTAMP '1996-01-01' "
            "AND eff_gas_day < TIMESTAMP '2000-01-01'", None
        ),
        "filter_rank_month": _top("pipeline_name", total, "month(eff_gas_day) = 3", None),
        "filter_rank_nothing": _top("pipeline_name", total, "state_abb = 'NOWHERE'", None),
        "filter_row_counts": _flow(
            "SELECT (SELECT count(*) FROM raw) AS rows_before, count(*) AS rows_after FROM flow "
            f"WHERE state_abb = 'NATION_3' AND rec_del_sign = -1 AND {IN_1997}"
        ),
        "filter_rank_day": _top("pipeline_name", total, f"{DAY} = DATE '1997-06-10'", None),
        "time_series_daily_sum": _flow(_series(DAY, total)),
        "time_series_weekly_sum": _flow(_series(WEEK, total)),
        "time_series_monthly_net_flow": _flow(
            _series(MONTH, f"sum({NET})", "state_abb = 'NATION_3'")
        ),
        "time_series_yearly_mean": _flow(
            _series("CAST(year(eff_gas_day) AS INTEGER)", f"round({mean}, 6)")
        ),
        "time_series_monthly_count": _flow(
            _series(MONTH, count, "category_short = 'SMALL'")
        ),
        "time_series_peaks": _flow(
            _series(DAY, total, IN_1997) + " ORDER BY value DESC, period LIMIT 10"
        ),
        "time_series_summary": _flow(
            "SELECT count(*) AS periods, round(avg(value), 6) AS mean_value, "
            "max(value) AS max_value, min(value) AS min_value, min(period) AS first_period, "
            f"max(period) AS last_period FROM ({_series(DAY, total, IN_1997)})"
        ),
        "compare_years_sum": _years(
            "pipeline_name", "value", "round(100 * (value / nullif(previous, 0) - 1), 6)"
        ),
        "compare_years_share": _years(
            "county_name", "round(value, 6)", "round(value - previous, 6)", "percentage"
        ),
        "compare_years_totals": _flow(
            "SELECT CAST(year AS INTEGER) AS year, sum(value) AS total FROM filled GROUP BY 1",
            *_year_ctes("county_name", "sum"),
        ),
    }


def _patterns() -> dict[str, str]:
    ttest_where = "pipeline_name = 'Supplier#000000003' AND rec_del_sign = 1"
    location_sums = _profile_rows("loc_name", "month", 12, IN_1997)
    return {
        "seasonal_patterns": _flow(
            "SELECT *, row_number() OVER (ORDER BY total_volume DESC, season) = 1 AS is_peak "
            f"FROM (SELECT {SEASON} AS season, round_even(sum({Q}), 2) AS total_volume, "
            f"round_even(avg({Q}), 2) AS average_transaction, "
            f"count({Q}) AS transaction_count, "
            f"coalesce(sum({Q}) FILTER (WHERE rec_del_sign = 1), 0.0) AS receipts_volume, "
            f"abs(coalesce(sum({Q}) FILTER (WHERE rec_del_sign = -1), 0.0)) "
            "AS deliveries_volume FROM flow GROUP BY 1)"
        ),
        "monthly_trends": _flow(
            "SELECT period, total_volume, average_volume, transaction_count, active_locations, "
            "active_pipelines, active_partners, round(volume_growth, 6) AS volume_growth "
            "FROM grown", _activity(MONTH)
        ),
        "monthly_trends_summary": _flow(
            "SELECT (SELECT period FROM grown ORDER BY total_volume DESC, period LIMIT 1) "
            "AS peak_month, (SELECT max(total_volume) FROM grown) AS peak_volume, "
            "(SELECT period FROM grown ORDER BY total_volume, period LIMIT 1) AS low_month, "
            "(SELECT min(total_volume) FROM grown) AS low_volume, "
            "(SELECT round(avg(volume_growth), 6) FROM (SELECT volume_growth FROM grown "
            "ORDER BY period DESC LIMIT 12)) AS average_growth", _activity(MONTH)
        ),
        "consistent_pipelines": _flow(
            "SELECT pipeline_name, round(m, 6) AS mean_monthly_volume, "
            "round(s, 6) AS std_monthly_volume, round(100 * s / m, 6) AS cv_pct, "
            "months_active, round(1 / (1 + s / m), 6) AS score FROM judged "
            "ORDER BY s / m, pipeline_name LIMIT 10", _judged()
        ),
        "consistency_coverage": _flow(
            "SELECT count(*) AS groups_analyzed FROM judged", _judged()
        ),
        "direction_balance_monthly": _flow("SELECT * FROM balance", _balance()),
        "direction_balance_summary": _flow(
            "SELECT round(corr(receipts, deliveries), 6) AS correlation, "
            "round(avg(net_flow), 6) AS average_net_flow, "
            "round(stddev_samp(net_flow), 6) AS net_flow_volatility, "
            "CASE WHEN corr(receipts, deliveries) > 0.7 THEN 'Strong' "
            "WHEN corr(receipts, deliveries) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength "
            "FROM balance", _balance()
        ),
        "quarterly_activity": _flow(
            "SELECT period, total_volume, average_volume, active_locations, active_pipelines, "
            "active_partners, round(volume_growth, 6) AS volume_growth, "
            "round(location_growth, 6) AS location_growth FROM grown", _activity(QUARTER)
        ),
        "quarterly_activity_summary": _flow(
            "SELECT round(avg(volume_growth), 6) AS average_volume_growth, "
            "round(avg(location_growth), 6) AS average_location_growth, "
            "CASE WHEN avg(volume_growth) > 0 THEN 'Increasing' ELSE 'Decreasing' END "
            "AS volume_trend, CASE WHEN avg(location_growth) > 0 THEN 'Expanding' "
            "ELSE 'Contracting' END AS activity_trend "
            "FROM (SELECT * FROM grown ORDER BY period DESC LIMIT 8)", _activity(QUARTER)
        ),
        "correlation_daily": _correlation(DAY),
        "correlation_weekly": _correlation(WEEK),
        "correlation_monthly": _correlation(MONTH),
        "correlation_quarterly": _correlation(QUARTER),
        "correlation_quarterly_transactions": _correlation(QUARTER, "count(*)"),
        "correlation_points": _flow(
            f"SELECT {MONTH} AS period, CAST(count(DISTINCT connecting_entity) AS DOUBLE) AS x, "
            f"round(avg({Q}), 6) AS y FROM flow WHERE state_abb = 'NATION_3' "
            "AND rec_del_sign = 1 GROUP BY 1"
        ),
        "before_after_daily": _before_after(DAY),
        "before_after_weekly": _before_after(WEEK),
        "before_after_monthly": _before_after(MONTH),
        "before_after_transactions": _before_after(MONTH, "count(*)"),
        "before_after_locations": _before_after(MONTH, "count(DISTINCT loc_name)"),
        "before_after_average": _before_after(MONTH, f"avg({Q})"),
        "correlation_monthly_pipelines": _correlation(MONTH, "count(DISTINCT pipeline_name)"),
        "cluster_checks": _flow(
            "SELECT 'entities' AS check_name, 0 AS period, CAST(count(DISTINCT pipeline_name) AS DOUBLE) AS value "
            "FROM clustered UNION ALL SELECT 'repeated', 0, 0.0 "
            "UNION ALL SELECT 'nearer_elsewhere', 0, 0.0 UNION ALL "
            "SELECT 'volume', CAST(p.period AS INTEGER), coalesce(sum(volume), 0.0) FROM range(1, 13) p(period) "
            "LEFT JOIN clustered c ON c.part = p.period GROUP BY p.period",
            f"sums AS (SELECT pipeline_name, month(eff_gas_day) AS part, sum({Q}) AS volume FROM flow "
            f"WHERE {IN_1997} AND pipeline_name IS NOT NULL GROUP BY 1, 2)",
            "clustered AS (SELECT * FROM sums WHERE pipeline_name IN "
            "(SELECT pipeline_name FROM sums GROUP BY 1 HAVING max(abs(volume)) > 0))",
        ),
        "before_after_ttest": _flow(
            "SELECT round(m1, 6) AS before_mean, round(m2, 6) AS after_mean, "
            "round(m2 - m1, 6) AS absolute_change, "
            "round(coalesce((m2 - m1) / nullif(m1, 0) * 100, 0.0), 6) AS percentage_change, "
            "CASE WHEN m2 > m1 THEN 'Increase' WHEN m2 < m1 THEN 'Decrease' "
            "ELSE 'No change' END AS direction, round(t, 6) AS t_statistic, "
            "df AS degrees_of_freedom, round(p, 6) AS p_value, "
            "CASE WHEN p < 0.05 THEN 'Significant' ELSE 'Not significant' END AS significance "
            "FROM tests JOIN p_values USING (id)",
            _sides(DAY, ttest_where),
            "moments AS (SELECT 1 AS id, "
            + ", ".join(
                f"count(*) FILTER (WHERE side = '{s}') AS n{i}, "
                f"avg(value) FILTER (WHERE side = '{s}') AS m{i}, "
                f"var_samp(value) FILTER (WHERE side = '{s}') AS v{i}"
                for i, s in ((1, "before"), (2, "after"))
            ) + " FROM sides)",
            "tests AS (SELECT *, n1 + n2 - 2 AS df, (m1 - m2) / sqrt(((n1 - 1) * v1 "
            "+ (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM moments)",
            _p_value("tests", "id"),
        ),
        "profile_monthly": location_sums,
        "profile_quarterly": _profile_rows("pipeline_name", "quarter", 4),
        "profile_weekly": _profile_rows("state_abb", "week", 53),
    }


def _judged() -> str:
    return (
        "judged AS (SELECT pipeline_name, avg(volume) AS m, stddev_samp(volume) AS s, "
        f"count(*) AS months_active FROM (SELECT pipeline_name, {MONTH} AS period, "
        f"sum({Q}) AS volume FROM flow WHERE pipeline_name IS NOT NULL GROUP BY 1, 2) "
        "GROUP BY 1 HAVING count(*) >= 3)"
    )


def _balance() -> str:
    return (
        "balance AS (SELECT *, receipts - deliveries AS net_flow FROM "
        f"(SELECT {MONTH} AS period, "
        f"coalesce(sum({Q}) FILTER (WHERE rec_del_sign = 1), 0.0) AS receipts, "
        f"abs(coalesce(sum({Q}) FILTER (WHERE rec_del_sign = -1), 0.0)) AS deliveries "
        "FROM flow GROUP BY 1))"
    )


def _quality() -> dict[str, str]:
    violation = "rec_del_sign IS DISTINCT FROM 1"
    moments = f"moments AS (SELECT avg({Q}) AS m, stddev_samp({Q}) AS s FROM flow)"
    keys = "pipeline_name, loc_name"
    return {
        "rule_violations": _flow(
            f"SELECT 'SMALL' AS category, count(*) AS total, count(*) FILTER (WHERE {violation}) "
            f"AS violations, round_even(100.0 * count(*) FILTER (WHERE {violation}) / count(*), 1) "
            "AS pct FROM raw WHERE category_short = 'SMALL'"
        ),
        "rule_violations_filtered": _flow(
            f"SELECT 'SMALL' AS category, count(*) AS total, count(*) FILTER (WHERE {violation}) "
            f"AS violations, round_even(100.0 * count(*) FILTER (WHERE {violation}) / count(*), 1) "
            "AS pct FROM raw WHERE category_short = 'SMALL' AND state_abb = 'NATION_3' HAVING count(*) > 0"
        ),
        "rule_violation_examples": _flow(
            "SELECT eff_gas_day, pipeline_name, loc_name, rec_del_sign FROM raw "
            f"WHERE category_short = 'SMALL' AND {violation} ORDER BY ALL LIMIT 10"
        ),
        "rule_violations_by_pipeline": _flow(
            "SELECT pipeline_name, count(*) AS violations FROM raw "
            f"WHERE category_short = 'SMALL' AND {violation} AND pipeline_name IS NOT NULL "
            "GROUP BY 1"
        ),
        "completeness_all_missing": _completeness(f"{NO_PARTNER_PIPELINE} AND {NO_PARTNER}"),
        "completeness_any_missing": _completeness(f"({NO_PARTNER_PIPELINE} OR {NO_PARTNER})"),
        "completeness_examples": _flow(
            f"SELECT {keys}, concat_ws('|', CASE WHEN {NO_PARTNER_PIPELINE} "
            f"THEN 'connecting_pipeline' END, CASE WHEN {NO_PARTNER} THEN 'connecting_entity' "
            "END) AS missing_fields FROM raw WHERE category_short = 'SMALL' "
            f"AND ({NO_PARTNER_PIPELINE} OR {NO_PARTNER}) "
            f"ORDER BY {keys}, CASE WHEN {NO_PARTNER_PIPELINE} THEN 1 ELSE 0 END, "
            f"CASE WHEN {NO_PARTNER} THEN 1 ELSE 0 END LIMIT 10"
        ),
        "entity_conflicts": _flow(
            "SELECT dimension, count(*) FILTER (WHERE n_values > 1) AS duplicate_count, "
            "count(*) AS total_entities, round_even(100.0 * count(*) FILTER "
            "(WHERE n_values > 1) / count(*), 2) AS duplicate_pct FROM counted GROUP BY 1",
            *_conflict_ctes(keys),
        ),
        "entity_conflict_details": _flow(
            f"SELECT dimension, {keys}, n_values, string_agg(value, '|' ORDER BY value) "
            f"AS \"values\" FROM vals JOIN (SELECT * FROM counted WHERE n_values > 1 "
            f"QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY {keys}) <= 10) "
            f"USING (dimension, {keys}) WHERE value IS NOT NULL "
            f"GROUP BY dimension, {keys}, n_values", *_conflict_ctes(keys),
        ),
        "entity_conflict_values": _flow(
            "SELECT dimension, loc_name, value, n_values FROM vals JOIN counted "
            "USING (dimension, loc_name) WHERE n_values > 1 AND value IS NOT NULL",
            *_conflict_ctes("loc_name"),
        ),
        "anomaly_zscore": _flow(
            f"SELECT flow.*, round(({Q} - m) / s, 6) AS zscore FROM flow, moments "
            f"WHERE abs(({Q} - m) / s) > 1.5", moments
        ),
        "anomaly_zscore_count": _flow(
            "SELECT count(*) AS anomalies FROM flow, moments "
            f"WHERE abs(({Q} - m) / s) > 1.5", moments
        ),
        "anomaly_rolling_location": _anomaly_rolling("loc_name", "loc_name"),
        "anomaly_rolling_total": _anomaly_rolling("'Total System' AS entity", "entity"),
        "anomaly_rolling_calendar": _anomaly_rolling(
            "state_abb", "state_abb",
            "ORDER BY day RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING",
        ),
        "anomaly_change_location": _anomaly_change("loc_name", "loc_name"),
        "anomaly_rolling_filtered": _anomaly_rolling(
            "state_abb", "state_abb", where="category_short = 'SMALL'"
        ),
        "anomaly_change_limited": _anomaly_change(
            "loc_name", "loc_name",
            "ORDER BY coalesce(abs((quantity - roll_mean) / nullif(roll_mean, 0) * 100), "
            "CAST('infinity' AS DOUBLE)) DESC, loc_name, day LIMIT 10",
        ),
        "anomaly_change_total": _anomaly_change("'Total System' AS entity", "entity"),
        "anomaly_percentile_location": _anomaly_percentile("loc_name", "loc_name"),
        "anomaly_percentile_total": _anomaly_percentile("'Total System' AS entity", "entity"),
        "anomaly_top_examples": _anomaly_rolling(
            "pipeline_name", "pipeline_name",
            tail="ORDER BY (quantity - roll_mean) / roll_std DESC, pipeline_name, day LIMIT 10",
        ),
    }


def _questions() -> dict[str, str]:
    delivered = f"sum({Q}) FILTER (WHERE rec_del_sign = -1)"
    winter, summer = "month(eff_gas_day) IN (12, 1, 2)", "month(eff_gas_day) IN (6, 7, 8)"
    small = "category_short = 'SMALL' AND rec_del_sign = -1"
    return {
        "hhi_concentration": _flow(
            "SELECT count(*) AS groups, sum(v) AS total_volume, "
            "round(sum(pow(v / total, 2)), 6) AS hhi, "
            "CASE WHEN sum(pow(v / total, 2)) < 0.1 THEN 'Low' "
            "WHEN sum(pow(v / total, 2)) < 0.18 THEN 'Moderate' ELSE 'High' END AS level "
            "FROM (SELECT v, sum(v) OVER () AS total FROM counties)",
            f"counties AS (SELECT county_name, sum({Q}) AS v FROM flow "
            "WHERE pipeline_name = 'Supplier#000000003' AND rec_del_sign = -1 "
            "AND county_name IS NOT NULL GROUP BY 1)",
        ),
        "quantile_buckets": _flow(
            "SELECT state_abb, total_volume, CASE WHEN total_volume <= low THEN 'low' "
            "WHEN total_volume <= high THEN 'medium' ELSE 'high' END AS bucket FROM totals, "
            "(SELECT quantile_cont(total_volume, 1.0 / 3) AS low, "
            "quantile_cont(total_volume, 2.0 / 3) AS high FROM totals)",
            f"totals AS (SELECT state_abb, {delivered} AS total_volume FROM flow "
            "WHERE rec_del_sign = -1 AND state_abb IS NOT NULL GROUP BY 1)",
        ),
        "winter_vs_summer": _flow(
            "SELECT state_abb, round(w, 6) AS winter_mean, round(s, 6) AS summer_mean, "
            "round(100 * (w / nullif(s, 0) - 1), 6) AS difference_pct FROM "
            f"(SELECT state_abb, avg({Q}) FILTER (WHERE {winter}) AS w, "
            f"avg({Q}) FILTER (WHERE {summer}) AS s FROM flow WHERE {small} "
            f"AND ({winter} OR {summer}) AND state_abb IS NOT NULL GROUP BY 1)"
        ),
        "winter_summer_ttest": _flow(
            "SELECT state_abb, n1 AS winter_days, round(m1, 6) AS winter_mean, "
            "n2 AS summer_days, round(m2, 6) AS summer_mean, round(t, 6) AS t_statistic, "
            "df AS degrees_of_freedom, round(p, 6) AS p_value, "
            "CASE WHEN NOT (n1 > 1 AND n2 > 1) THEN 'Insufficient data' WHEN p < 0.05 "
            "THEN 'Significant' ELSE 'Not significant' END AS significance "
            "FROM tests LEFT JOIN p_values USING (state_abb)",
            _daily("state_abb", where=f"{small} AND state_abb IS NOT NULL"),
            "moments AS (SELECT state_abb, "
            + ", ".join(
                f"count(*) FILTER (WHERE month(day) IN {m}) AS n{i}, "
                f"avg(quantity) FILTER (WHERE month(day) IN {m}) AS m{i}, "
                f"var_samp(quantity) FILTER (WHERE month(day) IN {m}) AS v{i}"
                for i, m in ((1, "(12, 1, 2)"), (2, "(6, 7, 8)"))
            ) + " FROM daily GROUP BY 1 HAVING n1 + n2 > 0)",
            "tests AS (SELECT *, n1 + n2 - 2 AS df, CASE WHEN n1 > 1 AND n2 > 1 THEN "
            "(m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0) "
            "* (1.0 / n1 + 1.0 / n2)), 0) END AS t FROM moments)",
            "usable AS (SELECT * FROM tests WHERE t IS NOT NULL)",
            _p_value("usable", "state_abb"),
        ),
        "partner_start_effect": _flow(
            "SELECT state_abb, connecting_pipeline, start_day, round(b, 6) AS mean_before, "
            "round(a, 6) AS mean_after, round(a - b, 6) AS change, a > b AS increased FROM "
            "(SELECT s.state_abb, connecting_pipeline, start_day, "
            "avg(net_flow) FILTER (WHERE day < start_day) AS b, "
            "avg(net_flow) FILTER (WHERE day >= start_day) AS a "
            "FROM starts s JOIN net n ON s.state_abb = n.state_abb "
            "AND n.day BETWEEN start_day - 90 AND start_day + 89 GROUP BY 1, 2, 3) "
            "JOIN (SELECT state_abb, min(day) AS first_day FROM net GROUP BY 1) "
            "USING (state_abb) WHERE start_day - 90 >= first_day",
            f"starts AS (SELECT state_abb, connecting_pipeline, min({DAY}) AS start_day FROM flow "
            "WHERE category_short = 'SMALL' AND state_abb IS NOT NULL "
            "AND connecting_pipeline IS NOT NULL GROUP BY 1, 2)",
            f"net AS (SELECT state_abb, {DAY} AS day, sum({NET}) AS net_flow FROM flow "
            "WHERE state_abb IS NOT NULL GROUP BY 1, 2)",
        ),
        "spike_codrop_cases": _flow(
            "SELECT CAST(case_no AS INTEGER) AS case_no, c.pipeline_name, c.state_abb, c.day, "
            "spike_quantity, round(z, 6) AS zscore, d.pipeline_name AS drop_pipeline, "
            "drop_quantity, round(d.pct, 6) AS pct_change FROM chosen c JOIN drops d "
            "ON c.state_abb = d.state_abb AND c.day = d.day "
            "AND c.pipeline_name <> d.pipeline_name",
            _daily("pipeline_name, state_abb", where="category_short = 'SMALL'"),
            _rolling("pipeline_name, state_abb"),
            "spikes AS (SELECT pipeline_name, state_abb, day, quantity AS spike_quantity, "
            "(quantity - roll_mean) / nullif(roll_std, 0) AS z FROM rolled WHERE filled >= 22 "
            "AND (quantity - roll_mean) / nullif(roll_std, 0) > 2)",
            f"raw_daily AS (SELECT pipeline_name, state_abb, {DAY} AS day, sum({Q}) AS quantity "
            "FROM raw GROUP BY ALL)",
            _rolling("pipeline_name, state_abb", source="raw_daily", name="raw_rolled"),
            "drops AS MATERIALIZED (SELECT pipeline_name, state_abb, day, quantity AS drop_quantity, "
            "(quantity - roll_mean) / nullif(roll_mean, 0) * 100 AS pct FROM raw_rolled "
            "WHERE filled >= 22 AND (quantity - roll_mean) / nullif(roll_mean, 0) * 100 < -30)",
            "dropped AS (SELECT state_abb, day, min(pipeline_name) AS first_drop, "
            "max(pipeline_name) AS last_drop FROM drops GROUP BY 1, 2)",
            "chosen AS MATERIALIZED (SELECT s.*, row_number() OVER (ORDER BY z DESC, "
            "pipeline_name, state_abb, day) AS case_no FROM spikes s JOIN dropped "
            "USING (state_abb, day) WHERE pipeline_name <> first_drop "
            "OR pipeline_name <> last_drop QUALIFY case_no <= 3)",
        ),
        "null_share_by_group": _flow(
            "SELECT state_abb, count(*) AS row_count, " + ", ".join(
                f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) "
                f"AS {c}_missing_pct" for c in ("latitude", "longitude", "county_name")
            ) + " FROM raw WHERE state_abb IS NOT NULL GROUP BY 1"
        ),
        "top_locations_per_direction": _flow(
            "SELECT rec_del_sign, loc_name, round(v, 6) AS value, "
            "CAST(row_number() OVER (PARTITION BY rec_del_sign ORDER BY v DESC, loc_name) "
            "AS INTEGER) AS position FROM (SELECT rec_del_sign, loc_name, avg(quantity) AS v "
            "FROM daily WHERE loc_name IS NOT NULL GROUP BY 1, 2) QUALIFY position <= 10",
            _daily("rec_del_sign, loc_name", where=IN_1997),
        ),
        "peak_net_flow_days": _flow(
            _series(DAY, f"sum({NET})", f"pipeline_name = 'Supplier#000000003' AND {IN_1997}")
            + " ORDER BY value DESC, period LIMIT 5"
        ),
        "net_flow_sources_and_sinks": _ends(),
    }


def _grown() -> dict[str, str]:
    early, late = "eff_gas_day < TIMESTAMP '1998-07-01'", "eff_gas_day >= TIMESTAMP '1998-01-01'"
    return {
        "distinct_rows_grown": _flow("SELECT * FROM flow"),
        "distinct_growth_log": _flow(
            "SELECT CAST(0 AS BIGINT) AS batch_no, "
            f"(SELECT count(*) FROM raw WHERE {early}) AS rows_read, "
            f"(SELECT count(*) FROM flow WHERE {early}) AS rows_new UNION ALL "
            "SELECT CAST(1 AS BIGINT) AS batch_no, "
            f"(SELECT count(*) FROM raw WHERE {late}) AS rows_read, "
            f"(SELECT count(*) FROM flow WHERE {late} AND NOT {early}) AS rows_new"
        ),
    }


# The flow rows with what they are ordered by: order, line, copy and the line's content.
_STORED = """stored AS (
  SELECT f.*, l.*, copy FROM lineitem l
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey,
  LATERAL (SELECT s_name AS pipeline_name, p_name AS loc_name, p_type AS category_short,
    l_shipdate AS eff_gas_day, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS rec_del_sign,
    l_linenumber <= 5 AS no_partner_pipeline, l_orderkey % 8 = 0 OR l_orderkey % 16 = 1 AS no_partner) f,
  LATERAL (SELECT unnest(CASE WHEN l_orderkey % 59 = 0 THEN [1, 2] ELSE [1] END) AS copy)
  WHERE category_short = 'SMALL'
)"""


def _text_times() -> dict[str, str]:
    text = (
        f"CASE WHEN {Q} = 13 THEN 'n/a' WHEN {Q} = 17 THEN '  ' WHEN {Q} = 18 THEN NULL "
        f"WHEN {Q} = 19 THEN strftime(eff_gas_day, '%d/%m/%Y') "
        f"WHEN {Q} = 23 THEN strftime(eff_gas_day, '%Y') || '-02-30' ELSE strftime(eff_gas_day, '%Y-%m-%d') END"
    )
    text_rows = f"text_rows AS (SELECT * REPLACE ({text} AS eff_gas_day) FROM raw)"
    good = (
        f"parsed AS (SELECT * REPLACE (CASE WHEN {Q} NOT IN (17, 18) THEN eff_gas_day END AS eff_gas_day) "
        f"FROM raw WHERE {Q} NOT IN (13, 23))"
    )
    return {
        "text_times_daily": _flow(
            f"SELECT {DAY} AS period, sum({Q}) AS value FROM (SELECT DISTINCT * FROM parsed) "
            "WHERE eff_gas_day IS NOT NULL GROUP BY 1", good),
        "text_times_rows": _flow("SELECT * FROM parsed", good),
        "text_times_quarantined": _flow(f"SELECT * FROM text_rows WHERE {Q} IN (13, 23)", text_rows),
        "text_times_counts": _flow(
            "SELECT unnest(['rows', 'parsed', 'missing', 'failed']) AS name, unnest([count(*), "
            f"count(*) FILTER ({Q} NOT IN (13, 17, 18, 23)), count(*) FILTER ({Q} IN (17, 18)), "
            f"count(*) FILTER ({Q} IN (13, 23))]) AS n FROM raw"),
    }


def _robust() -> dict[str, str]:
    def sketches(period: str) -> str:
        names = ("active_locations", "active_pipelines", "active_partners")
        return _flow(
            "SELECT period, TRUE AS same_volume, " + ", ".join(names) + ", "
            + ", ".join(f"TRUE AS {n}_within" for n in names) + " FROM activity", _activity(period))

    place = (
        "row_number() OVER (ORDER BY l_orderkey, l_linenumber, copy, l_partkey, l_suppkey, l_shipdate, l_quantity)"
    )
    profile = ", ".join(f"coalesce(sum({Q}) FILTER (month(eff_gas_day) = {m}), 0) AS m{m}" for m in range(1, 13))
    square = " + ".join(f"(a.m{m} - b.m{m}) ** 2" for m in range(1, 13))
    drops = (
        "drops AS MATERIALIZED (SELECT pipeline_name, state_abb, day, quantity AS drop_quantity, "
        "(quantity - roll_mean) / nullif(roll_mean, 0) * 100 AS pct FROM raw_rolled "
        "WHERE filled >= 22 AND (quantity - roll_mean) / nullif(roll_mean, 0) * 100 < -30)"
    )
    near = (
        "d.state_abb = s.state_abb AND d.pipeline_name <> s.pipeline_name "
        "AND d.day BETWEEN s.day - INTERVAL 2 DAY AND s.day + INTERVAL 2 DAY"
    )
    return {
        **_text_times(),
        "monthly_sketches": sketches(MONTH),
        "quarterly_sketches": sketches(QUARTER),
        "rule_violations_stored_order": (
            f"WITH {_STORED} SELECT eff_gas_day, pipeline_name, loc_name, rec_del_sign, "
            f"CAST({place} AS INTEGER) AS position FROM stored WHERE rec_del_sign <> 1 "
            "QUALIFY position <= 25"
        ),
        "completeness_stored_order": (
            f"WITH {_STORED} SELECT pipeline_name, loc_name, concat_ws('|', CASE WHEN no_partner_pipeline "
            "THEN 'connecting_pipeline' END, CASE WHEN no_partner THEN 'connecting_entity' END) "
            f"AS missing_fields, CAST({place} AS INTEGER) AS position FROM stored "
            "WHERE no_partner_pipeline OR no_partner QUALIFY position <= 25"
        ),
        "silhouette_by_state": _flow(
            "SELECT pipeline_name, state_abb, round(own, 6) AS own_distance, round(other, 6) AS other_distance, "
            "CASE WHEN n = 1 OR greatest(own, other) = 0 THEN 0.0 ELSE round((other - own) / greatest(own, other), 6) END "
            "AS silhouette FROM scored",
            f"profiles AS (SELECT pipeline_name, min(state_abb) AS state_abb, {profile} FROM flow "
            f"WHERE {IN_1997} GROUP BY 1 HAVING sum({Q}) <> 0)",
            f"sums AS (SELECT a.pipeline_name, a.state_abb, b.state_abb AS met, count(*) AS n, sum(sqrt({square})) AS total "
            "FROM profiles a, profiles b GROUP BY 1, 2, 3)",
            "scored AS (SELECT pipeline_name, state_abb, max(n) FILTER (met = state_abb) AS n, "
            "max(total / greatest(n - 1, 1)) FILTER (met = state_abb) AS own, "
            "min(total / n) FILTER (met <> state_abb) AS other FROM sums GROUP BY 1, 2)",
        ),
        "spike_codrop_near": _flow(
            "SELECT CAST(case_no AS INTEGER) AS case_no, s.pipeline_name, s.state_abb, s.day, "
            "spike_quantity, round(z, 6) AS zscore, d.pipeline_name AS drop_pipeline, "
            "drop_quantity, round(d.pct, 6) AS pct_change, d.day AS drop_day, "
            "CAST(date_diff('day', s.day, d.day) AS INTEGER) AS days_apart "
            f"FROM chosen s JOIN drops d ON {near}",
            _daily("pipeline_name, state_abb", where="category_short = 'SMALL'"),
            _rolling("pipeline_name, state_abb"),
            "spikes AS (SELECT pipeline_name, state_abb, day, quantity AS spike_quantity, "
            "(quantity - roll_mean) / nullif(roll_std, 0) AS z FROM rolled WHERE filled >= 22 "
            "AND (quantity - roll_mean) / nullif(roll_std, 0) > 2)",
            f"raw_daily AS (SELECT pipeline_name, state_abb, {DAY} AS day, sum({Q}) AS quantity "
            "FROM raw GROUP BY ALL)",
            _rolling("pipeline_name, state_abb", source="raw_daily", name="raw_rolled"),
            drops,
            "chosen AS MATERIALIZED (SELECT s.*, row_number() OVER (ORDER BY z DESC, pipeline_name, "
            f"state_abb, day) AS case_no FROM spikes s WHERE EXISTS (SELECT 1 FROM drops d WHERE {near}) "
            "QUALIFY case_no <= 10)",
        ),
    }


def _event_queries() -> dict[str, str]:
    window = "(PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    return {
        "events_monthly_sum": _events(
            "SELECT CAST(date_trunc('month', ts) AS DATE) AS period, round(sum(value), 6) "
            "AS value FROM events_flow GROUP BY 1"
        ),
        "events_top_users": _events(
            "SELECT user_id, round(sum(value), 6) AS total_volume FROM events_flow "
            "WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 10"
        ),
        "events_average_quantity": _events(
            "SELECT round(avg(value), 6) AS avg_quantity, round(median(value), 6) "
            "AS median_quantity FROM events_flow"
        ),
        "events_anomaly_rolling": _events(
            "SELECT event_type, day, round(quantity, 6) AS quantity, round(m, 6) AS roll_mean, "
            "round(s, 6) AS roll_std, round((quantity - m) / nullif(s, 0), 6) AS zscore FROM "
            f"(SELECT *, count(*) OVER {window} AS filled, avg(quantity) OVER {window} AS m, "
            f"stddev_samp(quantity) OVER {window} AS s FROM daily) "
            "WHERE filled >= 5 AND (quantity - m) / nullif(s, 0) > 1.5",
            "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS quantity "
            "FROM events_flow WHERE event_type IS NOT NULL GROUP BY 1, 2)",
        ),
    }


def oracle_statements() -> dict[str, str]:
    statements = {
        **_retrieval(), **_patterns(), **_quality(), **_questions(), **_robust(), **_grown(),
        **_event_queries()
    }
    return {
        **statements,
        "distinct_rows": _flow("SELECT * FROM flow"),
        "profile_shape_in_place": statements["profile_shape"],
        "net_flows_by_state_in_place": statements["net_flows_by_state"],
    }
