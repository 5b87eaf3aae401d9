"""Column-level building blocks: time buckets, metrics, filters, statistics, quantiles."""
